"""Writers. All go through Spark's committers, so a lost task leaves no half file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, split: str, order: list[str], size: int = 500, *, kind: str = "json") -> None:
    """Shards of so many rows per split, in order; JSON shards are compressed."""
    from annomill.operators.windows import shard_index

    placed = shard_index(df, split, order, size).drop("place")
    out = placed.repartition(split, "shard").sortWithinPartitions(split, "shard", *order).write.partitionBy(split, "shard")
    (out.option("compression", "gzip").json if kind == "json" else out.parquet)(path)


def export_eval(df: DataFrame, path: str, split: str, order: list[str], n: int, projections: dict[str, list[str]]) -> None:
    """The first n rows of each split, once per projection."""
    from annomill.operators.windows import top_per_group

    first = top_per_group(df, [split], order, n)
    for name, columns in projections.items():
        first.select(split, *columns).write.json(f"{path}/{name}")


def write_rows(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_stats(stats: DataFrame, path: str, dataset: str, split: str) -> None:
    """A small table of figures under a name that no other dataset or split has."""
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/{dataset}_{split}")


def write_new(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key isn't there yet: an interrupted build goes on where it stopped."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).parquet(path).select(key).distinct()
        new = df.join(done, key, "left_anti")
    except Exception as e:  # the first time there is no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df
    new.write.mode("append").parquet(path)


def upsert(df: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the latest."""
    return latest(df.unionByName(new), key, order)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the latest, by a partial aggregation (ties: the largest row)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("r")).select(*(F.col(key) if c == key else F.col("r")[c].alias(c) for c in df.columns))


def render_report(df: DataFrame, title: str, order: list[str], most: int = 1000) -> str:
    """A small table of figures as Markdown; a table of more than `most` rows is an error."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"## {title}", "", *lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])
