"""Streams of records and run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_records(stream: DataFrame, good: str, bad: str, registry: str, checkpoint: str, checks: list[tuple[str, Column]], entity: str, held_out: int = 40) -> StreamingQuery:
    """Checks each batch, appends rejected rows with their problems, gives new entities a split that never changes, and appends good rows with it.

    A batch's rows are written under its number, so a batch that runs again after a failure overwrites itself.
    """
    from annomill.operators.records import check_records
    from annomill.operators.sampling import freeze_split

    def one(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        checked = check_records(df, checks).persist()
        checked.filter("size(problems) > 0").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        kept = checked.filter("size(problems) = 0").drop("problems")
        kind = dict(kept.dtypes)[entity]
        known = spark.read.schema(f"{entity} {kind}, split string, batch int").parquet(registry).filter(F.col("batch") < number).drop("batch") if number else spark.createDataFrame([], f"{entity} {kind}, split string")
        splits = freeze_split(kept, known, entity, held_out)
        splits.join(known.select(entity), entity, "left_anti").write.mode("overwrite").parquet(f"{registry}/batch={number}")
        kept.join(splits, entity).write.mode("overwrite").parquet(f"{good}/batch={number}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, fan: int = 4) -> StreamingQuery:
    """Keeps the latest row of each key: each batch writes its own keys' latest rows, and each `fan` runs of a level are merged into one of the next.

    So a row is written again once a level, a reader merges fewer than fan runs of each level (read_upserted), and reading all that
    stands there is right as well. Runs are named by batch numbers, so a batch that runs again overwrites itself. What a merge replaced goes
    when the next batch is done: a reader has that long, and a batch that runs again still finds its parts. Rows without a key are one key's.
    """
    from annomill.sources.writers import latest

    def one(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        latest(df, key, order).write.mode("overwrite").parquet(_run(path, 0, number))
        for level in _merged_at(number, fan):
            parts = spark.read.schema(df.schema).parquet(*(_run(path, *r) for r in _parts(level, number, fan)))
            latest(parts, key, order).write.mode("overwrite").parquet(_run(path, level, number))
        for level in _merged_at(number - 1, fan):
            for r in _parts(level, number - 1, fan):
                fs, place = _place(spark, _run(path, *r))
                fs.delete(place, True)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, schema: str, key: str, order: str, fan: int = 4) -> DataFrame:
    """The latest row of each key of what ingest_upsert wrote with that fan; no batch yet: no rows."""
    from annomill.sources.writers import latest

    def whole(level: int, number: int) -> bool:
        fs, place = _place(spark, _run(path, level, number) + "/_SUCCESS")
        return fs.exists(place)

    fs, place = _place(spark, f"{path}/level=0")
    names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
    last = max((n for n in (int(x.split("=")[1]) for x in names if x.startswith("run=")) if whole(0, n)), default=-1)
    runs = [r for top in _cover(last + 1, fan) for r in _standing(*top, fan, whole)]
    if not runs:
        return spark.createDataFrame([], schema)
    return latest(spark.read.schema(schema).parquet(*(_run(path, *r) for r in runs)), key, order)


def _run(path: str, level: int, number: int) -> str:
    return f"{path}/level={level}/run={number}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _merged_at(number: int, fan: int) -> list[int]:
    """Levels, lowest first, whose run of this batch is a merge."""
    level, out = 1, []
    while number >= 0 and (number + 1) % fan**level == 0:
        out.append(level)
        level += 1
    return out


def _parts(level: int, number: int, fan: int) -> list[tuple[int, int]]:
    """What a merged run is made of; a run of level l ends with its batch and is fan^l batches long."""
    return [(level - 1, number - k * fan ** (level - 1)) for k in reversed(range(fan))]


def _cover(batches: int, fan: int) -> list[tuple[int, int]]:
    """The fewest runs (level, last batch) that hold the first so many batches."""
    level, done, out = 0, 0, []
    while fan ** (level + 1) <= batches:
        level += 1
    for k in range(level, -1, -1):
        while done + fan**k <= batches:
            done += fan**k
            out.append((k, done - 1))
    return out


def _standing(level: int, number: int, fan: int, whole) -> list[tuple[int, int]]:
    """A run, or its parts where its merge was cut off."""
    if level == 0 or whole(level, number):
        return [(level, number)]
    return [x for r in _parts(level, number, fan) for x in _standing(*r, fan, whole)]


def _since_launch(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
    """Of unsorted parts the rows not before their last launch."""
    last = max((t for p in parts for t in p.loc[p["kind"] == "launch", "ts"]), default=None)
    return parts if last is None else [p[p["ts"] >= last] for p in parts]


def unfinished_steps(stream: DataFrame) -> DataFrame:
    """(device, steps, open): after each batch, for each device in it, the steps open since its last launch and how often. State is one small map per device.

    A device's rows of a batch may come in several parts, each in any order: they are put together, then sorted by time
    (equal times by kind, then step). Of rows before a launch none is kept.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def work(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, counts = map(list, state.get) if state.exists else ([], [])
        opened = dict(zip(steps, counts, strict=True))
        rows: list[pd.DataFrame] = []
        for pdf in batches:
            rows = _since_launch([*rows, pdf[["ts", "kind", "step"]]])
        for kind, step in zip(*(pd.concat(rows).sort_values(["ts", "kind", "step"])[c] for c in ("kind", "step")), strict=True):
            if kind == "launch":
                opened = {}
            elif kind == "start":
                opened[step] = opened.get(step, 0) + 1
            elif kind in ("end", "fail") and opened.get(step, 0):
                opened[step] -= 1
        opened = {k: v for k, v in opened.items() if v}
        state.update((list(opened), list(opened.values())))
        yield pd.DataFrame({"device": [key[0]], "steps": [list(opened)], "open": [list(opened.values())]})

    return stream.groupBy("device").applyInPandasWithState(work, "device long, steps array<string>, open array<int>", "steps array<string>, counts array<int>", "update", GroupStateTimeout.NoTimeout)


def stage_metrics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends stage rows; medians are taken when the table is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
