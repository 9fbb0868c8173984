"""Readers of annotation files. Schemas are given, so Spark reads only what is asked for; bad rows keep a reason."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, number: str = r"(\d+)\.json$") -> DataFrame:
    """(id, doc, reason): one JSON document per file, id the number in the file's path; a file that is no JSON has reason "error"."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", number, 1).cast("long").alias("id"), F.try_parse_json("value").alias("doc"))
    return files.withColumn("reason", F.when(F.col("doc").isNull(), "error").otherwise("ok"))


def read_lookup_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are passed over."""
    return spark.read.schema(schema).json(path)


def read_shards(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    """The shards of one split; other splits' folders aren't opened."""
    return spark.read.schema(schema + ", split string").option("basePath", path).json(path).filter(F.col("split") == split)


def read_bundle(spark: SparkSession, path: str, names: str = "*.zip") -> DataFrame:
    """(bundle, name, text) of the JSON members of zip files; a file that is no zip has a null name. One archive is one task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows = [(name, m, z.read(m).decode("utf-8", "replace")) for m in sorted(z.namelist()) if m.endswith(".json")]
                except zipfile.BadZipFile:
                    rows = [(name, None, None)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["bundle", "name", "text"])

    return files.mapInArrow(work, "bundle string, name string, text string")


def read_blobs(spark: SparkSession, records: DataFrame, path: str, name: str, parts: int = 1) -> DataFrame:
    """Records with the bytes of the file they name, by so many last parts of its path; null where there is none."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.substring_index("path", "/", -parts).alias(name), F.col("content").alias("blob"))
    return records.join(blobs.hint("merge"), name, "left")


def read_results(spark: SparkSession, path: str, schema: str, expected: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every expected row with its result; "pending" where there is none yet."""
    from annomill.operators.joins import method_grid

    return method_grid(expected, spark.read.schema(schema).json(path), on, value)


def read_eval_inputs(spark: SparkSession, gold: str, recognized: str, kind: str, schema: str) -> DataFrame:
    """Elements by id from the gold folder or from recognised rows."""
    if kind not in ("gold", "recognized"):
        raise ValueError("kind is 'gold' or 'recognized'")
    return spark.read.schema(schema).json(gold if kind == "gold" else recognized)


def read_params(values: dict[str, object], dataset: str | None = None) -> dict[str, tuple[float, float]]:
    """Ranges from a tree of scalars and [low, high] pairs, by dotted names. A dataset's own values, under "datasets", replace the common ones."""
    own = values.get("datasets", {})
    values = {k: v for k, v in values.items() if k != "datasets"}
    if dataset is not None:
        if dataset not in own:
            raise ValueError(f"no parameters for {dataset}; there are {sorted(own)}")
        return read_params(values) | read_params(own[dataset])
    out: dict[str, tuple[float, float]] = {}
    for k, v in values.items():
        if isinstance(v, dict):
            out |= {f"{k}.{name}": r for name, r in read_params(v).items()}
        else:
            low, high = v if isinstance(v, list | tuple) else (v, v)
            out[k] = (float(low), float(high))
    return out
