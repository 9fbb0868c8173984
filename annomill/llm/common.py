"""Helpers shared by the operators: the folder that all executors see, partition counts, Arrow access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir. Where that is unset, a local session makes its own; elsewhere it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage, survives lost executors, gives true sizes."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Number of groups for so many rows: follows the input, and is never below the session's own parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)


def with_chunk(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Adds column chunk (0 to n-1) from a hash of the keys, so that no source, key or group of copies shapes a chunk."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and where each row starts and ends. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return text, at - at[0]


def pieces(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most so many bytes, or one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def batch(schema: str, **columns) -> pa.RecordBatch:
    """A record batch from arrays, in the order given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in fields], names=[n for n, _ in fields])
