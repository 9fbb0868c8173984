"""Session settings, and the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(name: str = "annomill", cores: str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in UTC. With cores a local one of its own size; without, the launcher's master, memory and partitions stand."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    return builder.getOrCreate()


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
    """Writes the rows to the shared folder and reads them back, where a table is read several times or its lineage is long."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
