"""A device's rows may reach the stream's state function in several parts, in any order."""

import random

from annomill.streaming import ingest


def _opened(rows):
    opened = {}
    for _, kind, step in sorted(rows):
        if kind == "launch":
            opened = {}
        elif kind == "start":
            opened[step] = opened.get(step, 0) + 1
        elif kind in ("end", "fail") and opened.get(step, 0):
            opened[step] -= 1
    return {k: v for k, v in opened.items() if v}


def test_rows_in_parts_and_equal_times(spark, tmp_path):
    rng = random.Random(6)
    log = [(d, rng.randrange(2000 if d % 2 else 40), rng.choice(["start", "start", "end", "fail", "info"] + ["launch"] * (d % 3)), f"s{rng.randrange(4)}") for d in range(12) for _ in range(300)]
    rng.shuffle(log)
    spark.createDataFrame(log, "device long, ts long, kind string, step string").coalesce(1).write.parquet(f"{tmp_path}/log")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = ingest.unfinished_steps(ingest.event_stream(spark, f"{tmp_path}/log", "device long, ts long, kind string, step string"))
        write = lambda df, number: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.device: dict(zip(r.steps, r.open, strict=True)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {d: _opened([r[1:] for r in log if r[0] == d]) for d in range(12)}
