"""The order of shingles stays as sharp in a large table as in a small one."""

from pyspark.sql import functions as F

from annomill.llm import simhash


def test_shingles_of_few_texts_of_many_are_known_as_frequent(spark):
    docs = spark.range(100_000, numPartitions=4).select(F.format_string("a b c d g%d u%d", F.floor(F.col("id") / 60), "id").alias("text"))
    shared = {int(next(simhash.shingle_sets(x, 5)).astype("u8")[0]) for x in _columns([f"a b c d g{k}" for k in range(1600)])}
    known, _ = simhash._frequent(docs, 100_000, 5)
    assert len(shared) == 1600 and len(shared & set(known.tolist())) >= 1500


def _columns(texts):
    import pyarrow as pa

    return [pa.array([t]) for t in texts]
