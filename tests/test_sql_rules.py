"""SQL states the same rule as its query for draws and lengths that small tables don't have."""

import duckdb
from pyspark.sql import functions as F

from annomill.functions.numeric import poisson
from annomill.operators.aggregates import bbox_union
from annomill.plans.record_queries import POISSON_HALF


def test_poisson_of_large_draws(spark):
    draws = [0.0, 0.606, 0.607, 0.9998, 0.99983, 0.99999, 0.999999, 0.9999999, 0.99999999, 1 - 2.0**-32]
    found = [r.n for r in spark.createDataFrame([(k, u) for k, u in enumerate(draws)], "k int, u double").select("k", poisson(0.5, F.col("u")).alias("n")).orderBy("k").collect()]
    sql = duckdb.connect().execute(f"SELECT {POISSON_HALF} FROM (SELECT unnest(range({len(draws)})) AS k, unnest({draws}::DOUBLE[]) AS u) ORDER BY k").fetchall()
    assert found == [r[0] for r in sql] and found[-1] == 9


def test_box_sides_are_rounded_as_decimals(spark):
    boxes = [(k, a / 100, 0.0, (b - a) / 100, 1.0) for k, (a, b) in enumerate((a, a + 5 + 10 * n) for a in range(1, 400, 7) for n in range(0, 300, 37))]
    found = {r.k: (r.x, r.w) for r in bbox_union(spark.createDataFrame(boxes, "k int, x double, y double, w double, h double"), ["k"]).collect()}
    assert found == {k: (int(x * 100 + 0.5) // 5 // 2 / 10 if int(x * 100 + 0.5) % 10 < 5 else (int(x * 100 + 0.5) // 10 + 1) / 10, (int(w * 100 + 0.5) // 10 + 1) / 10) for k, x, _, w, _ in boxes}
