"""Grid joins against all pairs: odd boxes, documents of very different scale, one document of 100,000 boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annomill.functions.numeric import Box
from annomill.operators import joins as J
from annomill.operators.spatial import extent, meeting

RNG = np.random.default_rng(5)


def boxes(docs, n, scale=1.0, wide=0.2):
    out = []
    for d in docs:
        s = scale * 10.0 ** (d % 5 - 2)
        for k in range(n):
            w, h = (RNG.random(2) * (wide if RNG.random() > 0.1 else 3) * s).tolist()
            x, y = ((RNG.random(2) - 0.5) * 4 * s).tolist()
            out.append((d, d * 1000 + k, x, y, w, h if RNG.random() > 0.1 else 0.0))
    return out


ODD = [(0, 900, None, 1.0, 1.0, 1.0), (0, 901, 0.0, 0.0, -1.0, 1.0), (0, 902, float("nan"), 0.0, 1.0, 1.0), (0, 903, float("inf"), 0.0, 1.0, 1.0), (None, 904, 0.0, 0.0, 9.0, 9.0)]
A, B = boxes(range(6), 40) + ODD + [(9, 9000, 0.0, 0.0, 0.0, 0.0)], boxes(range(6), 30) + ODD + [(9, 9001, 0.0, 0.0, 0.0, 0.0)]
SCHEMA = "doc long, id long, x double, y double, w double, h double"


def good(r):
    return r[0] is not None and all(v is not None and math.isfinite(v) for v in r[2:]) and r[4] >= 0 and r[5] >= 0


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(A, SCHEMA).repartition(3), spark.createDataFrame(B, SCHEMA)


@pytest.mark.parametrize("pad", [0.0, 0.3])
def test_meeting_is_all_pairs_that_meet(tables, pad):
    one, other = tables[0], J.prefixed(tables[1], "p_", ["doc"])
    got = sorted((r.id, r.p_id) for r in meeting(one, other, "doc", extent(Box.of(), pad), extent(Box.of("p_"))).collect())
    want = sorted((a[1], b[1]) for a in A for b in B if good(a) and good(b) and a[0] == b[0] and a[2] - pad <= b[2] + b[4] and b[2] <= a[2] + a[4] + pad and a[3] - pad <= b[3] + b[5] and b[3] <= a[3] + a[5] + pad)
    assert set(got) == set(want) and len(got) == len(want) > 100


def test_containing_first_falls_back_to_the_nearest(spark, tables):
    points = spark.createDataFrame([(a[0], a[1], a[2], a[3]) for a in A] + [(5, 7777, 1e7, -1e7), (77, 1, 0.0, 0.0)], "doc long, id long, px double, py double")
    frames = tables[1].withColumn("ord", F.col("id") % 7)
    got = {(r.doc, r.id): (r.frame, r.inside) for r in J.containing_first(points, frames.withColumnRenamed("id", "frame"), "doc", "id", "frame", "ord").collect()}
    want = {}
    for d, i, x, y in [(a[0], a[1], a[2], a[3]) for a in A if good((*a[:4], 0.0, 0.0))] + [(5, 7777, 1e7, -1e7)]:
        best = []
        for b in B:
            if good(b) and b[0] == d:
                far = math.hypot(max(b[2] - x, 0, x - b[2] - b[4]), max(b[3] - y, 0, y - b[3] - b[5]))
                inside = b[2] <= x <= b[2] + b[4] and b[3] <= y <= b[3] + b[5]
                best.append(((not inside, 0.0 if inside else far, b[1] % 7, b[1]), (b[1], inside)))
        if best:
            want[d, i] = min(best)[1]
    assert got == want and {i for _, i in want.values()} == {True, False}


def test_joins_along_one_axis_and_anti(tables):
    one, other = tables
    hidden = {a[1] for a in A for b in B if good(a) and good(b) and a[0] == b[0] and b[4] and b[5] and (
        (max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) / (a[4] * a[5]) >= 0.5) if a[4] * a[5] > 0 else (b[2] <= a[2] and a[2] + a[4] <= b[2] + b[4] and b[3] <= a[3] and a[3] + a[5] <= b[3] + b[5]))}
    flat = other.filter("w > 0 AND h > 0")
    assert {r.id for r in J.covered_anti(one, flat, "doc", "id", share=0.5).collect()} == {a[1] for a in A} - hidden
    got = {(r.doc, r.id): r.v for r in J.nearest_by_x(one.filter("x < 1e9").select("doc", "id", F.col("x").alias("cx")), other.filter("x < 1e9").select("doc", F.col("id").alias("o"), F.col("x").alias("r_cx"), F.col("id").alias("v")), "doc", "id", 0.05, "v", "o", F.lit(-1)).collect()}
    some = lambda rows: [r for r in rows if r[0] is not None and r[2] is not None and r[2] < 1e9]
    for a in some(A):
        near = [b[1] for b in some(B) if b[0] == a[0] and abs(b[2] - a[2]) < 0.05]
        assert got[a[0], a[1]] == (min(near) if near else -1)


def test_one_document_of_100_000_boxes(spark):
    n, side = 100_000, 320
    grid = spark.range(n).select(F.lit(1).alias("doc"), F.col("id"), (10.0 * (F.col("id") % side)).alias("x"), (10.0 * F.floor(F.col("id") / side)).alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"))
    moved = grid.withColumns({"x": F.col("x") + 1, "w": F.when(F.col("id") == 0, 4000.0).otherwise(F.col("w"))})
    found = J.iou_pairs(grid, moved, "doc")
    assert found.filter("id = p_id").count() == n - 1 and found.count() == n - 1
    assert J.same_line_pairs(grid, "doc", "id", 3.0).count() == n - math.ceil(n / side)


def test_small_documents_meet_without_cells(spark, tables, monkeypatch):
    """Documents of few boxes and of many meet alike, side by side; without large documents each side is shuffled once, and grouping by document shuffles nothing more."""
    from annomill.operators import spatial

    one, other = tables[0], J.prefixed(tables[1], "p_", ["doc"])
    found, near = {}, {}
    points = one.select("doc", "id", F.col("x").alias("px"), F.col("y").alias("py"))
    for few in (0, 50, 1000):
        monkeypatch.setattr(spatial, "FEW", few)
        met = meeting(one, other, "doc", extent(Box.of()), extent(Box.of("p_")))
        found[few] = sorted((r.id, r.p_id) for r in met.collect())
        near[few] = sorted(map(tuple, J.containing_first(points, tables[1].withColumnRenamed("id", "frame"), "doc", "id", "frame", "frame").collect()))
    assert found[0] == found[50] == found[1000] and near[0] == near[50] == near[1000] and len(near[0]) > 200
    plan = met.groupBy("doc", "id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
