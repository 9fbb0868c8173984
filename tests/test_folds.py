"""Folds over sorted rows against plain loops, with nulls and ties, and on one document of a million rows."""

import time

import numpy as np
from pyspark.sql import functions as F

from annomill.operators import layouts as L
from annomill.operators import windows as W

RNG = np.random.default_rng(9)
ROWS = [(d, k, *(float(v) if RNG.random() > 0.04 else None for v in RNG.integers(0, 60, 2)), *(float(v) if RNG.random() > 0.04 else None for v in RNG.integers(1, 20, 2))) for d in [*range(12), None] for k in range(int(RNG.integers(1, 40)))]
SCHEMA = "doc int, id int, x double, y double, w double, h double"
LOW = lambda v: (v is not None, v or 0.0)


def documents():
    return {d: [r for r in ROWS if r[0] == d] for d in {r[0] for r in ROWS}}


def plain_bands(rows):
    out, band, reach = {}, -1, float("-inf")
    for r in sorted(rows, key=lambda r: (LOW(r[3]), r[1])):
        hi = None if r[3] is None or r[5] is None else r[3] + r[5]
        if r[3] is not None and r[5] is not None and reach - r[3] <= 0.15 * r[5]:
            band, reach = band + 1, hi
        else:
            band, reach = max(band, 0), reach if hi is None else max(reach, hi)
        out[r[1]] = band
    return {k: (v, band + 1) for k, v in out.items()}


def plain_rows(rows):
    out, row, y0, y1 = {}, -1, 0.0, 0.0
    for r in sorted(rows, key=lambda r: (LOW(r[3]), LOW(r[2]), r[1])):
        y, h = r[3], r[5]
        if y is None or h is None:
            row = max(row, 0)
        elif row >= 0 and min(y1, y + h) - max(y0, y) > 0.5 * min(h, y1 - y0):
            y0, y1 = min(y0, y), max(y1, y + h)
        else:
            row, y0, y1 = row + 1, y, y + h
        out[r[1]] = row
    return out


def plain_turns(rows):
    ys = [r[3] for r in sorted(rows, key=lambda r: r[1]) if r[3] is not None]
    turns, sign, anchor = 0, 0, ys[0] if ys else None
    for y in ys[1:]:
        d = y - anchor
        way = (d > 0) - (d < 0)
        if abs(d) >= 7:
            turns += sign not in (0, way)
            sign, anchor = way, y
        elif way == sign and sign:
            anchor = y
    return turns


def test_folds_are_plain_loops(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumn("bottom", F.col("y") + F.col("h"))
    by = lambda found, *c: {(r.doc, r.id): tuple(r[x] for x in c) if len(c) > 1 else r[c[0]] for r in found.collect()}
    docs = documents()
    assert by(W.bands(df, "doc", "id", "y", "bottom", 0.15 * F.col("h"), ["w"]), "band", "n_bands") == {(d, k): v for d, rows in docs.items() for k, v in plain_bands(rows).items()}
    assert by(W.row_group(df, "doc", "id"), "row") == {(d, k): v for d, rows in docs.items() for k, v in plain_rows(rows).items()}
    assert {r.doc: r.turns for r in W.direction_turns(df, ["doc"], "id", F.lit(7.0)).collect()} == {d: plain_turns(rows) for d, rows in docs.items()}
    empty = df.limit(0)
    assert W.bands(empty, "doc", "id", "y", "bottom", F.lit(0.0)).count() == W.row_group(empty, "doc", "id").count() == W.direction_turns(empty, ["doc"], "id", F.lit(1.0)).count() == L.line_group(empty, "doc", "id").count() == 0


def test_lines(spark):
    words = [(1, k, float(x), float(y), 5.0, 10.0) for k, (x, y) in enumerate([(0, 0), (9, 4), (20, 5), (0, 12), (5, 17)])] + [(1, 9, 0.0, None, 1.0, 10.0)]
    got = {r.id: r.line for r in L.line_group(spark.createDataFrame(words, SCHEMA), "doc", "id").collect()}
    assert got == {9: 0, 0: 1, 1: 1, 2: 1, 3: 2, 4: 2}


def test_a_million_rows_in_one_document(spark):
    one = lambda n: spark.range(n).select(F.lit(1).alias("doc"), F.col("id"), F.lit(0.0).alias("x"), (10.0 * F.floor(F.col("id") / 3)).alias("y"), F.lit(8.0).alias("h"))
    took = []
    for n in (100_000, 1_000_000):
        began = time.time()
        assert W.row_group(one(n), "doc", "id").agg(F.max("row")).first()[0] == (n - 1) // 3
        took.append(time.time() - began)
    assert took[1] < 30 * max(took[0], 1)
    t = one(1_000_000).withColumn("bottom", F.col("y") + F.col("h"))
    assert W.bands(t, "doc", "id", "y", "bottom", 0.15 * F.col("h")).agg(F.max("band")).first()[0] == 333_333
    assert W.direction_turns(t, ["doc"], "id", F.lit(5.0)).first()["turns"] == 0
