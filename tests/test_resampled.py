"""Equally spaced points of lines are made where the points are: no row is made for each of them before a join."""

import math
import random

from annomill.operators import features, windows


def _by_hand(line, n):
    ends = [0.0]
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        ends.append(ends[-1] + math.hypot(x1 - x0, y1 - y0))
    out = []
    for i in range(n):
        at = min(ends[-1] * i / (n - 1), ends[-1])
        k = next((k for k in range(1, len(line)) if ends[k - 1] < ends[k] and ends[k - 1] <= at <= ends[k]), None)
        share = 0 if k is None else (at - ends[k - 1]) / (ends[k] - ends[k - 1])
        a, b = (line[0], line[0]) if k is None else (line[k - 1], line[k])
        out.append((a[0] + share * (b[0] - a[0]), a[1] + share * (b[1] - a[1])))
    return out


def test_resampled_lines_without_a_join(spark):
    rng = random.Random(3)
    lines = [[(float(rng.randint(0, 4)), float(rng.randint(0, 3))) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(k, s, x, y) for k, line in enumerate(lines) for s, (x, y) in enumerate(line)]
    points = spark.createDataFrame(rows, "sketch_id long, stroke_id long, x double, y double").selectExpr("sketch_id AS doc", "sketch_id AS s", "stroke_id AS seq", "x", "y")
    even = windows.resample(points, ["doc", "s"], "seq", 9)
    plan = even._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1
    got = {(r.s, r.i): (r.x, r.y) for r in even.collect()}
    assert len(got) == 9 * len(lines) == even.count()
    shapes = {r.s: r.shape for r in features.stroke_shape(points, 9, "doc", "s").collect()}
    for k, line in enumerate(lines):
        wanted = _by_hand(line, 9)
        assert all(math.dist(got[k, i], wanted[i]) < 1e-9 for i in range(9))
        mx, my = (sum(p[c] for p in wanted) / 9 for c in (0, 1))
        assert all(math.dist(shapes[k][i][:2], (wanted[i][0] - mx, wanted[i][1] - my)) < 1e-9 for i in range(9))
