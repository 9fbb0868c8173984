"""Very many small groups share a batch: none is a pandas call of its own."""

import random

from annomill.operators import aggregates as A
from annomill.operators import layouts as L


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_ends_and_farthest_pairs_of_small_and_large_groups(spark):
    rng, rows = random.Random(3), [(900, 1, None, 1.0, True), (900, 2, 1.0, None, True), (901, 1, 0.0, 0.0, True), (901, 2, None, 5.0, True), (901, 3, 3.0, 4.0, True)]
    for g in range(60):
        rows += [(g, k, float(rng.randint(0, 30)), float(rng.randint(0, 30 if g % 5 else 0)), k % 3 == 0) for k in range(rng.choice([1, 2, 5, 24, 25, 60]))]
    far, ends = {}, {}
    for g in {r[0] for r in rows}:
        p = [r[1:] for r in rows if r[0] == g and r[2] is not None and r[3] is not None]
        best = max((((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, -a[0], -b[0]) for a in p for b in p if a[0] < b[0]), default=None)
        if best:
            far[g] = (-best[1], -best[2], best[0])
            a, b = (next(r[1:3] for r in p if r[0] == -k) for k in best[1:])
            near = lambda q: sum(((r[1] - q[0]) ** 2 + (r[2] - q[1]) ** 2) ** 0.5 < 0.2 * best[0] ** 0.5 for r in p if r[3])  # noqa: B023, E731
            ends[g] = (*b, *a) if near(a) > near(b) else (*a, *b)
    df = spark.createDataFrame(rows, "g int, k int, x double, y double, is_end boolean")
    pairs, arrows = A.farthest_pair(df, ["g"], "k"), L.arrow_ends(df, ["g"], "k")
    assert {r.g: (r.i, r.j, r.d2) for r in pairs.collect()} == far
    assert {r.g: (r.tx, r.ty, r.hx, r.hy) for r in arrows.collect()} == ends
    assert "InPandas" not in _plan(pairs) + _plan(arrows)


def _simplified(p, most):
    if len(p) < 3:
        return 0
    (ax, ay), (bx, by) = p[0], p[-1]
    span = max(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5, 1e-12)
    away = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / span for x, y in p[1:-1]]
    k = away.index(max(away)) + 1
    return 1 + _simplified(p[: k + 1], most) + _simplified(p[k:], most) if away[k - 1] > most else 0


def test_corners_of_small_and_large_groups(spark):
    rng, rows = random.Random(4), []
    for g in range(40):
        rows += [(g, k, float(rng.randint(0, 30)), float(rng.randint(0, 30)), float(g % 7)) for k in range(rng.choice([1, 2, 5, 33, 90]))]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double, most double")
    found = L.polyline_corners(df, ["g"], "k", "most")
    assert {r.g: r.corners for r in found.collect()} == {g: _simplified([r[2:4] for r in rows if r[0] == g], g % 7) for g in range(40)}
    assert "InPandas" not in _plan(found)


def test_connected_documents_share_batches(spark):
    from annomill.operators.trees import connected

    rng = random.Random(5)
    nodes = [(d, k) for d in range(50) for k in range(rng.choice([1, 2, 40]))]
    size = {d: sum(1 for n in nodes if n[0] == d) for d in range(50)}
    pairs = [(d, *sorted(rng.sample(range(size[d]), 2))) for d in range(50) if size[d] > 1 for _ in range(size[d] // 2)]
    want = {n: n[1] for n in nodes}
    for _ in range(50):
        for d, a, b in pairs:
            want[d, a] = want[d, b] = min(want[d, a], want[d, b])
    found = connected(spark.createDataFrame(pairs, "d int, a int, b int"), spark.createDataFrame(nodes, "d int, k int"), "d", "k")
    assert {(r.d, r.k): r.component for r in found.collect()} == want
    assert "InPandas" not in _plan(found)
