"""Average linkage by chains of nearest neighbours against the full search."""

import time

import numpy as np

from annomill.operators.trees import average_linkage


def plain(pairs, least):
    mean, members = {}, {}
    for i, j, p in pairs:
        mean[frozenset((i, j))] = mean.get(frozenset((i, j)), 0.0) + p
        members[i], members[j] = [i], [j]
    between = lambda a, b: sum(mean.get(frozenset((x, y)), 0.0) for x in members[a] for y in members[b]) / (len(members[a]) * len(members[b]))
    while True:
        best = max(((between(a, b), a, b) for a in members for b in members if a < b), default=(0, 0, 0))
        if best[0] <= least:
            return {k: a for a, m in members.items() for k in m}
        members[best[1]] += members.pop(best[2])


def test_linkage_is_the_full_search(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for d in range(40):
        n = int(rng.integers(2, 16))
        pairs = [(i, j, float(rng.random() ** 0.6)) for i in range(n) for j in range(n) if (i < j and rng.random() < 0.7) or (i > j and rng.random() < 0.1)]
        rows += [(d, *p) for p in pairs]
        want |= {(d, k): c for k, c in plain(pairs, 0.5).items()}
    rows.append((99, 7, 7, 0.9))
    found = average_linkage(spark.createDataFrame(rows, "doc long, i long, j long, p double").repartition(3), "doc", 0.5)
    assert {(r.doc, r.i): r.cluster for r in found.collect()} == want


def test_one_sketch_of_5000_strokes(spark):
    n = 5000
    rng = np.random.default_rng(3)
    rows = [(1, i, j, 0.9 - 0.01 * float(rng.random()) if i // 10 == j // 10 else 0.2 * float(rng.random())) for i in range(n) for j in range(i + 1, min(n, i + 25))]
    began = time.time()
    found = average_linkage(spark.createDataFrame(rows, "doc long, i long, j long, p double"), "doc").collect()
    assert {r.i: r.cluster for r in found} == {i: i - i % 10 for i in range(n)} and time.time() - began < 60
