"""Each document whose id is divisible by 100 is searched for among all documents, by its whole text."""

import numpy as np
import pytest

from annomill.llm import packing

ID = "doc_id long, ids binary"


def table(spark, blobs):
    """Rows, how many have each id, how many there are, their mean length."""
    _, term, _, lengths = packing._terms([b for _, b in blobs])
    return spark.createDataFrame(blobs, ID).repartition(5), np.bincount(term, minlength=1 << 16), len(blobs), float(lengths.mean())


def blob(*ids):
    return np.concatenate(ids).astype("<u2").tobytes()


def test_every_id_divisible_by_100_shares_a_shard_with_its_neighbour(spark):
    rows = []
    for k in range(700):  # more than 512 texts of which no two pairs share an id
        own = np.arange(40 * k, 40 * k + 40)
        rows += [(100 * k, blob(own)), (100 * k + 1, blob(own[:39], own[:1]))]
        rows += [(100 * k + j, blob([30_000 + 50 * k + j])) for j in range(2, 51)]
    tokens, df, n, mean = table(spark, rows)
    shard = {r.doc_id: r.shard for r in packing.route(tokens, df, n, mean, 0.05, n // 7).collect()}
    assert len(shard) == n and len(set(shard.values())) in (7, 8)
    assert sum(shard[100 * k] == shard[100 * k + 1] for k in range(700)) >= 693  # a shard's end may come between two


def test_what_stands_far_behind_in_a_text_counts(spark):
    head = np.arange(30_000, 40_000)
    rows = [(k, blob(head, np.arange(20 * (k % 40), 20 * (k % 40) + 20))) for k in range(80)]
    tokens, df, n, mean = table(spark, rows)
    df[30_000:40_000] = n * 50  # stop terms
    shard = {r.doc_id: r.shard for r in packing.route(tokens, df, n * 100, mean, 0.05, n * 100 // 8).collect()}
    assert len(set(shard.values())) == 8 and sum(shard[k] == shard[k + 40] for k in range(40)) >= 33


@pytest.mark.parametrize("block", [7, 1 << 13])
def test_searches_find_the_best_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(k, blob(rng.zipf(1.3, int(rng.integers(1, 60))) % 900)) for k in range(900)]
    rows += [(None, rows[100][1]), (901, b"")]
    tokens, df, n, mean = table(spark, rows)
    known, pivots, best = packing.searched(tokens, df, n, mean, 1.0)
    assert len(known) >= 512
    index = packing.Index([b for _, b in rows], df, n, mean, 1.0)
    at = {h.h: h.ids for h in tokens.selectExpr("xxhash64(ids) h", "ids").distinct().collect()}
    found = {}
    for r in best.collect():
        found.setdefault(r.pivot, []).append(r.score)
    pivot = {bytes(at[h]): k for k, h in enumerate(known.tolist())}
    for k in range(0, 900, 100):
        s = index.scores(k)
        s[[i for i, (_, b) in enumerate(rows) if b == rows[k][1]]] = 0
        want = np.sort(s[s > 0])[::-1][: packing.BEST]
        assert np.allclose(sorted(found.get(pivot[rows[k][1]], []), reverse=True), want)


def test_copies_of_one_text_have_a_pivot_whatever_their_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIVOTS", 2)
    monkeypatch.setattr(packing, "EVERY", 7)
    for k in range(3):  # hashes of which some aren't divisible
        rows = [(7 * i, blob([k, k + 1])) for i in range(30)]
        tokens, df, n, mean = table(spark, rows)
        found = packing.route(tokens, df, n, mean, 1.0, 10).collect()
        assert sorted(r.doc_id for r in found) == [d for d, _ in rows] and {r.shard for r in found} == {0, 1, 2}
