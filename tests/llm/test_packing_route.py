"""Shards of a large table are cut by the sizes that its cells have."""

from collections import Counter

import numpy as np

from annomill.llm import packing


def test_shards_are_cut_by_counts_of_all_documents(spark):
    docs = [(k, np.arange(20 * k, 20 * k + 20, dtype="<u2").tobytes()) for k in range(40)]  # no two share an id, so each is a cell
    tokens = spark.createDataFrame(docs, "doc_id long, ids binary")
    found = packing.route(tokens, np.ones(1 << 16, np.int64), 4_000_000, 20.0, 0.05, 400_000).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == docs
    assert sorted(Counter(r.shard for r in found)) == list(range(10)) and max(Counter(r.shard for r in found).values()) <= 8


def test_terms_and_cells_do_not_depend_on_how_many_documents_are_taken_together():
    rng = np.random.default_rng(8)
    blobs = [rng.integers(0, 1 << 16, int(n)).astype("<u2").tobytes() for n in rng.integers(0, 40, (1 << 16) + 9)]
    doc, term, times, lengths = packing._terms(blobs)
    assert len(lengths) == len(blobs) and int(doc[-1]) >= 1 << 16 and times.sum() == lengths.sum()
    k = 777
    own = packing._terms([blobs[k]])
    assert (term[doc == k] == own[1]).all() and (times[doc == k] == own[2]).all()
    df = np.bincount(term, minlength=1 << 16)
    pivots = packing.Pivots(blobs[:64], df, len(blobs), float(lengths.mean()), 0.05)
    few = blobs[: 2 * packing.TOGETHER + 7]
    assert (pivots.cells(few) == [pivots.cells([b])[0] for b in few]).all() and not len(pivots.cells([]))
