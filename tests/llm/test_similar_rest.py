"""Near-duplicates that no trie meets are linked all the same: groups equal those of all pairs compared."""

import numpy as np

from annomill.llm import simhash


def sets_of(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_every_pair_at_the_similarity_is_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 16)  # many tries that each miss pairs, as with many texts
    rng, data, want = np.random.default_rng(5), [], set()
    common = [f"c{i}" for i in range(12)]
    for k in range(400):
        one = [*common, *(f"w{i}" for i in rng.integers(0, 5000, 120))]
        two, before = list(one), list(one)
        while len(sets_of(one) & sets_of(two)) >= 0.8 * len(sets_of(one) | sets_of(two)):
            before, two = two, list(two)
            two[int(rng.integers(12, len(two)))] = f"x{int(rng.integers(0, 5000))}"
        other = before if k % 2 else two  # just at the similarity, or just below
        data += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} if k % 2 else {2 * k, 2 * k + 1}
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert kept == want


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool[: n + 2], min(n, len(pool)), replace=False)) for _ in range(2))
        known = np.unique(rng.choice(pool, n))
        frequent = known, rng.integers(4, 9, len(known))
        if simhash.jaccard(a, b) >= 0.8:
            first = [simhash.first_shingles(x, 0.8, frequent) for x in (a, b)]
            assert len(np.intersect1d(*first))
