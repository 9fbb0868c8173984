"""Importance resampling against a plain version: nulls, ties, repeated rows, very long words, empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from annomill.llm import resampling
from annomill.llm.queries import QUERIES


def features(text, longest=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, buckets=10_000, percent=5, least=20, seed=42):
    """(doc_id, n_features, weight, score, rank) of all rows."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    have = [features(t) for _, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, f in have:
        for x in f:
            s[bucket(x)] += 1
    for text in target:
        for x in features(text)[1]:
            t[bucket(x)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (d, _), (n, f) in zip(docs, have, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


RNG = np.random.default_rng(7)
WORDS = ["The", "of", "É", "naïve", "x9", "日本", "a" * 700, "long" * 40, "don't", "UPPER", "mixed-Case", "0", " ", "z"]
DOCS = [(i, " ".join(RNG.choice(WORDS, int(RNG.integers(0, 60))))) for i in range(300)]
DOCS += [(1000, None), (1001, ""), (None, "one two three " * 9), (1002, " ".join(RNG.choice(WORDS, 9000))), (5, "same row " * 20), (5, "same row " * 20), (1003, "...,;"), (1004, "\x00a\x7fb")]
TARGET = ["The naïve x9 of z", None, "", "don't mixed-Case UPPER 0"]


def same(found, docs, target, **more):
    want = sorted(plain(docs, target, **more), key=repr)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("buckets, block", [(10_000, None), (7, 50)])
def test_resample(spark, monkeypatch, buckets, block):
    if block:
        monkeypatch.setattr(resampling, "PIECE", 900)
    schema = "doc_id long, text string, score string, n_words int, other string"
    docs = spark.createDataFrame([(d, t, "s", 1, "kept") for d, t in DOCS], schema).repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resampling.resample(docs, target, buckets=buckets, percent=20)
    assert set(found.columns) == {"doc_id", "text", "other", "n_words", "n_features", "weight", "score", "rank"}
    same(found, DOCS, TARGET, buckets=buckets, percent=20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    same(resampling.resample(docs, none.select("text")), DOCS, [])
    assert resampling.resample(none, none.select("text")).count() == 0


def test_blocks_and_matrices_are_those_of_zlib():
    text = " ".join(RNG.choice(WORDS, 3000)).encode() + b" " + b"w" * 5000
    low, starts, ends, _ = resampling.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got = resampling.crcs(low, starts, ends - starts)
    assert got.tolist() == [zlib.crc32(low[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    whole = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    one = sorted(b for _, x in resampling.features(*whole, 97) for b in x)
    before, resampling.BLOCK = resampling.BLOCK, 11
    try:
        assert sorted(b for _, x in resampling.features(*whole, 97) for b in x) == one
    finally:
        resampling.BLOCK = before


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(QUERIES["op13_importance_resampling"](spark, sf), docs, target)
