"""Language identification: code lengths against a plain context tree, odd rows, accuracy on rows held out."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annomill.llm import langid
from annomill.llm.queries import QUERIES


def plain_lengths(learn: list[str], text: str, order: int = 4) -> float:
    """Bits of the text by method C over byte contexts of at most `order` bytes, trained on the texts."""
    after = defaultdict(Counter)
    lower = lambda t: bytes(order) + bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    for t in map(lower, learn):
        for i in range(order, len(t)):
            for k in range(order + 1):
                after[t[i - k : i]][t[i]] += 1
    bits, t = 0.0, lower(text)
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            seen = after.get(t[i - k : i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if t[i] in seen:
                bits -= math.log2(seen[t[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8.0
    return bits


ONE = ["The cat sat on the mat.", "that is the thing", "", "aaaa the"]
TWO = ["Der Hund und die Katze", "das ist schön und grün"]
LEARN = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "one") for t in ONE), *((t, "two") for t in TWO), ("nobody knows", None), (None, "two"), ("x" * 70_000, "three")])]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(LEARN, "doc_id long, text string, lang string"))


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_code_lengths(model, monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    assert model.names == ["one", "two"]  # a text beyond `longest` isn't learnt from
    texts = ["the cat", "", "und GRÜN", "Zebra 日本", "that Hund", "q"]
    data = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(x) for x in data]))
    got = model.lengths(np.frombuffer(b"".join(data), np.uint8), at)
    want = np.array([[plain_lengths(ONE, t), plain_lengths(TWO, t)] for t in texts])
    assert np.allclose(got, want)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 ... !"), (4, "the thing"), (4, "the thing"), (None, "und die"), (5, "日本"), (6, "the cat " * 20_000), (7, "\n\t ²")]
    docs = spark.createDataFrame([(d, t, "x", "kept") for d, t in rows], "doc_id long, text string, score string, letters string")
    got = {(r.doc_id, r.text): (r.lang_pred, r.score, r.letters) for r in langid.predict(docs, model).collect()}
    assert got[1, None][:2] == got[2, ""][:2] == got[3, "12 34 ... !"][:2] == got[7, "\n\t ²"][:2] == ("und", 0.0)
    assert got[4, "the thing"][0] == got[6, rows[7][1]][0] == "one" and got[None, "und die"][0] == "two"
    assert got[5, "日本"][0] in ("one", "two") and all(0 <= s <= 1 and k == "kept" for _, s, k in got.values())
    assert langid.predict(docs, model).count() == len(rows)


def test_nothing_to_learn_and_empty_tables(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(none)
    assert langid.predict(spark.createDataFrame([(1, "the")], "doc_id long, text string"), empty).first()["lang_pred"] == "und"


def test_query_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op12_language_id"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.col("text").isNull().alias("gone")), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang is not None and not r.gone]
    for lang in {r.lang for r in held}:
        of = [r for r in held if r.lang == lang]
        assert sum(r.lang_pred == lang for r in of) >= 0.97 * len(of), lang
