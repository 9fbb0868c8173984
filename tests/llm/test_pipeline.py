"""The pipeline on a small table, stage by stage, against brute force."""

from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from annomill.llm import decontam, tokens
from annomill.llm.common import stored

SF = "/root/testdata/sf0.001"


def plain_lines(texts):
    """Texts by id with later occurrences of three-line windows left out; the first is that of the least id."""
    first, gone = {}, defaultdict(set)
    for d in sorted(texts):
        lines = (texts[d] or "").split("\n") if texts[d] is not None else []
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip(" ") and first.setdefault(window, (d, i)) != (d, i):
                gone[d] |= {i, i + 1, i + 2}
    return {d: t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts.items()}


def plain_near(texts):
    """The least id of each component of texts whose five-word shingles have a similarity of 0.8."""
    sets = {}
    for d, t in texts.items():
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (t or "").encode().split()]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in texts if find(d) == d}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [decontam.text_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        now = {r.doc_id: r.text for r in rows}
        assert docs.columns == columns and len(now) == len(rows)
        if name == "toxicity":
            judged = [(d in now) != bool(t) for d, t in labels.items() if d in texts and t is not None]
            assert sum(judged) >= 0.9 * len(judged) and all(texts[d] == t for d, t in now.items())
        elif name == "line_dedup":
            assert now == plain_lines(texts) and all(r.n_chars == len(r.text) for r in rows if now[r.doc_id] != texts[r.doc_id])
        elif name == "simhash":
            assert set(now) == plain_near(texts)
        else:
            found = set()
            for d, t in texts.items():
                words = decontam.text_words(t or "")
                grams = {words[i : i + 4].tobytes() for i in range(len(words) - 3)}
                for sought in items:
                    if len(sought) >= 4 and any(sought[i : i + 4].tobytes() in grams for i in range(len(sought) - 3)) and decontam.align(sought, words)[0] >= 0.5 * len(sought):
                        found.add(d)
            assert set(texts) - set(now) == found and found
        texts = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(int)
    for r in packed:
        got[r.doc_id] += r.length
    assert got == {d: len(encoder.whole(t or "")) // 2 + 1 for d, t in texts.items()}


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    long = " ".join(f"w{i % 977}x{i % 53}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, "one line"), (4, "one line"), (None, "no id"), (None, None), (5, "a\nb\nc\nd"), (6, "a\nb\nc\ne"), (7, "  \n\t ")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "toxicity", "near_id", "near_mark", "later_id", "leak_id", "fp", "h", "shard"):
        odd = odd.withColumn(c, F.lit("x"))
    odd = odd.withColumn("n_chars", F.char_length("text").cast("long"))
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), name)
            assert docs.columns == columns
        left = [(r.doc_id, r.text) for r in docs.collect()]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        if left:
            # the empty texts (1, 2, 7 and one without an id) are one group
            assert sorted(left, key=repr) == sorted([(1, None), (3, long), (4, "one line"), (None, "no id"), (5, "a\nb\nc\nd"), (6, "e")], key=repr)
            assert {r.doc_id for r in packed} == {d for d, _ in left}
        else:
            assert packed == []


def test_all_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
