"""Benchmark decontamination: rare n-grams as seeds, then Smith-Waterman alignment of words.

Words are lower-case runs of letters and digits. An n-gram of an item is a seed where it is the rarest of a stretch of the
item just long enough for the score, ties included; rarity is the number of different item texts that hold it. So each
stretch that could reach the score has its rarest n-grams as seeds, a phrase that many items share is none where a stretch
has anything rarer, and a document is judged the same in a corpus of any size. A copy of which no seed is left unedited,
only what is commoner among the items, is not found. A Bloom filter of the seeds (2^28 bits at most) goes to every task,
so only n-grams of documents that may be seeds become rows; an n-gram's places in a zone of a document (1,024 words) become
one row before the join. Documents and items that share an n-gram are aligned zone by
zone: over the stretch that the item would fill around the zone's seeds, and an item's length more on either side, which no
alignment of the score leaves. So a far stray seed doesn't make a whole text be read. Where the words there are too few of the
item's for the score nothing is aligned. The best local alignment scores 1 for a match and -1/2
for a mismatch or gap, and the score over the item's number of words tells a copy, edited or not. A copy without n words in
a row left unedited has no seed and is not found. A text is read once for each 64 items that it meets.

An item of fewer than n words is seeded by its whole sequence; one of none matches nothing. Null text is empty. Rows equal
in doc_id and text get the same pairs, once a row; the same holds for items. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, fresh, pieces, raw, stored
from .textkit import window_hashes, word_hashes, word_spans

U = np.uint64
PIECE = 1 << 19
#: Least and most bits of the Bloom filter as powers of two; items that one row of a document brings to be aligned.
BLOOM, TOGETHER = (20, 28), 64
#: Words of a document that are one zone, and slots of the table of documents to fetch, which bounds its size.
ZONE, SLOTS = 1024, 1 << 20
#: Each byte as it counts: letters and digits lowered, all else white space; bytes of other letters as they are.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], np.uint8)


def text_words(text: str) -> np.ndarray:
    """Hashes of the words of one text."""
    data = BYTES[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def grams(column: pa.Array, n: int, lengths: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place of the first word, hash, words of the row) of n-grams. lengths: of all n-grams asked for; None: n, or the whole of a shorter text."""
    data, at = raw(column)
    for i, j in pieces(at, PIECE):
        starts, ends, counts = word_spans(BYTES[data[at[i] : at[j]]], at[i : j + 1] - at[i])
        words = word_hashes(BYTES[data[at[i] : at[j]]], starts, ends)
        row = np.repeat(np.arange(j - i), counts)
        first = np.cumsum(counts) - counts
        for length in lengths or range(1, n + 1):
            if len(words) < length:
                continue
            h = window_hashes(words, length)
            whole = row[: len(h)] == row[length - 1 :]
            if lengths is None and length < n:
                whole &= counts[row[: len(h)]] == length
            k = np.flatnonzero(whole)
            yield i + row[k], k - first[row[k]], h[k] + U(length), counts[row[k]]


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item, mark, place, h, words) of the items' seeds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, place, h, words in grams(b.column(2), n, None):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(place), pa.array(h.view(np.int64)), pa.array(words)], names=["item", "mark", "place", "h", "words"])

    return items.mapInArrow(work, "item long, mark long, place long, h long, words long")


def rare(places: DataFrame, n: int, least: float) -> DataFrame:
    """(item, mark, place, h, words) of item_grams' rows that are seeds: rarest among the items in some stretch that could reach the score.

    A score of least asks for that share of the item's words, so for a stretch of so many; ties are all kept. An item is one row of work.
    """
    texts = places.groupBy("h").agg(F.count_distinct("mark").alias("texts"))
    listed = places.join(texts.hint("merge"), "h").groupBy("item", "mark").agg(F.max("words").alias("words"), F.array_sort(F.collect_list(F.struct("place", "texts", "h"))).alias("g"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(3)
            at, (place, texts, h) = column.offsets.to_numpy() - column.offsets[0].as_py(), (x.to_numpy() for x in column.flatten().flatten())
            rows, kept = [], []
            for k, count in enumerate(b.column(2).to_pylist()):
                often = texts[at[k] : at[k + 1]].astype(float)
                width = min(len(often), max(1, math.ceil(least * count - 1e-9) - n + 1))
                lowest = pd.Series(often).rolling(width).min().to_numpy()[width - 1 :]
                around = np.pad(lowest, width - 1, constant_values=0)
                chosen = np.flatnonzero(often <= pd.Series(around).rolling(width).max().to_numpy()[width - 1 :]) + at[k]
                rows += [k] * len(chosen)
                kept.append(chosen)
            take, of = np.concatenate(kept) if kept else np.zeros(0, int), pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(place[take]), pa.array(h[take]), b.column(2).take(of)], names=["item", "mark", "place", "h", "words"])

    return listed.mapInArrow(work, "item long, mark long, place long, h long, words long")


def _bloom(seeds: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The filter, its size as a power of two (about 16 bits a seed), and the lengths of n-grams in use (at most n)."""
    size = min(max(BLOOM[0], (16 * seeds.count()).bit_length()), BLOOM[1])
    slots = F.explode(F.array(*(F.shiftrightunsigned("h", k).bitwiseAND((1 << size) - 1) for k in (0, 32))))
    words = seeds.select(slots.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS INT)))").alias("bits"))
    out = np.zeros(1 << (size - 6), np.int64)
    found = words.toArrow()  # 2^22 rows at most
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(U), size, [r["n"] for r in seeds.select(F.col("length").alias("n")).distinct().collect()]


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the end places (exclusive) in item and words."""
    ramp, before, best, end = 0.5 * np.arange(len(words) + 1), np.zeros(len(words) + 1), 0.0, (0, 0)
    for i, w in enumerate(item):
        now = np.zeros(len(words) + 1)
        np.maximum(before[:-1] + np.where(words == w, 1.0, -0.5), before[1:] - 0.5, out=now[1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp) - ramp
        k = int(now.argmax())
        if now[k] > best:
            best, end = float(now[k]), (i + 1, k)
        before = now
    return best, *end


def merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending regions, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(regions):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, *, n: int = 4, least: float = 0.5) -> DataFrame:
    """(doc_id, mark, item_id, score, first_word, last_word) of documents that hold an item, whole or edited; mark is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    seeds = stored(rare(stored(item_grams(items, n), "grams"), n, least).withColumn("length", F.least("words", F.lit(n))), "seeds")
    bits, size, lengths = _bloom(seeds)
    bloom = docs.sparkSession.sparkContext.broadcast(bits)
    slot = U((1 << size) - 1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for b in batches:
            for row, place, h, _ in grams(b.column(2), n, lengths) if lengths else ():
                s, t = h & slot, (h >> U(32)) & slot
                hit = (known[s >> U(6)] >> (s & U(63))) & (known[t >> U(6)] >> (t & U(63))) & U(1)
                k = np.flatnonzero(hit)
                if len(k):
                    rows = pa.array(row[k])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(place[k]), pa.array(h[k].view(np.int64))], names=["doc_id", "mark", "at", "h"])

    hits = stored(docs.mapInArrow(look, "doc_id long, mark long, at long, h long"), "hits")
    spans = stored(hits.groupBy("doc_id", "mark", "h", F.floor(F.col("at") / ZONE).alias("zone")).agg(F.min("at").alias("first"), F.max("at").alias("last")), "spans")
    chosen = seeds.select("h", "item", F.col("mark").alias("item_mark"), "place", "words")
    low, high = F.min(F.col("first") - F.col("place")), F.max(F.col("last") - F.col("place") + F.col("words"))
    zones = spans.join(chosen.hint("merge"), "h").groupBy("doc_id", "mark", "item", "item_mark", "zone").agg(low.alias("low"), high.alias("high"), F.max("words").alias("words"))
    pairs = zones.groupBy("doc_id", "mark", "item", "item_mark").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("regions"), F.max("words").alias("words"))
    texts = items.select(F.col("item").alias("id"), F.col("mark").alias("of"), F.col("text").alias("item_text"))
    with_item = pairs.join(texts.hint("merge"), F.col("item").eqNullSafe(F.col("id")) & (F.col("item_mark") == F.col("of")))
    place = F.floor((F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("item", "item_mark")) - 1) / TOGETHER)
    group = [F.col("doc_id").alias("in_doc"), F.col("mark").alias("in_mark"), "several"]
    wanted = with_item.withColumn("several", place).groupBy(*group).agg(F.collect_list(F.struct(F.col("item").alias("item_id"), "item_text", "regions", "words")).alias("sought"))
    wanted = stored(wanted, "wanted")
    slot_of = lambda d, m: F.pmod(F.xxhash64(d, m), F.lit(SLOTS)).cast("int").alias("slot")
    #: texts without a hit stay where they are: the broadcast table has SLOTS rows at most
    near = docs.withColumn("slot", slot_of("doc_id", "mark")).join(F.broadcast(wanted.select(slot_of("in_doc", "in_mark")).distinct()), "slot", "left_semi").drop("slot")
    found = near.join(wanted.hint("merge"), near["doc_id"].eqNullSafe(F.col("in_doc")) & (near["mark"] == F.col("in_mark"))).select("doc_id", "mark", "text", "sought")
    schema = "doc_id long, mark long, item_id long, score double, first_word long, last_word long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, mark, text, several in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = text_words(text)
                for x in several:
                    slack, sought, best = max(2, x["words"]), text_words(x["item_text"]), None
                    for region in merged([(max(0, r["low"] - slack), r["high"] + slack) for r in x["regions"]]):
                        words = whole[region[0] : region[1]]
                        if np.isin(sought, words).sum() < least * len(sought):  # no more words than these can match
                            continue
                        score, i, j = align(sought, words)
                        if score >= least * len(sought) and (best is None or score > best[0]):
                            _, _, back = align(sought[:i][::-1], words[:j][::-1])
                            best = (score, region[0] + j - back, region[0] + j - 1)
                    if best:
                        rows.append((doc, mark, x["item_id"], best[0] / len(sought), *best[1:]))
            if rows:
                yield batch(schema, **dict(zip(("doc_id", "mark", "item_id", "score", "first_word", "last_word"), zip(*rows, strict=True), strict=True)))

    return found.mapInArrow(work, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold an item."""
    own, mark = fresh(docs, "leak_id"), fresh(docs, "leak_mark")
    bad = stored(matches(docs, benchmark, **options).select(F.col("doc_id").alias(own), F.col("mark").alias(mark)).distinct(), "leaks")
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(mark)), "left_anti")
