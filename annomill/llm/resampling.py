"""Importance resampling towards a target: hashed word n-grams of documents and target texts, and a draw with Gumbel noise.

Words are runs of ASCII letters, digits and bytes above 0x7F after lower-casing A-Z alone; features are all runs of one to
three words. A feature's bucket is the CRC-32 of its bytes modulo the number of buckets. Within a block of words equal
features are found by their words' numbers, which are exact, and each distinct one is hashed once: features of equal
length form a two-dimensional uint8 array, whose CRCs are all updated column by column, and the buckets are scattered back
to the places the features came from. (The few features longer than `WIDE` bytes go through zlib, one by one.)

gains: each task adds up its own buckets, so a corpus's counts are a row per bucket and task; the two tables of at most
`buckets` counts reach the driver, and their log ratios go to the tasks. weigh: a second pass over the texts adds the gains;
nothing of the texts is written or shuffled. resample: rows with enough words are numbered by descending score, range by
range, so no task sorts all of them.

Null and empty texts have no features and weight 0. Equal scores go to the smaller doc_id (null first, hashed as an empty
string), rows equal in both to the one with fewer features. An empty target or an empty table of documents counts as zero
features. Columns of the names added are replaced, all others kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from annomill.operators.windows import numbered

from .common import batch, pieces, raw, stored

#: Words of a block, bytes of a piece of rows, bytes of a matrix, and the longest features that stand in one.
BLOCK, PIECE, MATRIX, WIDE = 400_000, 4_000_000, 4_000_000, 512


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


TABLE = _crc_table()


def crcs(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges, one matrix for each length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(lengths[order], prepend=-1)), len(order))
    for a, b in zip(edges, edges[1:], strict=False):
        size = int(lengths[order[a]])
        if size > WIDE:
            for i in order[a:b]:
                out[i] = zlib.crc32(text[starts[i] : starts[i] + size])
            continue
        views = np.lib.stride_tricks.sliding_window_view(text, size)
        for lo in range(a, b, step := max(1, MATRIX // size)):
            at = order[lo : min(b, lo + step)]
            columns = np.ascontiguousarray(views[starts[at]].T)
            crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
            for c in columns:
                crc = TABLE[(crc ^ c) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[at] = ~crc
    return out


def words(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, where each word starts and ends, and its row."""
    low = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = (low >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122))
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return low, starts, ends, np.searchsorted(at, starts, "right") - 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's number among the distinct ones, and a place of each distinct one."""
    kept = pa.array(keys).dictionary_encode()
    numbers = kept.indices.to_numpy()
    place = np.empty(len(kept.dictionary), np.int64)
    place[numbers] = np.arange(len(keys))
    return numbers, place


def features(text: np.ndarray, at: np.ndarray, buckets: int, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features, block by block."""
    low, starts, ends, rows = words(text, at)
    for i in range(0, len(starts), BLOCK):
        own = min(BLOCK, len(starts) - i)
        s, e, r = (x[i : i + own + longest - 1] for x in (starts, ends, rows))
        lengths, n = e - s, len(s)
        bounds = np.append(0, np.cumsum(lengths))
        value = low[np.repeat(s - bounds[:-1], lengths) + np.arange(bounds[-1])]
        spaced = np.full(len(value) + n, 32, np.uint8)
        spaced[np.arange(len(value)) + np.repeat(np.arange(n), lengths)] = value
        first = bounds[:-1] + np.arange(n)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(value)])
        word = array.dictionary_encode().indices.to_numpy().astype(np.int64)
        kinds = int(word.max()) + 1  # below 2^20, so three fit in 63 bits
        found, parts = [], []
        for k in range(longest):
            m = min(own, n - k)
            if m <= 0:
                break
            begin = np.flatnonzero(r[:m] == r[k : k + m])
            key = np.zeros(len(begin), np.int64)
            for j in range(k + 1):
                key = key * kinds + word[begin + j]
            numbers, place = _distinct(key)
            a = begin[place]
            parts.append((first[a], first[a + k] + lengths[a + k] - first[a]))
            found.append((r[begin], numbers))
        crc = crcs(spaced, *(np.concatenate(x) for x in zip(*parts, strict=True))) % np.uint32(buckets)
        base = 0
        for (row, numbers), (p, _) in zip(found, parts, strict=True):
            yield row, crc[base : base + len(p)][numbers].astype(np.int64)
            base += len(p)


def counts(texts: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, n) over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            text, at = raw(b.column(0))
            for i, j in pieces(at, PIECE):
                for _, bucket in features(text[at[i] : at[j]], at[i : j + 1] - at[i], buckets):
                    total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield batch("bucket long, n long", bucket=there, n=total[there])

    return texts.select(F.col(column).cast("string")).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, text: str = "text", target_text: str = "text") -> np.ndarray:
    """Each bucket's gain in thousandths: the log ratio of its smoothed shares in the target and in the documents."""
    both = counts(docs, text, buckets).withColumn("side", F.lit(0)).unionByName(counts(target, target_text, buckets).withColumn("side", F.lit(1)))
    n = [[0] * buckets, [0] * buckets]
    for r in both.collect():  # two rows a bucket at most
        n[r["side"]][r["bucket"]] = r["n"]
    whole, wanted = (float(sum(x) + buckets) for x in n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted))) for s, t in zip(*n, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight."""
    names = ["n_words", "n_features", "weight"]
    docs = docs.drop(*names)
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, at = raw(b.column(text))
            sums = np.zeros((3, b.num_rows), np.int64)
            for i, j in pieces(at, PIECE):
                part = column[at[i] : at[j]], at[i : j + 1] - at[i]
                sums[0, i:j] = np.bincount(words(*part)[3], minlength=j - i)
                for row, bucket in features(*part, buckets):
                    sums[1, i:j] += np.bincount(row, minlength=j - i)
                    sums[2, i:j] += np.bincount(row, held.value[bucket], minlength=j - i).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums)], names=[*b.schema.names, *names])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))


def draw(weighed: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """score, and rank among the drawn rows: without replacement, `percent` of the rows that have enough words."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(weighed.drop("score", "rank").withColumn("score", F.col("weight") + noise), "weighed")
    fit = F.col("n_words") >= least_words
    n = scored.filter(fit).count() * percent // 100
    sort = scored.filter(fit).withColumn("__down", -F.col("score"))
    place = numbered(sort, [], ["__down", key, "n_features"], "__place").drop("__down")
    ranked = place.withColumn("rank", F.when(F.col("__place") < n, F.col("__place") + 1).cast("long")).drop("__place")
    return ranked.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42, text: bool = True) -> DataFrame:
    """All documents with n_words, n_features, weight, score and rank (null if not drawn); without text, that column is left out."""
    weighed = weigh(docs, gains(docs, target, buckets=buckets))
    return draw(weighed if text else weighed.drop("text"), percent=percent, least_words=least_words, seed=seed)
