"""Removal of word runs that repeat anywhere, found by doubling the length level by level.

A window of `window` words is marked if its word sequence starts at another place too, in any document; words covered by
a marked window go. Lengths double up to the window: at each level only windows that repeated at the level below are
looked at again at about twice the length. For 35 words the levels are 9, 18 and 35.

Below the last level a window is stood for by its least sub-window hash of that length: equal windows choose equal
sub-windows, so a window whose choice is unique in the corpus can't repeat, and nothing is lost. So the first level
shuffles one hash for about each 14 words and the last only hashes of windows that may repeat.

Documents are shuffled once, into chunks by a hash of id and text; the three levels and the result read that exchange
(Spark reuses it). The number of chunks follows the table and bounds what a function holds; the number of partitions is the
session's. Each chunk sends each distinct hash once, with its number of places; a hash has at most one row per
chunk, so very frequent passages make no large group. Repeated hashes go back to the chunks that sent them.

Null text has no words. Repeated rows are documents of their own and so repeat each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, parts, pieces, raw, with_chunk
from .textkit import in_sorted, sliding, window_hashes, word_hashes, word_spans

PIECE = 1 << 19


def levels(window: int) -> list[int]:
    """Lengths that double up to the window: 35 -> [9, 18, 35]."""
    out = [window]
    while out[0] > 16:
        out.insert(0, -(-out[0] // 2))
    return out


class _Windows:
    """The windows of some documents, and which of them can still repeat."""

    def __init__(self, text: np.ndarray, at: np.ndarray, window: int):
        self.starts, self.ends, self.counts = word_spans(text, at)
        self.words = word_hashes(text, self.starts, self.ends)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.window = window
        self.alive = doc[: len(doc) - window + 1] == doc[window - 1 :] if len(doc) >= window else np.zeros(0, bool)

    def choices(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of so many words, and of each window its least one."""
        runs = window_hashes(self.words, length)
        return runs, sliding(runs, self.window - length + 1)

    def sent(self, length: int) -> np.ndarray:
        """Hashes, one for each place, that stand for the windows still alive."""
        runs, least = self.choices(length)
        if not self.alive.any():
            return runs[:0]
        width = self.window - length + 1
        pad = np.zeros(width - 1, np.uint64)
        chosen = sliding(np.concatenate([pad, np.where(self.alive, least, np.uint64(0)), pad]), width, least=False)
        return runs[(chosen == runs) & (chosen != 0)]

    def keep(self, length: int, repeated: np.ndarray) -> None:
        """Only windows whose choice repeats stay alive."""
        if self.alive.any():
            self.alive &= in_sorted(self.choices(length)[1], repeated)


def _sent(chunk: int, texts: pa.Table, window: int, length: int, below: int | None, known: pa.Table | None) -> pa.Table:
    """(chunk, h, places): the hashes of a length that stand for windows not ruled out by the length below."""
    repeated = None if known is None else np.sort(known.column("h").to_numpy().view(np.uint64))
    text, at = raw(texts.column("text"))
    found = [np.zeros(0, np.uint64)]
    for i, j in pieces(at, PIECE):
        w = _Windows(text[at[i] : at[j]], at[i : j + 1] - at[i], window)
        if repeated is not None:
            w.keep(below, repeated)
        found.append(w.sent(length))
    h, places = np.unique(np.concatenate(found), return_counts=True)
    return pa.Table.from_batches([batch("chunk int, h long, places int", chunk=np.full(len(h), chunk, np.int32), h=h.view(np.int64), places=places.astype(np.int32))])


def mark(docs: DataFrame, window: int, chunk_docs: int = 1500) -> tuple[DataFrame, DataFrame]:
    """(documents dealt into chunks, (chunk, h) of the hashes of windows that repeat)."""
    spark = docs.sparkSession
    n = parts(spark, docs.count(), chunk_docs)
    chunks = with_chunk(docs.select(F.col("doc_id").cast("long"), "text"), n, "doc_id", "text").repartition(parts(spark, 0, 1), "chunk")
    steps = levels(window)

    schema, again = "chunk int, h long, places int", None

    def first(key, texts):
        return _sent(key[0].as_py(), texts, window, steps[0], None, None)

    def further(k: int):
        def work(key, texts, known):
            return _sent(key[0].as_py(), texts, window, steps[k], steps[k - 1], known)

        return work

    for k in range(len(steps)):
        if again is None:
            sent = chunks.groupBy("chunk").applyInArrow(first, schema)
        else:
            sent = chunks.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(further(k), schema)
        again = sent.withColumn("n", F.sum("places").over(Window.partitionBy("h"))).filter("n > 1").select("chunk", "h")
    return chunks, again


def covered(windows: _Windows, repeated: np.ndarray) -> np.ndarray:
    """Which words a repeated window covers."""
    out = np.zeros(len(windows.words) + 1, np.int64)
    if len(windows.alive):
        hit = np.flatnonzero(windows.alive & in_sorted(window_hashes(windows.words, windows.window), repeated))
        np.add.at(out, hit, 1)
        np.add.at(out, hit + windows.window, -1)
    return np.cumsum(out[:-1]) > 0


def dedup(docs: DataFrame, *, window: int = 35, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, if asked for, the kept words as text."""
    chunks, again = mark(docs, window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text

    def work(key, texts, known):
        repeated = np.sort(known.column("h").to_numpy().view(np.uint64))
        data, at = raw(texts.column("text"))
        rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
        for i, j in pieces(at, PIECE):
            part, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
            w = _Windows(part, ends, window)
            gone, whole, first = covered(w, repeated), part.tobytes(), 0
            for d, n in enumerate(w.counts):
                words, off = whole[ends[d] : ends[d + 1]].split(), gone[first : first + n]
                first += n
                kept = b" ".join(compress(words, ~off) if off.any() else words)
                for k, v in (("n_words", int(n)), ("n_removed", int(off.sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    rows[k].append(v)
                if text:
                    rows["text"].append(kept.decode("utf-8", "replace"))
        ids = texts.column("doc_id").cast(pa.int64()).to_pylist()
        return pa.Table.from_batches([batch(schema, doc_id=ids, **rows)])

    return chunks.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(work, schema)
