"""Merkle-tree fingerprints of texts.

One tree for texts of every size. Each place between two code points has a strength that depends on the text around it
alone, so an edit moves no cut far from it: inside a paragraph the number of trailing zero bits of a hash of the last four code
points (one in two places has 1 or more, one in four 2 or more, and so on, 15 at most); at the end of a paragraph (after line
feeds) 16 more than that of a hash of the paragraph. Nodes of level k lie between places of strength k or more: runs of code points
below, paragraphs at level 16, sections (paragraphs gathered up to one whose hash ends in two zero bits) at level 18, the
whole text on top. Where a text repeats itself and no place stands out, more than eight children in a row (but a paragraph's) are
gathered by fours. A node's digest is over its children's digests, so equal digests mean equal texts, white space too.

The fingerprint is the root (128 bits, over the top digest and a second one of the code points) and the upper part of the tree: its
leaves are the largest nodes of at most 2^grain code points (or of level 1), grain being the least for which there are at
most LEAVES, so its size has a bound however long the text is. A node has its length and 16 bits of its digest. Equal texts have
equal fingerprints, roots tell different texts apart; where roots differ, differing() descends from the top, passes over
branches with equal digests, and compares the leaves below the others at the coarser grain of the two. There a leaf is common if it
and a neighbour are, so that a short run that chance has put into both texts isn't. likeness() is the common share of code
points, by the larger text.

Null text is empty; two empty texts have likeness 1, an empty and another one 0. In pairs(), rows are ordered by doc_id (a
null one first), equal doc_ids by text; a single row is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch
from .textkit import BYTE_BASE, WORD_BASE, inverse, mix, powers

U = np.uint64
#: Levels of the tree; that of paragraphs; leaves of a fingerprint; children of a node in a row of many.
TOP, PARAGRAPH, LEAVES, FEW = 24, 16, 64, 4


def _digests(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest for each range of the values."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values + U(1)) * powers(base, max(1, len(values))), out=sums[1:]) if len(values) else None
    return mix((sums[ends] - sums[starts]) * powers(inverse(base), len(values) + 1)[starts] + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))


def _zeros(h: np.ndarray, most: int) -> np.ndarray:
    """Trailing zero bits, and most at most."""
    low = h & (~h + U(1))
    return np.minimum(np.bitwise_count(low - U(1)), most).astype(np.int8)


def levels(points: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(digest, end, number of children) of the nodes of each level, from runs (level 1) to whole texts, of several texts that end at these places."""
    n = len(points)
    x = mix(points.astype(U) + U(1))
    around, starts = x.copy(), np.append(0, ends[:-1])
    for k in (1, 2, 3):
        before = x[:-k] * U(2 * k + 1)
        for i in range(k):  # the first places of a text have nothing of the text before around them
            at = starts + i
            at = at[(at < ends) & (at >= k)] - k
            before[at] = 0
        around[k:] += before
    strength = _zeros(mix(around), PARAGRAPH - 1)
    #: a paragraph ends with the last of its line feeds
    feed = points == 10
    last = np.flatnonzero(feed & ~np.append(feed[1:], False)) if n else np.zeros(0, np.int64)
    stops = np.unique(np.concatenate([last, ends[ends > 0] - 1]))
    paragraph = _digests(x, BYTE_BASE, np.append(0, stops[:-1] + 1), stops + 1) if len(stops) else x[:0]
    strength[stops] = PARAGRAPH + _zeros(paragraph, TOP - PARAGRAPH - 1)
    strength[ends[ends > 0] - 1] = TOP
    out, digest, end = [], x, np.arange(1, n + 1)
    for k in range(1, TOP + 1):
        strong = strength >= k
        cut = np.flatnonzero(strong)
        size = np.diff(cut, prepend=-1)
        long = np.flatnonzero(size > 2 * FEW) if k not in (PARAGRAPH, TOP) else cut[:0]
        if len(long):  # cut by fours
            more = (size[long] - 1) // FEW
            step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            strong[np.repeat(cut[long] - size[long], more) + FEW * (step + 1)] = True
            cut = np.flatnonzero(strong)
            size = np.diff(cut, prepend=-1)
        begin = cut - size + 1
        digest, end, strength = np.where(size == 1, digest[cut], _digests(digest, WORD_BASE, begin, cut + 1)), end[cut], strength[cut]  # an only child stands for its parent
        out.append((digest, end, size))
    return out


def _bits(length: np.ndarray) -> np.ndarray:
    """The least k with 2^k >= length."""
    return np.frexp(np.maximum(length, 1) - 0.5)[1].astype(np.int64) * (length > 1)


def _text(b: bytes) -> str:
    return base64.b64encode(b, b"-_").decode().rstrip("=")


def _bytes(s: str) -> bytes:
    return base64.b64decode(s + "=" * (-len(s) % 4), b"-_")


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.cumsum([0, *map(len, texts)])
    tree, n = levels(points, at[1:]), len(texts)
    second = _digests(points.astype(U), BYTE_BASE ^ 0x5DEECE66C, at[:-1], at[1:])
    sizes = np.diff(at)
    #: leaves of a text are the largest nodes of at most 2^grain code points; there are LEAVES at most, so 2^grain is not under a 64th of it
    least = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) / LEAVES)), 0).astype(np.int64)
    #: of each node that may be kept: text, place, length, the least grains at which it and its parent are whole, whether it is of the lowest level
    found, lengths = [], [np.diff(end, prepend=0) for _, end, _ in tree]
    place = np.repeat(np.arange(n), sizes)
    bottom = np.zeros(len(points) + 1, np.int32)
    bottom[tree[0][1]] = lengths[0]
    for k, (digest, end, _) in enumerate(tree):
        length, top = lengths[k], k + 1 == len(tree)
        large = np.full(len(end), 62) if top else np.repeat(_bits(lengths[k + 1]), tree[k + 1][2])
        above = np.full(len(end), 1 << 62) if top else np.repeat(lengths[k + 1], tree[k + 1][2])
        d = place[end - 1]
        own = np.flatnonzero((length < above) & (large > least[d]))
        found.append((d[own], end[own] - length[own], length[own], _bits(length[own]), large[own], bottom[end[own]] == length[own], digest[own].view(np.int64)))
    text, start, length, small, large, lowest, digest = (np.concatenate(x) for x in zip(*found, strict=True))
    change = np.bincount(text * 64 + np.where(lowest, 0, small), minlength=n * 64) - np.bincount(text * 64 + large, minlength=n * 64)
    enough = (np.cumsum(change.reshape(n, 64), axis=1) <= LEAVES) & (np.arange(64) >= least[:, None])
    grain = np.argmax(enough, axis=1)
    kept = large > grain[text]
    text, start, length, digest, leaf = text[kept], start[kept], length[kept], digest[kept], (lowest | (small <= grain[text]))[kept]
    order = np.lexsort((-length, start, text))
    first = np.searchsorted(text[order], np.arange(n + 1))
    shown, digests = ((length << 1) | leaf)[order].astype("<u4"), digest[order].astype("<u2")
    top, full = np.zeros(n, np.int64), first[1:] > first[:-1]
    top[full] = digest[order][first[:-1][full]]
    out = []
    for d in range(n):
        root = hashlib.blake2b(top[d : d + 1].tobytes() + second[d : d + 1].tobytes() + len(texts[d]).to_bytes(8, "little"), digest_size=16).digest()
        size = shown[first[d] : first[d + 1]]
        wide = len(texts[d]) >= 1 << 15
        out.append(_text(root) + "." + _text(bytes([int(grain[d]), wide]) + size.astype("<u4" if wide else "<u2").tobytes() + digests[first[d] : first[d + 1]].tobytes()))
    return out


class Tree:
    """A fingerprint read back: nodes in order, parents first, as (place, length, whether a leaf, digest)."""

    def __init__(self, fingerprint: str):
        self.root, rest = fingerprint.split(".")
        data = _bytes(rest)
        self.grain, kind = data[0], "<u4" if data[1] else "<u2"
        n = (len(data) - 2) // (6 if data[1] else 4)
        size, digest = np.frombuffer(data, kind, n, 2).astype(np.int64), np.frombuffer(data, "<u2", n, len(data) - 2 * n).astype(np.int64)
        ends = np.cumsum((size >> 1) * (size & 1))
        self.length = int(ends[-1]) if n else 0
        #: a node's place, length, whether a leaf, and its key of length and digest
        self.at, self.size, self.leaf, self.key = ends - (size >> 1) * (size & 1), size >> 1, (size & 1).astype(bool), (size >> 1) << 16 | digest

    def common(self, other: np.ndarray, grain: int) -> tuple[list[tuple[int, int, int]], list[bool]]:
        """The leaves (place, length, key) at a grain, and which of them lie below a branch whose key is among the others."""
        left, leaves, same, until, skip = Counter(other.tolist()), [], [], 0, 0
        for at, n, leaf, key in zip(self.at.tolist(), self.size.tolist(), self.leaf.tolist(), self.key.tolist(), strict=True):
            if at < skip:
                continue
            end = leaf or n <= 1 << grain
            if at >= until and not end and left[key] > 0:
                left[key] -= 1
                until = at + n
            if end:
                leaves.append((at, n, key))
                same.append(at < until)
                skip = at + n
        return leaves, same


def differing(a: Tree, b: Tree) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The places [start, end) of either text, in code points, that differ: leaves below differing branches, but those that
    are the other's too and have a neighbour in common."""
    if a.root == b.root:
        return [], []
    grain = max(a.grain, b.grain)
    if not np.intersect1d(a.key, b.key).size:  # no branch and no leaf in common
        return [(0, a.length)] * (a.length > 0), [(0, b.length)] * (b.length > 0)
    sides = [a.common(b.key, grain), b.common(a.key, grain)]
    couples = [list(zip([None, *(d[2] for d in leaves)], [*(d[2] for d in leaves), None], strict=True)) for leaves, _ in sides]
    out = []
    for (leaves, same), own, other in zip(sides, couples, couples[::-1], strict=True):
        left, hit = Counter(other), []
        for c in own:
            hit.append(left[c] > 0)
            left[c] -= 1
        ranges: list[tuple[int, int]] = []
        for i, (at, n, _) in enumerate(leaves):
            if not (same[i] or hit[i] or hit[i + 1]):
                if ranges and ranges[-1][1] == at:
                    ranges[-1] = (ranges[-1][0], at + n)
                else:
                    ranges.append((at, at + n))
        out.append(ranges)
    return out[0], out[1]


def likeness(one: str | Tree, two: str | Tree) -> float:
    """0 (nothing in common) to 1 (equal, and only then)."""
    a, b = (x if isinstance(x, Tree) else Tree(x) for x in (one, two))
    if a.root == b.root:
        return 1.0
    left = [sum(j - i for i, j in r) for r in differing(a, b)]
    most = max(a.length, b.length)
    return max(0, min(a.length - left[0], b.length - left[1], most - 1)) / most


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points is replaced by the first as many of another one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def pairs(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document: the columns of the query.

    Documents are dealt into ranges of doc_id by quantiles (as many as the session's parallelism), each range also gets
    the next range's first document, and a range is read as a stream in order: one shuffle of the texts, two rows held.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"))
    cuts = np.array(sorted({int(x) for x in ids.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)}), np.int64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), "right").astype(np.int32))

    first = ids.groupBy(bucket("k").alias("bucket")).agg(F.min("k").alias("k")).orderBy("bucket").collect()
    before = spark.createDataFrame([(r.k, first[i - 1].bucket, i == 0) for i, r in enumerate(first)], "first long, to int, last boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    own = F.struct(bucket("k").alias("bucket"), F.lit(False).alias("extra"))
    # at most one row per range; its size is that of the list above
    rows = rows.join(F.broadcast(before), rows["k"] == before["first"], "left").withColumn("own", own)
    rows = rows.withColumn("to_", F.when(F.col("to").isNull(), F.array("own")).otherwise(F.array("own", F.struct(F.col("to").alias("bucket"), F.lit(True).alias("extra")))))
    rows = rows.select(F.explode("to_").alias("x"), "doc_id", "text", "k").select("x.bucket", "x.extra", "k", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows_of(held: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in held]
        changed = [edited(t, x) for t, x in zip(texts, [*texts[1:], following], strict=True)]
        raw = [t.encode() for t in changed]
        prints, after = fingerprints([*texts, following]), fingerprints(changed)
        trees = [Tree(p) for p in prints]
        return batch(schema, doc_id=[d for d, _ in held], n_chars=[len(t) for t in texts], edited_sha256=[hashlib.sha256(b).hexdigest() for b in raw], fingerprint=prints[:-1], edited_fingerprint=after, near_edited=[likeness(a, b) for a, b in zip(trees, after, strict=False)], near_next=[likeness(a, b) for a, b in zip(trees, trees[1:], strict=False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, now, done = 0, None, False
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                for bucket, extra, d, text in zip(*(part.column(k).to_pylist() for k in ("bucket", "extra", "doc_id", "text")), strict=True):
                    if bucket != now:
                        held, size, now, done = [], 0, bucket, False
                    if done:
                        continue
                    if extra:
                        if held:
                            yield rows_of(held, text)
                        held, done = [], True
                        continue
                    if size > 1 << 19:
                        yield rows_of(held, text)
                        held, size = [], 0
                    held.append((d, text))
                    size += len(text)

    return rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "extra", "k", "text").mapInArrow(work, schema)
