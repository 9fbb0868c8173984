"""Lexical retrieval packing with a sharded BM25 inverted index.

Documents become token ids and are routed to shards by content, so that neighbours share a shard. Searches over all documents
have as queries the pivots: all documents whose id is divisible by 100 (where these are over a fiftieth, a hundredth by hash;
there, and where they are under 512, also the 512 texts of least hash); their number follows the table, and their whole texts count. Each is
scored by BM25 against every document, exactly, in blocks of pivots, which gives its ten best other texts. Every document goes to the
cell of the pivot that it is closest to, by its score over that of the pivot's tenth; a pivot and its copies are in its own cell.
Pivots stand in an order that puts like ones side by side, and their cells are cut into shards of equal size, by the number of
documents that each has of all: small cells share a shard, and a hot one is split, behind its closest documents. Neither
pivots nor shards depend on the session's settings. Inverse document frequencies and the mean length are counted over all documents (a vocabulary's
size bounds that table). Each shard builds an inverted index from token ids to its documents and packs them: the document
that starts a sequence is the seed, and the unused documents that the index ranks best for it follow until the sequence is
full; the rest of the last one starts the next sequence, as its seed. Documents without a neighbour follow in order. A
shard's last sequence is cut into powers of two, so nothing is padded. Seeds that are no pivots search their shard (the
README has the recall of both).

Ids in more than `common` of all documents, and in more than 1,000, are stop terms of a query; how much the others count is left to
their inverse document frequency. A shard is one task's work: shard_docs documents on
average. Null text is empty, so the document is its end id alone; null doc_ids are packed too; repeated rows are packed
once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, forget, stored
from .tokens import Encoder

K1, B = 1.2, 0.75
#: Ids of so many documents or fewer are never stop terms.
COMMON_DOCS = 1000
#: One id in so many is a pivot, and so many of least hash where these are fewer; neighbours that each finds; pivots scored at once and put in order at once.
EVERY, PIVOTS, BEST, BLOCK, ORDERED = 100, 512, 10, 1 << 13, 1 << 10
#: Scores held at once, few enough for a core's cache, and documents at least; steps of closeness in a cell.
SCORES, TOGETHER, STEPS = 25_600, 8, 8


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 16-bit ids, with the end id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.uint16(end_id).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.ids(t or "") + end for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids binary")


def _terms(blobs: list[bytes], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the ids (of the useful ones) of documents in order, and the documents' lengths."""
    lengths = np.array([len(x) // 2 for x in blobs], np.int64)
    kind = np.uint32 if len(blobs) <= 1 << 16 else np.uint64
    ids = np.frombuffer(b"".join(blobs), "<u2")
    if useful is None:
        keys = np.repeat(np.arange(len(blobs), dtype=kind) << kind(16), lengths) | ids.astype(kind)
    else:
        k = np.flatnonzero(useful[ids])
        keys = np.searchsorted(np.cumsum(lengths), k, "right").astype(kind) << kind(16) | ids[k].astype(kind)
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    own = keys[at]
    return (own >> kind(16)).astype(np.int64), (own & kind(0xFFFF)).astype(np.int64), np.diff(np.append(at, len(keys))), lengths


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many documents have each id (65,536 counts), how many documents there are, their mean length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, ids = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            blobs = b.column(0).to_pylist()
            for i in range(0, len(blobs), 500):
                _, term, _, lengths = _terms(blobs[i : i + 500])
                counts += np.bincount(term, minlength=1 << 16)
                docs, ids = docs + len(lengths), ids + int(lengths.sum())
        k = np.flatnonzero(counts)
        yield batch("term int, n long", term=np.append(k, [-1, -2]), n=np.append(counts[k], [docs, ids]))

    counts = np.zeros(1 << 16, np.int64)
    docs = ids = 0
    for r in tokens.select("ids").mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] >= 0:
            counts[r["term"]] = r["n"]
        elif r["term"] == -1:
            docs = r["n"]
        else:
            ids = r["n"]
    return counts, docs, ids / max(1, docs)


def _weighed(blobs: list[bytes], df: np.ndarray, n: int, mean: float, common: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of the terms that count, and the documents' lengths."""
    doc, term, times, lengths = _terms(blobs, df <= max(COMMON_DOCS, common * n))
    idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
    return doc, term, idf * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[doc] / mean)), lengths


class Index:
    """An inverted index over a shard's documents."""

    def __init__(self, blobs: list[bytes], df: np.ndarray, n: int, mean: float, common: float):
        doc, term, weight, self.lengths = _weighed(blobs, df, n, mean, common)
        self.own = np.searchsorted(doc, np.arange(len(blobs) + 1))
        self.terms = term
        order = np.argsort(term.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
        self.docs, self.weights = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every document of the shard for the terms of one."""
        q = self.terms[self.own[d] : self.own[d + 1]]
        lo, n = self.first[q], self.first[q + 1] - self.first[q]
        if not n.sum():
            return np.zeros(len(self.lengths))
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.docs[at], self.weights[at], len(self.lengths))


class Pivots:
    """Terms of documents that are searched for among all, in an order that puts like ones side by side."""

    def __init__(self, blobs: list[bytes], df: np.ndarray, n: int, mean: float, common: float):
        doc, term, _, _ = _weighed(blobs, df, n, mean, common)
        self._take(term.astype(np.uint16), np.bincount(doc, minlength=len(blobs)), df, n, mean, common)

    @classmethod
    def of(cls, terms: np.ndarray, counts: np.ndarray, df: np.ndarray, n: int, mean: float, common: float) -> Pivots:
        found = cls.__new__(cls)
        found._take(terms, counts, df, n, mean, common)
        return found

    def _take(self, terms: np.ndarray, counts: np.ndarray, df: np.ndarray, n: int, mean: float, common: float) -> None:
        self.terms, self.at, self.block, self.own = terms, np.append(0, np.cumsum(counts)), None, (df, n, mean, common)
        p = len(counts)
        self.place, self.tenth = np.empty(p, np.int64), np.ones(p)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        for lo in range(0, p, ORDERED):  # eigenvectors of so many at once
            hi = min(lo + ORDERED, p)
            doc, term = np.repeat(np.arange(hi - lo), counts[lo:hi]), terms[self.at[lo] : self.at[hi]]
            likeness = np.concatenate([self._scores(self._index(lo, hi), doc[x] - i, term[x], idf[term[x]] ** 2, min(50, hi - lo - i), hi - lo) for i in range(0, hi - lo, 50) for x in [slice(*(self.at[[lo + i, min(lo + i + 50, hi)]] - self.at[lo]))]])
            own = np.sqrt(np.maximum(likeness.diagonal(), 1e-9))
            self.place[lo + self._sorted(likeness / own[:, None] / own, np.arange(hi - lo))] = np.arange(lo, hi)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"block": None}

    def _sorted(self, likeness: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Spectral halves, halved again."""
        if len(ids) < 3:
            return ids
        w = likeness[np.ix_(ids, ids)]
        d = 1 / np.sqrt(w.sum(axis=1) + 1e-9)
        side = np.linalg.eigh(w * d[:, None] * d)[1][:, -2] * d
        side *= np.sign(side[np.abs(side).argmax()])
        ids = ids[np.argsort(side, kind="stable")]
        return np.concatenate([self._sorted(likeness, ids[: len(ids) // 2]), self._sorted(likeness, ids[len(ids) // 2 :])])

    def _index(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Pivots by term, and where each term's begin; the last block stays."""
        if self.block is None or self.block[0] != (lo, hi):
            term = self.terms[self.at[lo] : self.at[hi]]
            order = np.argsort(term, kind="stable")
            self.block = (lo, hi), (np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))[order], np.searchsorted(term[order], np.arange((1 << 16) + 1)))
        return self.block[1]

    @staticmethod
    def _scores(index: tuple[np.ndarray, np.ndarray], doc: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, p: int) -> np.ndarray:
        """Sums of the documents' (rows) weights over the terms of each of p pivots (columns)."""
        pivots, first = index
        lo = first[term]
        n = first[term.astype(np.int64) + 1] - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(np.repeat(doc * p, n) + pivots[at], np.repeat(weight, n), rows * p).reshape(rows, p)

    def scores(self, blobs: list[bytes], own: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, first pivot, BM25 of documents (rows) for the terms of pivots (columns)). own: pivots that rows are, or -1; none scores itself."""
        p = len(self.place)
        found = [(i, *_weighed(blobs[i : i + 500], *self.own)) for i in range(0, len(blobs), 500)]
        for lo in range(0, p, BLOCK):
            hi = min(lo + BLOCK, p)
            index = self._index(lo, hi)
            together = max(TOGETHER, SCORES // (hi - lo))
            for start, doc, term, weight, lengths in found:
                steps = np.append(np.arange(0, len(lengths), together), len(lengths))
                for first, last, x in zip(steps[:-1].tolist(), steps[1:].tolist(), map(slice, (at := np.searchsorted(doc, steps))[:-1], at[1:]), strict=True):
                    s, i = self._scores(index, doc[x] - first, term[x], weight[x], last - first, hi - lo), start + first
                    if own is not None:
                        row = np.flatnonzero((own[i : i + last - first] >= lo) & (own[i : i + last - first] < hi))
                        s[row, own[i + row] - lo] = 0
                    yield i, lo, s

    def cells(self, blobs: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
        """place of the closest pivot * STEPS + how far from it; no pivot counts as one more place."""
        closest, cell = np.zeros(len(blobs)), np.full(len(blobs), len(self.place) * STEPS)
        for i, lo, s in self.scores(blobs):
            s = s / self.tenth[lo : lo + s.shape[1]]
            k = s.argmax(axis=1)
            top, part = s[np.arange(len(k)), k], slice(i, i + len(k))
            far = np.ceil((1 - np.minimum(top, 1)) * (STEPS - 1)).astype(np.int64)
            cell[part] = np.where(top > closest[part], self.place[lo + k] * STEPS + far, cell[part])
            closest[part] = np.maximum(top, closest[part])
        return cell if own is None else np.where(own >= 0, self.place[own] * STEPS, cell)


def searched(tokens: DataFrame, df: np.ndarray, n: int, mean: float, common: float) -> tuple[np.ndarray, Pivots, DataFrame]:
    """Hashes of the pivots' ids, ascending; the pivots in this order; and (pivot, score, doc_id): their BEST other texts of all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            doc, term, _, _ = _weighed(blobs, df, n, mean, common)
            parts = np.split(term.astype(np.uint16), np.searchsorted(doc, np.arange(1, len(blobs)))) if blobs else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in parts], pa.binary())], names=["h", "terms"])

    h = F.xxhash64("ids")
    chosen = F.pmod("doc_id", F.lit(EVERY)) == 0
    divisible = tokens.filter(chosen).count()
    most = divisible * EVERY > 2 * n
    if most:
        chosen = F.pmod(h, F.lit(EVERY)) == 0
    if most or divisible < PIVOTS or n < PIVOTS * EVERY:  # copies of one text may have no hash that is divisible
        chosen = F.coalesce(chosen, F.lit(False)) | (h <= tokens.select(h.alias("h")).distinct().orderBy("h").limit(PIVOTS).agg(F.max("h")).first()[0])
    found = tokens.filter(chosen).groupBy(h.alias("h")).agg(F.min("ids").alias("ids")).mapInArrow(cut, "h long, terms binary").toArrow().sort_by("h")
    terms, known = found["terms"].to_pylist(), found["h"].to_numpy()
    pivots = Pivots.of(np.frombuffer(b"".join(terms), np.uint16), np.array([len(x) // 2 for x in terms], np.int64), df, n, mean, common)
    shared = tokens.sparkSession.sparkContext.broadcast((known, pivots))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pivots = shared.value
        least, held = np.zeros(len(known)), [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            pivot, score, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, -score, pivot))
            pivot, score, doc = pivot[order], score[order], doc[order]
            rank = np.arange(len(pivot)) - np.searchsorted(pivot, pivot)
            least[pivot[rank == BEST - 1]] = score[rank == BEST - 1]
            return pivot[rank < BEST], score[rank < BEST], doc[rank < BEST]

        for b in batches:
            own, ids, new = _own(known, b.column(2).to_numpy()), b.column(0), 0
            number = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, lo, s in pivots.scores(b.column(1).to_pylist(), own):
                row, col = np.nonzero((s > 0) & (s >= least[lo : lo + s.shape[1]]))
                held.append((lo + col, s[row, col], number[i + row]))
                new += len(row)
                if new > 1 << 18:
                    held, new = [best()], 0
        pivot, score, doc = best()
        yield batch("pivot long, score double, doc_id long", pivot=pivot, score=score, doc_id=doc)

    first = Window.partitionBy("pivot").orderBy(F.desc("score"), "doc_id")
    each = tokens.select("doc_id", "ids", h).mapInArrow(search, "pivot long, score double, doc_id long")
    return known, pivots, each.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= BEST)


def _own(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which pivot a row is, or -1."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def route(tokens: DataFrame, df: np.ndarray, n: int, mean: float, common: float, shard_docs: int) -> DataFrame:
    """(doc_id, ids, shard): documents closest to the same pivot share a shard, as far as it holds them."""
    shards = -(-n // shard_docs)
    if shards <= 1:
        return tokens.withColumn("shard", F.lit(0).cast("long"))
    known, pivots, best = searched(tokens, df, n, mean, common)
    tenth = best.groupBy("pivot").agg(F.min("score").alias("score")).toArrow()  # a row a pivot
    pivots.tenth[tenth["pivot"].to_numpy()] = tenth["score"].to_numpy()
    index = tokens.sparkSession.sparkContext.broadcast((known, pivots))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pivots = index.value
        for b in batches:
            cell = pivots.cells(b.column(1).to_pylist(), _own(known, b.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(cell)], names=["doc_id", "ids", "deal", "cell"])

    deal = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 40))
    routed = stored(tokens.select("doc_id", "ids", F.xxhash64("ids"), deal).mapInArrow(find, "doc_id long, ids binary, deal long, cell long"), "routed")
    sizes = routed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # STEPS rows a pivot at most
    order = np.argsort(sizes["cell"].to_numpy())
    cells, size = sizes["cell"].to_numpy()[order], sizes["n"].to_numpy()[order]
    ends = tokens.sparkSession.sparkContext.broadcast((cells, np.append(0, np.cumsum(size)), size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, wide = ends.value
        for b in batches:
            at = np.searchsorted(known, b.column(3).to_numpy())  # every document's cell was counted
            place = start[at] + wide[at] * (b.column(2).to_numpy() / ((1 << 40) + 1))
            shard = np.minimum(place * shards / start[-1], shards - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard)], names=["doc_id", "ids", "shard"])

    return routed.mapInArrow(work, "doc_id long, ids binary, shard long")


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of so many largest scores above zero, in descending order; ties by place."""
    top = np.argpartition(-scores, most)[:most] if most < len(scores) else np.arange(len(scores))
    top = np.sort(top[scores[top] > 0])
    return top[np.argsort(-scores[top], kind="stable")]


def order_and_cut(index: Index, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    lengths = index.lengths
    free = np.ones(len(lengths), bool)
    behind, sequence, offset = 0, 0, 0
    seed, ranked, place = -1, None, 0
    for _ in range(len(lengths)):
        d = -1
        if offset and seed >= 0:
            if ranked is None:
                s = index.scores(seed)
                s[~free] = 0
                ranked, place = _best(s, 64), 0
            while place < len(ranked) and not free[ranked[place]]:
                place += 1
            if place == len(ranked) and len(ranked) == 64:  # more neighbours than were ranked at first
                s[~free] = 0
                ranked, place = _best(s, len(s)), 0
            if place < len(ranked):
                d = int(ranked[place])
        if d < 0:
            while not free[behind]:
                behind += 1
            d = behind
        free[d] = False
        start, left = 0, int(lengths[d])
        if not offset:
            seed, ranked = d, None
        while left:
            n = min(left, size - offset)
            yield d, start, n, sequence, offset
            start, left, offset = start + n, left - n, offset + n
            if offset == size:
                sequence, offset = sequence + 1, 0
                seed, ranked = d, None


def cut_last(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The pieces, with the last sequence cut into sequences whose lengths are powers of two."""
    if not found:
        return found
    last = found[-1][3]
    tail = [p for p in found if p[3] == last]
    out = [p for p in found if p[3] != last]
    total = sum(p[2] for p in tail)
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    room, offset, sequence = sizes.pop(0), 0, last
    for d, start, n, _, _ in tail:
        while n:
            if offset == room:
                room, offset, sequence = sizes.pop(0), 0, sequence + 1
            m = min(n, room - offset)
            out.append((d, start, m, sequence, offset))
            start, n, offset = start + m, n - m, offset + m
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, size: int = 1024, shard_docs: int = 1000, common: float = 0.05, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and with_ids the piece's ids as 16-bit binary."""
    if size & (size - 1):
        raise ValueError("size is a power of two")
    tokens = stored(encoded(docs, tokenizer, end_id), "tokens")
    df, n, mean = statistics(tokens)
    known = docs.sparkSession.sparkContext.broadcast(df)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def work(key, table):
        blobs, ids = table.column("ids").to_pylist(), table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, blobs[i]))
        blobs, ids = [blobs[i] for i in order], [ids[i] for i in order]
        index = Index(blobs, known.value, n, mean, common)
        found = cut_last(list(order_and_cut(index, size)))
        cut = [blobs[d][2 * s : 2 * (s + m)] for d, s, m, _, _ in found]
        base = key[0].as_py() << 32
        rows = {"doc_id": [ids[p[0]] for p in found], "start": [p[1] for p in found], "length": [p[2] for p in found], "ids_crc32": [zlib.crc32(np.frombuffer(c, "<u2").astype("<u4").tobytes()) for c in cut], "doc_tokens": [int(index.lengths[p[0]]) for p in found], "sequence_id": [base + p[3] for p in found], "offset": [p[4] for p in found], "ids": cut}
        return pa.Table.from_batches([batch(schema, **rows)])

    routed = route(tokens, df, n, mean, common, shard_docs)
    if n > shard_docs:
        forget(tokens)  # routed is a table of its own
    return routed.groupBy("shard").applyInArrow(work, schema)
