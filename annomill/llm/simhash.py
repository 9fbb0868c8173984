"""SimHash near-duplicates by a binary trie self-join.

fingerprints: A-Z are lowered, words are runs of bytes other than ASCII white space, shingles are runs of so many words
joined by one space, repeats included (fewer words: the whole sequence; none: fingerprint zero). A bit is 1 if it is set
in over half of the shingles' XXH64 (seed 42).

links: fingerprints are the leaves of binary tries. A trie reads the bits in an order of its own; node pairs are walked
together from the root, each step splits both nodes by the next bit and adds the differing bits, and a pair is dropped
when these exceed the budget of its depth. A trie's first `equal` bits have a budget of zero, so Spark deals leaves out by
a prefix of these and nothing is copied to other nodes: one row per leaf and trie, whatever the data.

exact(bits): fingerprints of 64 bits are cut into bits + r blocks; pairs that differ in at most `bits` have r equal blocks, so
a trie for each choice of r blocks finds every pair. r grows with the leaves: 5 tries up to 67 million, 15 up to 17 billion, then 35.

similar(): for sets of shingles with a Jaccard similarity. 256-bit fingerprints of distinct shingles; sets at the similarity
differ in about 39 bits at 0.8. A trie's first d bits are equal, the next 14 differ in at most 3, all in at most 60; the tries
read pseudo-random bits. d follows the leaves (about NODE to a node) and the number of tries is what the binomial model asks
for to meet 96 % of pairs at the similarity: 2 tries for one node, 8 at 0.2 million leaves, 28 at 17 million, 120 at 2 billion.
These are candidates: a first walk marks leaves that have one (a pair counts only in the first trie where it meets), the
marked leaves get their shingle sets, and a second walk in the same nodes links pairs whose sets reach the similarity.

rest(): the pairs that no trie meets, exactly. Shingles are put in one order for all texts, those that a sample of texts has
often behind; two sets of the similarity share one of their first n - ceil(similarity * n) + 1 shingles. Texts of different
components that share such a shingle, and whose sizes allow the similarity, are compared by their whole sets. The sample, a
tenth of the texts so that the texts that share a shingle held to be rare don't grow with the table, shapes the order alone, and any order finds all pairs; near copies that the tries linked are one component and make no pairs.

Equal fingerprints are one leaf, so exact copies make no pairs. A task links what it found as a forest, and node pairs that
are linked already aren't walked, so a group of near copies costs about as much as its leaves and no link between
components is lost. A node of more than MOST leaves is cut into salts, and tasks take two salts at a time.

Null text is empty; null doc_ids count as documents, and a component's id is its least doc_id that is not null. Repeated
rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, parts, pieces, raw, stored
from .graph import components
from .textkit import mix, window_hashes, word_hashes, word_spans

U = np.uint64
#: Leaves of a node, on average and at most; leaf pairs and node pairs held at once; leaf pairs compared at once; salts of a component; bytes of text at once.
NODE, MOST, HELD, FEW, SALTS, PIECE = 1 << 13, 1 << 15, 1 << 18, 64, 32, 1 << 19
#: Of rest(): texts sampled for the order of shingles at least, and one in so many at least, texts of these that make a shingle a frequent one, frequent ones kept, slots of the table of fingerprints to fetch.
SAMPLED, SHARE, OFTEN, FREQUENT, SLOTS = 5000, 10, 2, 1 << 20, 1 << 20
#: Of similar(): 64-bit words of a fingerprint, bits that may differ, bits after the equal ones and how many of these may differ, share of pairs to meet.
WIDE, FAR, NEXT, NEXT_BITS, MEET = 4, 60, 14, 3, 0.96


class Plan(NamedTuple):
    """words: 64-bit words a fingerprint; bits: most that differ; for each trie the order of its bits (64 at most) and how
    many first ones are equal; after these, so many further bits differ in at most budget bits; depth of the nodes dealt."""

    words: int
    bits: int
    orders: list[list[int]]
    equal: list[int]
    further: int
    budget: int
    depth: int

    def allowed(self, trie: int, depth: int) -> int:
        return 0 if depth <= self.equal[trie] else self.budget if depth <= self.equal[trie] + self.further else self.bits


def _depth(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / NODE)))


def exact(bits: int, n: int) -> Plan:
    """Finds every pair of n 64-bit fingerprints that differs in at most so many bits."""
    r = next((r for r in range(1, 65 - bits) if r * 64 // (bits + r) >= _depth(n)), 64 - bits)
    edges = [64 * k // (bits + r) for k in range(bits + r + 1)]
    orders, equal = [], []
    for chosen in combinations(range(bits + r), r):
        first = [i for k in chosen for i in range(edges[k], edges[k + 1])]
        orders.append([*first, *sorted(set(range(64)) - set(first))])
        equal.append(len(first))
    return Plan(1, bits, orders, equal, 0, bits, min(_depth(n), *equal))


def met(similarity: float, depth: int, tries: int) -> float:
    """Share of pairs of sets at this similarity that the tries meet."""
    p, width = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE
    total = 0.0
    for k in range(FAR + 1):
        near = sum(math.comb(k, i) * math.comb(width - depth - k, NEXT - i) for i in range(NEXT_BITS + 1)) / math.comb(width - depth, NEXT)
        total += math.comb(width, k) * p**k * (1 - p) ** (width - k) * (1 - (1 - math.comb(width - k, depth) / math.comb(width, depth) * near) ** tries)
    return total


def similar(similarity: float, n: int) -> Plan:
    depth = min(_depth(n), 50)
    tries = 1
    while met(similarity, depth, tries) < MEET * met(similarity, 0, 1 << 20):
        tries += max(1, tries // 16)
    rng = np.random.default_rng(1)
    orders = [rng.permutation(64 * WIDE)[:64].tolist() for _ in range(tries)]
    return Plan(WIDE, FAR, orders, [depth] * tries, NEXT, NEXT_BITS, depth)


def fingerprint(text: bytes, shingle: int) -> bytes:
    """Big-endian."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return bytes(8)
    joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
    ends = np.cumsum([len(w) for w in parts]) + np.arange(len(parts))
    last = ends[min(shingle, len(parts)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[i:j], 42) for i, j in zip(first, last, strict=True)), U, n)
    return np.packbits(2 * _ones(hashes) > n).tobytes()


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles' hashes of each text, ascending; of a text with fewer words, that of its whole sequence."""
    data, at = raw(column)
    for i, j in pieces(at, PIECE):
        text = data[at[i] : at[j]]
        text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
        starts, ends, counts = word_spans(text, at[i : j + 1] - at[i])
        words = word_hashes(text, starts, ends)
        runs, first = window_hashes(words, shingle), 0
        for n in counts.tolist():
            yield np.unique(runs[first : first + n - shingle + 1] if n >= shingle else window_hashes(words[first : first + n], n) if n else words[:0])
            first += n


def fingerprints(docs: DataFrame, *, shingle: int = 4, sets: bool = False) -> DataFrame:
    """(doc_id, mark, fp), mark a hash of the text, fp as big-endian binary. With sets: wide fingerprints of distinct
    shingles, and column shingles, 32 bits of each one's hash, ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t or b"", shingle) for t in texts], pa.binary())], names=["doc_id", "mark", "fp"])

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                prints, held = [], []
                for h in shingle_sets(part.column(2), shingle):
                    prints.append(b"".join(np.packbits(2 * _ones(mix(h + U(k * 0x9E3779B97F4A7C15 % 2**64))) > len(h)).tobytes() for k in range(WIDE)))
                    held.append(np.unique(h >> U(32)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints, pa.binary()), pa.array(held, pa.binary())], names=["doc_id", "mark", "fp", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    return keyed.mapInArrow(wide, "doc_id long, mark long, fp binary, shingles binary") if sets else keyed.mapInArrow(work, "doc_id long, mark long, fp binary")


class Forest:
    """Components of positions, from pairs that come in parts; group is the least position of each one's component."""

    def __init__(self, n: int):
        self.group = np.arange(n)

    def __call__(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """near: differing bits of each pair."""
        self.add(a, b)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.group
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


class First:
    """Which pairs of leaves don't meet in any earlier trie."""

    def __init__(self, full: np.ndarray, plan: Plan, trie: int):
        self.full, self.plan = full, plan
        mask = lambda bits: _words([np.packbits(np.isin(np.arange(64 * plan.words), bits)).tobytes()], plan.words)[0]
        self.masks = [(mask(o[:e]), mask(o[e : e + plan.further])) for o, e in zip(plan.orders[:trie], plan.equal[:trie], strict=True)]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = self.full[a] ^ self.full[b]
        new = np.ones(len(a), bool)
        for equal, further in self.masks:
            k = np.flatnonzero(new)
            new[k] = (x[k] & equal).any(axis=1) | (np.bitwise_count(x[k] & further).sum(axis=1) > self.plan.budget)
        return new


class Marks:
    """Leaves with a pair that meets here first. Marked leaves are one group: pairs among them need no more looks."""

    def __init__(self, n: int, first: First):
        self.group, self.first = np.arange(1, n + 1), first

    def __call__(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        new = self.first(a, b)
        self.group[a[new]] = self.group[b[new]] = 0


class Checked(Forest):
    """Links pairs that meet here first and whose shingle sets are similar enough, the nearest first."""

    def __init__(self, sets: list[np.ndarray], first: First, similarity: float):
        super().__init__(len(sets))
        self.sets, self.first, self.similarity = sets, first, similarity

    def __call__(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        new = self.first(a, b)
        a, b, near = a[new], b[new], near[new]
        order, done = np.argsort(near, kind="stable"), 0
        size = 64
        while done < len(order):  # in growing parts: what a part links needs no look later
            k = order[done : done + size]
            done, size = done + size, min(2 * size, 4096)
            k = k[self.group[a[k]] != self.group[b[k]]]
            linked = k[[jaccard(self.sets[i], self.sets[j]) >= self.similarity for i, j in zip(a[k].tolist(), b[k].tolist(), strict=True)]] if len(k) else k
            self.add(a[linked], b[linked])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two ascending arrays of distinct values; two empty sets are equal."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.searchsorted(x, y)
    same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return same / (len(x) + len(y) - same)


def _members(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of ranges, and the range of each."""
    owner = np.repeat(np.arange(len(n)), n)
    return lo[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), owner


def _halved(p: np.ndarray) -> np.ndarray:
    """Node pairs cut until none has more than HELD leaf pairs."""
    while ((big := (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) > HELD)).any():
        q, one, two = p[big], p[big].copy(), p[big].copy()
        k = np.where(q[:, 1] - q[:, 0] >= q[:, 3] - q[:, 2], 0, 2)
        row = np.arange(len(q))
        middle = (q[row, k] + q[row, k + 1]) // 2
        one[row, k + 1], two[row, k] = middle, middle
        p = np.concatenate([p[~big], one, two])
    return p


def _one_group(group: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which node pairs have all their leaves in one group."""
    out = group[p[:, 0]] == group[p[:, 2]]
    k = np.flatnonzero(out)
    if len(k):
        change = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        for lo, hi in ((0, 1), (2, 3)):
            out[k] &= change[np.searchsorted(change, p[k, lo], "right")] >= p[k, hi]
    return out


def walk(keys: np.ndarray, full: np.ndarray, plan: Plan, trie: int, found: Callable) -> None:
    """Hands pairs of leaves within the budget to found, whose array `group` says which leaves need not meet. Keys ascend."""
    n = len(keys)
    stack = [(plan.depth, np.array([[0, n, 0, n, 0]]))]
    stop = 64 if plan.words == 1 else plan.equal[trie] + plan.further
    while stack:
        depth, p = stack.pop()
        if len(p) > HELD:
            stack += [(depth, p[i : i + HELD]) for i in range(0, len(p), HELD)]
            continue
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2]) & (p[:, 4] <= plan.allowed(trie, depth))]
        p = p[~_one_group(found.group, p)]
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        few = (na * nb <= FEW) | (depth >= stop)
        q = _halved(p[few])
        m = (q[:, 1] - q[:, 0]) * (q[:, 3] - q[:, 2])
        i = 0
        while i < len(q):
            j = max(i + 1, int(np.searchsorted(np.cumsum(m[i:]), HELD, "right")) + i)
            at, owner = _members(np.zeros(j - i, np.int64), m[i:j])
            part = q[i:j][owner]
            wide = part[:, 3] - part[:, 2]
            a, b = part[:, 0] + at // wide, part[:, 2] + at % wide
            k = found.group[a] != found.group[b]
            a, b = a[k], b[k]
            near = np.bitwise_count(full[a] ^ full[b]).sum(axis=1)
            k = near <= plan.bits
            if k.any():
                found(a[k], b[k], near[k])
            i = j
        p = p[~few]
        if len(p):
            shift = U(63 - depth)
            half = lambda lo, hi: np.clip(np.searchsorted(keys, ((keys[lo] >> shift) | U(1)) << shift), lo, hi)
            am, bm = half(p[:, 0], p[:, 1]), half(p[:, 2], p[:, 3])
            same, e = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3]), p[:, 4]
            children = [np.stack(x, axis=1) for x in ((p[:, 0], am, p[:, 2], bm, e), (am, p[:, 1], bm, p[:, 3], e), (p[:, 0], am, bm, p[:, 3], e + 1))]
            other = np.stack((am, p[:, 1], p[:, 2], bm, e + 1), axis=1)[~same]
            stack.append((depth + 1, np.concatenate([*children, other])))


def _words(blobs: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), ">u8").astype(U).reshape(-1, words)


def _keys(full: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits of fingerprints in a trie's order, as numbers of 64 bits."""
    bits = np.unpackbits(full.astype(">u8").view(np.uint8).reshape(len(full), -1), axis=1)[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(U).reshape(-1)


def _dealt(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(trie, node, one, two, fp): a row for each leaf and trie; leaves of a node beyond MOST have one for each other salt."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1 << 14):
                part = b.slice(i, 1 << 14)
                full = _words(part.column(0).to_pylist(), plan.words)
                for k, order in enumerate(plan.orders):
                    node = (_keys(full, order) >> U(64 - plan.depth)).astype(np.int64) if plan.depth else np.zeros(len(full), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k, np.int32)), pa.array(node), part.column(0)], names=["trie", "node", "fp"])

    rows = leaves.select("fp").mapInArrow(turn, "trie int, node long, fp binary")
    hot = stored(rows.groupBy("trie", "node").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).withColumn("salts", F.ceil(F.col("n") * 2 / MOST)).drop("n"), "hot")
    many = hot.count()
    if not many:
        return rows.select("trie", "node", F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), "fp")
    joined = rows.join(F.broadcast(hot) if many <= 100_000 else hot.hint("merge"), ["trie", "node"], "left")  # the size is checked
    own, salts = F.pmod(F.xxhash64("fp"), F.col("salts")), F.coalesce("salts", F.lit(0))
    other = F.when(salts == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), salts - 1), F.array(own)))
    each = joined.withColumn("own", F.coalesce(own, F.lit(0).cast("long"))).withColumn("other", F.explode(other))
    return each.select("trie", "node", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp")


TASK = ["trie", "node", "one", "two"]


def _by_task(rows: DataFrame) -> DataFrame:
    """Walks are long for their bytes, so Spark must not put many into one partition because these are few."""
    return rows.repartition(parts(rows.sparkSession, 0, 1), *TASK)


def _sorted(table: pa.Table, plan: Plan, trie: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    full = _words(table.column("fp").to_pylist(), plan.words)
    keys = _keys(full, plan.orders[trie])
    order = np.argsort(keys, kind="stable")
    return table.take(pa.array(order)), keys[order], full[order]


def _forest(table: pa.Table, group: np.ndarray) -> pa.Table:
    linked = np.flatnonzero(group != np.arange(len(group)))
    fps = table.column("fp")
    return pa.Table.from_arrays([fps.take(pa.array(linked)), fps.take(pa.array(group[linked]))], names=["u", "v"])


def links(leaves: DataFrame, bits: int) -> DataFrame:
    """(u, v) over distinct 64-bit column fp: a forest of each task's pairs that differ in at most so many bits."""
    plan = exact(bits, leaves.count())

    def work(group, table):
        trie = group[0].as_py()
        table, keys, full = _sorted(table, plan, trie)
        found = Forest(len(keys))
        walk(keys, full, plan, trie, found)
        return _forest(table, found.group)

    return _by_task(_dealt(leaves, plan)).groupBy(*TASK).applyInArrow(work, "u binary, v binary")


def similar_links(prints: DataFrame, leaves: DataFrame, similarity: float) -> DataFrame:
    """(u, v) over distinct wide column fp: a forest of each task's pairs whose shingle sets have the similarity."""
    plan = similar(similarity, leaves.count())

    def mark(group, table):
        trie = group[0].as_py()
        table, keys, full = _sorted(table, plan, trie)
        found = Marks(len(keys), First(full, plan, trie))
        walk(keys, full, plan, trie, found)
        return table.take(pa.array(np.flatnonzero(found.group == 0)))

    def check(group, table):
        trie = group[0].as_py()
        table, keys, full = _sorted(table, plan, trie)
        found = Checked([np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()], First(full, plan, trie), similarity)
        walk(keys, full, plan, trie, found)
        return _forest(table, found.group)

    marked = stored(_by_task(_dealt(leaves, plan)).groupBy(*TASK).applyInArrow(mark, "trie int, node long, one long, two long, fp binary"), "marked")
    sets = prints.groupBy("fp").agg(F.min("shingles").alias("shingles"))  # copies are one row before the shuffle
    return _by_task(marked.join(sets.hint("merge"), "fp").select(*TASK, "fp", "shingles")).groupBy(*TASK).applyInArrow(check, "u binary, v binary")


def _frequent(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that most of a sample's texts have, ascending, and how many have each. It only orders shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                h, times = np.unique(np.concatenate(list(shingle_sets(b.column(0).slice(i, 500), shingle))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "n"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, min(SHARE, n // SAMPLED)))) == 0).select("text").distinct()
    counts = some.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, times = found["h"].to_numpy().view(U), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], times[order]


def first_shingles(h: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set's distinct hashes, ascending, the first in the common order, one of which any set of the similarity shares."""
    if not len(h):
        return h
    known, times = frequent
    most = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    often = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        often = np.where(known[at] == h, times[at], 0)
    return h[np.argsort(often, kind="stable")[:most]]


def rest(docs: DataFrame, prints: DataFrame, leaves: DataFrame, near: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v) over column fp: all pairs whose sets have the similarity and that near, links (u, v), leaves in different components.

    Shingles are dealt as 48 bits of their hash, texts as 40 bits (ids): what meets by chance is told apart by the whole sets.
    """
    n = leaves.count()
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n, shingle))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                first = [first_shingles(h, similarity, frequent.value) for h in shingle_sets(part.column(1), shingle)]
                owner = np.repeat(np.arange(len(first)), [len(h) for h in first])
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(first) >> U(16)).view(np.int64)), part.column(0).take(pa.array(owner))], names=["h", "id"])

    short = lambda mark: F.shiftrightunsigned(mark, 24).alias("id")
    rows = docs.select(short(F.xxhash64("text")), F.col("text").cast("string")).mapInArrow(work, "h long, id long")
    dealt = rows.repartition(parts(docs.sparkSession, n, 2000), "h")
    several = lambda df, c: df.withColumns({"a": F.min(c).over(Window.partitionBy("h")), "b": F.max(c).over(Window.partitionBy("h"))}).filter("a != b")
    shared = stored(several(dealt, "id").select("h", "id").distinct(), "shared")
    roots = components(near).withColumnRenamed("node", "fp")
    sizes = prints.select(short(F.col("mark")), "fp", (F.octet_length("shingles") / 4).cast("long").alias("size")).distinct()
    named = stored(sizes.join(roots.hint("merge"), "fp", "left").select("id", "fp", "size", F.xxhash64(F.coalesce("root", "fp")).alias("root")), "named")
    mixed = stored(several(shared.join(named.select("id", "root").distinct().hint("merge"), "id"), "root").select("h", "id").distinct(), "mixed")
    forget(shared)
    places = stored(mixed.join(named.hint("merge"), "id").select("h", "fp", "root", "size").distinct(), "places")
    one, two = (places.select("h", *(F.col(c).alias(f"{c}_{k}") for c in ("fp", "root", "size"))) for k in (1, 2))
    fits = F.least("size_1", "size_2") >= F.greatest("size_1", "size_2") * similarity - 1
    met = one.join(two.hint("merge"), "h").filter(F.col("fp_1") < F.col("fp_2")).filter("root_1 != root_2").filter(fits)
    #: sets share at most what their first shingles do and all later ones of either; 2 more for hashes that fall together
    most = F.col("n") + F.ceil(F.greatest("size_1", "size_2") * similarity) + 2
    counted = met.groupBy("fp_1", "fp_2", "size_1", "size_2").agg(F.count("*").alias("n"))
    pairs = stored(counted.filter(most >= (F.col("size_1") + F.col("size_2")) * (similarity / (1 + similarity))).select("fp_1", "fp_2").distinct(), "pairs")
    slot = F.pmod(F.xxhash64("fp"), F.lit(SLOTS)).cast("int").alias("slot")
    asked = pairs.select(F.explode(F.array("fp_1", "fp_2")).alias("fp")).select(slot).distinct()
    few = prints.select("fp", "shingles", slot).join(F.broadcast(asked), "slot", "left_semi")  # asked has SLOTS rows at most
    sets = stored(few.groupBy("fp").agg(F.min("shingles").alias("shingles")), "sets")
    one, two = (sets.select(F.col("fp").alias(f"fp_{k}"), F.col("shingles").alias(f"set_{k}")) for k in (1, 2))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            k = np.array([jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= similarity for x, y in pairs], bool)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(k)), b.column(1).filter(pa.array(k))], names=["u", "v"])

    both = pairs.join(one.hint("merge"), "fp_1").join(two.hint("merge"), "fp_2")
    return both.select("fp_1", "fp_2", "set_1", "set_2").mapInArrow(check, "u binary, v binary")


def _leaves(prints: DataFrame) -> DataFrame:
    """(fp, least): least is (doc_id is null, doc_id, mark) of the fingerprint's first document."""
    return stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")).alias("least")), "leaves")


def grouped(leaves: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves without a link (fp, least), the others (fp, least, root), and the groups of these (root, least)."""
    roots = components(found).withColumnRenamed("node", "fp")
    rooted = stored(leaves.join(roots.hint("merge"), "fp", "left"), "rooted")
    linked = rooted.filter("root IS NOT NULL")
    return rooted.filter("root IS NULL").drop("root"), linked, linked.groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over fingerprints that differ in at most so many bits."""
    prints = stored(fingerprints(docs, shingle=shingle), "fingerprints")
    leaves = _leaves(prints)
    single, linked, groups = grouped(leaves, links(leaves, bits))
    #: a component of any size is dealt over salts, each of which gets a copy of the component's row
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("least", "first")
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["root", "salt"])
    classes = stored(single.select("fp", F.col("least.doc_id").alias("component_id")).unionByName(named.select("fp", F.col("first.doc_id").alias("component_id"))), "classes")
    return prints.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the least doc_id, of these the least hash of the
    text. Documents are near-duplicates if their sets of shingles have the similarity, or over others that are."""
    prints = stored(fingerprints(docs, shingle=shingle, sets=True), "fingerprints")
    leaves = _leaves(prints)
    near = stored(similar_links(prints, leaves, similarity), "near")
    single, _, groups = grouped(leaves, near.unionByName(rest(docs, prints, leaves, near, similarity, shingle)))
    firsts, own, mark = single.select("least").unionByName(groups.select("least")), fresh(docs, "near_id"), fresh(docs, "near_mark")
    kept = stored(firsts.select(F.coalesce("least.doc_id", F.lit(-(2**63))).alias(own), F.col("least.mark").alias(mark)), "kept")
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), mark: F.xxhash64("text")})
    return keyed.join(kept.hint("shuffle_hash"), [own, mark], "left_semi").dropDuplicates([own, mark]).drop(own, mark)
