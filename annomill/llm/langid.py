"""Language identification by prediction by partial matching.

A language's model is a tree of byte contexts of up to four bytes with the counts of the bytes that followed them. A byte
is coded in the longest context in which it was seen; each longer context that is known costs an escape (method C:
a context seen n times, followed by d different bytes, escapes with d / (n + d)), an unknown context costs nothing, and a
byte seen nowhere costs 8 bits more than the last escape. The statistics are frozen after the fit, so a byte's exact code
length depends on it and the four bytes before it alone: each distinct five-byte run of a batch is looked up once in every
language's tree and its length is scattered back to all its places. The language with the shortest code wins.

fit: of the rows with a language and a text of at most `longest` characters, about `most` of each language (those with the
least hashes of doc_id; fewer if there are fewer), so the model has a bound that doesn't depend on the corpus. Runs
are counted in tasks and added up by (language, run). A third of all rows in one language is no hot key: a task sends each
run once.

Texts count as UTF-8 bytes with A-Z lower-cased, four zero bytes before the first. predict: und with score 0 where the
text is null or has no letter; otherwise the score is the winner's posterior share, all languages equally likely before,
with code lengths tempered by `TEMPER` (bytes aren't independent). Ties go to the language that sorts first. With nothing
to learn from, every row is und. Null doc_ids hash as an empty string. Rows are never split or dropped, so repeated rows
get equal results; columns of the names added are replaced, all others kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batch, fresh, raw

#: Bytes of the longest context; bytes coded at a time; divisor of differences between code lengths.
ORDER, BLOCK, TEMPER = 4, 2_000_000, 8.0


def runs(text: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each byte from lo to hi: it and the four before it within its row, packed into one integer, oldest first."""
    n = hi - lo
    key = np.zeros(n, np.int64)
    row = np.searchsorted(at, np.arange(lo, hi), "right") - 1
    begin = at[row]
    for back in range(ORDER, -1, -1):
        place = np.arange(lo - back, hi - back)
        byte = text[np.maximum(place, 0)].astype(np.int64)
        byte += np.where((byte >= 65) & (byte <= 90), 32, 0)
        key = (key << 8) | np.where(place >= begin, byte, 0)
    return key


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each value's number among them."""
    kept = pa.array(key).dictionary_encode()
    return kept.dictionary.to_numpy(), kept.indices.to_numpy()


class Tree:
    """Counts of one language: for each order, the sorted runs of context and byte with the bits each costs there, and the sorted contexts with the bits of an escape."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.bits: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            run, where = np.unique(key & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            times = np.bincount(where, n, minlength=len(run))
            context, of = np.unique(run >> 8, return_inverse=True)
            total, kinds = np.bincount(of, times, minlength=len(context)), np.bincount(of, minlength=len(context))
            self.bits.append((run, -np.log2(times / (total + kinds)[of])))
            self.escape.append((context, -np.log2(kinds / (total + kinds))))

    def cost(self, key: np.ndarray) -> np.ndarray:
        """Code lengths in bits of each run's last byte."""
        out, left = np.zeros(len(key)), np.arange(len(key))
        for order in range(ORDER, -1, -1):
            part = key[left] & ((1 << 8 * (order + 1)) - 1)
            known, bits = self.bits[order]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = known[at] == part
            out[left[hit]] += bits[at[hit]]
            left, part = left[~hit], part[~hit] >> 8
            known, bits = self.escape[order]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            out[left] += np.where(known[at] == part, bits[at], 0.0)
        out[left] += 8.0
        return out


class Model:
    """The languages, in order, and their trees."""

    def __init__(self, trees: dict[str, Tree]):
        self.names, self.trees = sorted(trees), [trees[x] for x in sorted(trees)]

    def lengths(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rows, languages): the code length of each row in bits."""
        out = np.zeros((len(at) - 1, len(self.trees)))
        for lo in range(0, len(text), BLOCK):
            hi = min(len(text), lo + BLOCK)
            key, where = counted(runs(text, at, lo, hi))
            order = np.argsort(key)  # neighbours in the trees are looked up together
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            first, last = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
            row = np.searchsorted(at, np.arange(lo, hi), "right") - 1 - first
            for k, t in enumerate(self.trees):
                out[first:last, k] += np.bincount(row, t.cost(key[order])[place][where], minlength=last - first)
        return out


def fit(docs: DataFrame, learn: Column | None = None, *, most: int = 1000, longest: int = 60_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """learn: a condition for rows to learn from; most: rows of each language, in expectation; longest: characters of a row."""
    spark = docs.sparkSession
    fit_for = F.col(lang).isNotNull() & (F.char_length(text) <= longest) & (F.lit(True) if learn is None else learn)
    rows = docs.filter(fit_for).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"))
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(there)
    if not names:
        return Model({})
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, most / there[x]))) for x in names), F.lit(0.0))
    sample = rows.filter(F.pmod(F.col("h"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("lang").unique().to_pylist():
                column, at = raw(b.filter(pc.equal(b.column("lang"), x)).column("text"))
                for lo in range(0, len(column), BLOCK):
                    run, where = counted(runs(column, at, lo, min(len(column), lo + BLOCK)))
                    yield batch("lang string, run long, n long", lang=[x] * len(run), run=run, n=np.bincount(where, minlength=len(run)))

    sums = sample.mapInArrow(work, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    column = sums.column("lang").combine_chunks()
    run, n = sums.column("run").to_numpy(), sums.column("n").to_numpy()
    trees = {}
    for x in column.unique().to_pylist():
        own = pc.equal(column, x).to_numpy(zero_copy_only=False)
        trees[x] = Tree(run[own], n[own].astype(float))
    return Model(trees)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    letters = fresh(docs, "letters")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        names = np.array([*m.names, "und"], object)
        for b in batches:
            real = b.column(letters).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & bool(m.names)
            best, score = np.full(b.num_rows, len(m.names)), np.zeros(b.num_rows)
            if real.any():
                bits = m.lengths(*raw(b.column(text)))
                gap = np.exp((bits.min(axis=1, keepdims=True) - bits) * (np.log(2) / TEMPER))
                best = np.where(real, bits.argmin(axis=1), best)
                score = np.where(real, 1 / gap.sum(axis=1), 0.0)
            kept = [c for c in b.schema.names if c != letters]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.withColumn(letters, F.col(text).rlike(r"\p{L}")).mapInArrow(work, schema)
