"""Toxicity by compression distance with two zstandard dictionaries.

fit: from a bounded sample of labelled rows (`most` of either label, by a hash of doc_id, no text over `longest`
characters), one dictionary is trained on ordinary text and one on toxic text. A class's own vocabulary is what tells it
apart, so the toxic dictionary is trained on the toxic sample's words that stand in clearly more different surroundings
there than in ordinary text; counting surroundings, not occurrences, keeps a copied document from bringing its words in.
The toxic compressor has the toxic dictionary in front of the ordinary one, so both know ordinary text equally.

score: every window of twelve words of the whole text is compressed with either compressor. A text's features are the
largest gains of the toxic one, how many windows gain at least each threshold, the mean and the total; a logistic model
fitted on the sample turns them into a score, calibrated to the labels' own share. A feature counts only within the range
that the sample shows, so texts longer or shorter than any of it aren't judged by their length.

Inputs of a score are the text alone. Null and empty texts have no window and get the model's score for that. With no
labelled row of one class every score is that of the other (0 if there are none). Null or repeated labels: a null label
is left out, of a repeated doc_id the larger counts. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a window; sizes of the dictionaries; compression level and shortest match; thresholds of a window's gain, in bytes.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEVEL, MATCH, GAINS = 12, 32768, 4096, 12, 4, (3, 5)


def windows(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def surroundings(texts: list[str]) -> Counter:
    """How many different (word before, word after) each word has."""
    seen: set[tuple[bytes, bytes, bytes]] = set()
    for t in texts:
        w = t.encode().lower().split()
        seen.update(zip([b"", *w], w, [*w[1:], b""], strict=False))
    return Counter(x for _, x, _ in seen)


def _dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return b" ".join(samples)[-size:]


class Model:
    """Two dictionaries and the weights of the calibrated score."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", constant: float = 0.0):
        self.toxic, self.ordinary, self.constant = toxic, ordinary, constant
        self.weights = self.centre = self.scale = self.low = self.high = np.zeros(0)
        self._press: list = []

    def __getstate__(self):
        return self.__dict__ | {"_press": []}

    def _compressors(self) -> list:
        import zstandard

        if not self._press:
            for content in (self.ordinary, self.toxic + self.ordinary):
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
                known.precompute_compress(compression_params=how)
                self._press.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress)
        return self._press

    def features(self, text: str) -> np.ndarray:
        ordinary, toxic = self._compressors()
        parts = windows(text)
        gain = np.sort(np.array([len(ordinary(w)) - len(toxic(w)) for w in parts], float))[::-1]
        most = np.zeros(4)
        most[: len(gain)] = gain[:4]
        n, mean = np.log1p(len(gain)), gain.mean() if len(gain) else 0.0
        return np.array([*most, *(np.log1p((gain >= g).sum()) for g in GAINS), mean, n, most[0] * n, most[1] * n, gain.sum()])

    def score(self, text: str) -> float:
        if not len(self.weights):
            return self.constant
        z = self.weights[0] + ((np.clip(self.features(text), self.low, self.high) - self.centre) / self.scale) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_texts(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """share: of toxic rows among the labelled ones."""
    if not toxic or not ordinary:
        return Model(constant=1.0 if toxic else 0.0)
    one, other = surroundings(toxic), surroundings(ordinary)
    least, ratio = max(3 if len(toxic) >= 200 else 2, 0.01 * len(toxic)), len(toxic) / len(ordinary)
    own = {w for w, k in one.items() if k >= least and k > 4 * (other[w] + 1) * ratio} or {w for w, k in one.items() if k > 4 * other[w] * ratio}
    kept = [b" " + b" ".join(w for w in t.encode().lower().split() if w in own) for t in toxic]
    model = Model(_dictionary(TOXIC_BYTES, [x for x in kept if len(x) > 1], 64), _dictionary(ORDINARY_BYTES, [w for t in ordinary for w in windows(t)], 32))
    x = np.array([model.features(t) for t in [*toxic, *ordinary]])
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    model.centre, model.scale, model.low, model.high = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), x.min(axis=0), x.max(axis=0)
    z = np.c_[np.ones(len(x)), (x - model.centre) / model.scale]
    w = np.zeros(z.shape[1])
    for _ in range(40):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
    share = min(max(share, 1e-4), 1 - 1e-4)
    w[0] += np.log(share / (1 - share)) - np.log(len(toxic) / len(ordinary))
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, *, most: tuple[int, int] = (1000, 3000), longest: int = 60_000, learn=None) -> Model:
    """learn: a condition on doc_id for the labelled rows to learn from; most: toxic and ordinary rows at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = (known if learn is None else known.filter(learn)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.char_length("text") <= longest)
    taken = []
    for label, n in ((1, most[0]), (0, most[1])):
        chosen = known.filter((F.col("toxic") > 0).cast("int") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # chosen has n rows at most, and so has the result
        taken.append([r["text"] for r in sorted(found.collect())])
    return fit_texts(*taken, counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """docs with one more column; one of that name before is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                got = [held.value.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(name)
    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
