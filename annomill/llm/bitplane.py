"""Token ids in binary files of bit- or byte-planes.

A file holds blocks of a fixed number of ids (the last may be shorter). A block's ids, unsigned 16 or 32 bits wide, are
transposed into planes: plane k holds bit k (or byte k) of every id. Each plane is compressed with zstandard. Layout:

    "BPL1"  planes...  chunk index  document index  footer (JSON)  footer length (4 bytes, little-endian)  "BPL\\n"

The chunk index has the place and length of each plane; the document index has doc_id, presence of doc_id, the place of
the document's first id in the file, and its number of ids. Files are numbered by (shard, part) in ascending doc_id order.

Spark moves and writes everything: documents are cut into shards by bounds of doc_id, sorted inside a shard, and a
streaming Arrow function cuts each shard into files, so that no task holds more than one file. A file is one row of a
text table whose line separator is the file's last byte; so Spark's own writer puts it in any store, with its commit
protocol, and a lost executor's tasks are run again. Files are read with Spark's binaryFile source.

Null text counts as empty; a null doc_id comes first; equal doc_ids are ordered by their ids. An empty table gives no file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, parts, shared_dir, stored
from .tokens import Encoder

HEAD, TAIL = b"BPL1", b"BPL\n"
DOC = np.dtype([("id", "<i8"), ("has_id", "u1"), ("at", "<i8"), ("n", "<i8")])
CHUNK = np.dtype([("block", "<i4"), ("plane", "<i4"), ("at", "<i8"), ("length", "<i8"), ("ids", "<i4")])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids."""
    octets = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.itemsize)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(ids.itemsize)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(8 * ids.itemsize)]


def from_planes(planes: list[bytes], n: int, kind: str, width: int) -> np.ndarray:
    """to_planes backwards."""
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1) if n else np.zeros((0, width), np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view(f"<u{width}").reshape(n)


def pack_file(ids: np.ndarray, docs: np.ndarray, about: dict, block: int, kind: str, level: int) -> bytes:
    import zstandard

    press, out, chunks, at = zstandard.ZstdCompressor(level=level), [HEAD], [], len(HEAD)
    for b, i in enumerate(range(0, len(ids), block)):
        part = ids[i : i + block]
        for k, plane in enumerate(to_planes(part, kind)):
            out.append(press.compress(plane))
            chunks.append((b, k, at, len(out[-1]), len(part)))
            at += len(out[-1])
    index, docs_index = np.array(chunks, CHUNK).tobytes(), press.compress(docs.tobytes())
    foot = json.dumps(about | {"n_ids": len(ids), "n_docs": len(docs), "block": block, "planes": kind, "width": ids.itemsize, "index_at": at, "docs_at": at + len(index), "docs_length": len(docs_index)}).encode()
    return b"".join([*out, index, docs_index, foot, len(foot).to_bytes(4, "little"), TAIL])


def footer(data: bytes) -> dict:
    if data[:4] != HEAD or data[-4:] != TAIL:
        raise ValueError("not a bit-plane file")
    n = int.from_bytes(data[-8:-4], "little")
    return json.loads(data[-8 - n : -8])


def read_block(data: bytes, about: dict, b: int) -> np.ndarray:
    """One block, by the chunk index alone."""
    import zstandard

    index = np.frombuffer(data[about["index_at"] : about["docs_at"]], CHUNK)
    rows = index[index["block"] == b]
    return from_planes([zstandard.decompress(data[r["at"] : r["at"] + r["length"]]) for r in rows], int(rows["ids"][0]), about["planes"], about["width"])


def read_docs(data: bytes, about: dict) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[about["docs_at"] : about["docs_at"] + about["docs_length"]]), DOC)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(shard, doc_id, ids as 16-bit binary), with the end id; shard is the doc_id's place among the bounds."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, cuts = Encoder.of(tokenizer), np.uint16(end_id).tobytes(), np.array(bounds, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = part.column(0)
                known = np.array([-(2**63) if x is None else x for x in ids.to_pylist()], np.int64)
                shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, known, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, pa.array([encoder.ids(t or "") + end for t in part.column(1).to_pylist()], pa.binary())], names=["shard", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "shard int, doc_id long, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, planes: str = "bit", block: int = 1 << 16, file_ids: int = 1 << 22, level: int = 3) -> None:
    """Writes documents (doc_id, text; further columns are ignored) as files of at most file_ids ids, or of one longer document.

    There are twice as many shards as the session's shuffle partitions, so their bounds, which every task gets, don't grow
    with the table; a shard of any size is sorted by Spark and read as a stream.
    """
    if planes not in ("bit", "byte") or block < 1:
        raise ValueError("planes is 'bit' or 'byte', block at least 1")
    spark = docs.sparkSession
    n = 2 * parts(spark, 0, 1)
    bounds = sorted({int(x) for x in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, shard, part = 0, None, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u2")
            counts = np.array([len(x) // 2 for _, x in held], np.int64)
            table = np.zeros(len(held), DOC)
            table["id"], table["has_id"] = [d or 0 for d, _ in held], [d is not None for d, _ in held]
            table["n"], table["at"] = counts, np.cumsum(counts) - counts
            return batch("file binary", file=[pack_file(ids, table, {"shard": shard, "part": part}, block, planes, level)[:-1]])

        for b in batches:
            for s, d, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (s != shard or size + len(x) // 2 > file_ids):
                    yield flush()
                    part = part + 1 if s == shard else 0
                    held, size = [], 0
                elif s != shard:
                    part = 0
                shard = s
                held.append((d, x))
                size += len(x) // 2
        if held:
            yield flush()

    ids = tokenised(docs, tokenizer, end_id, bounds)
    ordered = ids.repartitionById(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    files = ordered.mapInArrow(build, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone. ids_crc32 is over little-endian unsigned 32-bit ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def rows(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                about = footer(data)
                docs, width = read_docs(data, about), about["block"]
                blocks: dict[int, np.ndarray] = {}
                crcs = []
                for at, n in zip(docs["at"], docs["n"], strict=True):
                    first, last = int(at) // width, int(at + max(n, 1) - 1) // width
                    for k in [k for k in blocks if k < first]:
                        del blocks[k]
                    crc = 0
                    for k in range(first, last + 1):
                        if k not in blocks:
                            blocks[k] = read_block(data, about, k)
                        crc = zlib.crc32(blocks[k][max(0, at - k * width) : at + n - k * width].astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                m = len(docs)
                yield batch(OUT, shard=np.full(m, about["shard"]), part=np.full(m, about["part"]), doc_id=pa.array(docs["id"], pa.int64(), mask=docs["has_id"] == 0), at=docs["at"], n_tokens=docs["n"], ids_crc32=np.array(crcs, np.int64))

    OUT = "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long"
    #: every file is read once; its documents' counts give the places of files in a shard, and shards, whose number has a bound, are summed up in one task
    found = stored(files.mapInArrow(rows, OUT), "documents")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    index = found.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    shards = index.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("first"))
    inside = index.select("shard", "part", F.coalesce(F.sum("n").over(before(Window.partitionBy("shard").orderBy("part"))), F.lit(0)).alias("base"))
    places = inside.join(shards.hint("shuffle_hash"), "shard").select("shard", "part", (F.col("first") + F.col("base")).alias("base"))
    return found.join(places.hint("shuffle_hash"), ["shard", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    path = shared_dir(docs.sparkSession, "bitplanes")
    write_ids(docs, path, tokenizer, end_id, **options)
    return read_ids(docs.sparkSession, path)
