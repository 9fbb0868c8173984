"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, chat, decontam, langid, line_dedup, merkle, packing, resampling, simhash, substring, toxicity, turns, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op9_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as bit-plane files and read back."""
    return bitplane.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query()
def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 35-word window that starts anywhere else go."""
    return substring.dedup(table(spark, sf_dir, "documents"), window=35, text=False)


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query()
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.read_back(chat.conversations(chat.linear(rows.unionByName(more)))).withColumnRenamed("tree_id", "conv_id")


@query()
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, equal payloads as revisits of the one with the largest page_id, read back from the archives."""
    return warc.write_and_read(table(spark, sf_dir, "pages"), least=0).drop("payload")


@query()
def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, against its edited text's and the next document's."""
    return merkle.pairs(table(spark, sf_dir, "documents"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    scored = toxicity.score(docs, model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(line_dedup.SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows left out of every document."""
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the score and place of the alignment."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word")


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens with their lexical neighbours."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query()
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's word n-grams; 5 % of those with 20 words are drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, table(spark, sf_dir, "benchmark"), buckets=10_000, percent=5, least_words=20, seed=42, text=False)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; texts and languages are learnt only from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash of its turns, and the cheapest edits that mend it."""
    return turns.report(turns.blocks(turns.judged(turns.damage(table(spark, sf_dir, "conversations")))))
