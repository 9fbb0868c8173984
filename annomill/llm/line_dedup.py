"""Removal of repeated three-line windows, with DataFrame functions alone.

Each run of three consecutive lines is hashed. Windows that stand in more than one place are found by one aggregation
(partial before the shuffle, so a very frequent window is a few rows), which keeps the first place by (doc_id, a hash of
the text, line). All later places are found by joining the windows with these; the lines they cover are merged per
document and left out. Windows of blank lines alone don't count, and texts of fewer lines have no window.

Line feeds part lines; texts are joined again with line feeds. Null text stays null. Rows equal in doc_id and text count
as one place and get the same result. A null doc_id comes first. Columns besides are kept; n_chars, where it is there, is
counted again for texts that change. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """(id, mark, at, h, g): place and two hashes of each window; at counts from 1."""
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("lines")).filter(F.size("lines") >= size)
    runs = [F.slice("lines", F.lit(k + 1), F.size("lines") - (size - 1)) for k in range(size)]
    each = lines.select("id", "mark", F.posexplode(F.arrays_zip(*(r.alias(f"l{k}") for k, r in enumerate(runs)))).alias("at", "w"))
    names = [f"w.l{k}" for k in range(size)]
    full = F.trim(F.concat(*names)) != ""
    return each.filter(full).select("id", "mark", (F.col("at") + 1).alias("at"), F.xxhash64(*names).alias("h"), F.hash(*names).alias("g"))


def later(docs: DataFrame, size: int = 3) -> DataFrame:
    """(id, mark, places): where windows start that stand somewhere before."""
    found = windows(docs, size)
    place = F.struct("id", "mark", "at")
    repeated = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h", "g", "first")
    again = found.join(repeated.hint("merge"), ["h", "g"]).filter(place != F.col("first"))
    return again.groupBy("id", "mark").agg(F.collect_set("at").alias("places"))


def dedup(docs: DataFrame, size: int = 3, *, report: bool = False) -> DataFrame:
    """docs with the lines of later occurrences left out; with report, columns n_lines and n_removed too."""
    own, mark, where, lines = (fresh(docs, x) for x in ("later_id", "later_mark", "later_places", "later_lines"))
    places = later(docs, size).withColumnsRenamed({"id": own, "mark": mark, "places": where})
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(mark))
    joined = docs.join(places.hint("shuffle_hash"), on, "left").withColumn(lines, F.split("text", "\n"))
    covered = F.flatten(F.transform(where, lambda p: F.sequence(p, p + (size - 1))))
    rest = F.array_except(F.sequence(F.lit(1), F.size(lines)), covered)
    changed = F.col(where).isNotNull()
    text = F.when(changed, F.array_join(F.transform(rest, lambda i: F.element_at(lines, i)), "\n")).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.when(changed, F.char_length(text)).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    if report:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
        out += [n.cast("long").alias("n_lines"), F.when(changed, F.size(lines) - F.size(rest)).otherwise(0).cast("long").alias("n_removed")]
    return joined.select(*out)


#: The query's rows in DuckDB SQL, on texts themselves instead of hashes.
SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, i AS pos, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
           FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS i FROM docs WHERE len(lines) >= 3)
           WHERE trim(lines[i] || lines[i + 1] || lines[i + 2], ' ') <> ''),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM places),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM ranked, (VALUES (0), (1), (2)) t(j) WHERE k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM docs) l
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, (coalesce(len(d.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
