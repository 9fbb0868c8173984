"""Queries of the window, order and limit operators. Folds that SQL can't express are tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from annomill.operators import windows as W

from . import standins as S
from .registry import query


def bands_sql(name: str, rows: str, doc: str, by: str) -> str:
    """A fold as recursion over places: rows (doc, lo, hi, s, and more) in the order `by` get their band; a step's rows are all documents' next ones."""
    return f"""{name}_i AS (SELECT *, row_number() OVER (PARTITION BY {doc} ORDER BY {by}) AS k FROM ({rows})),
{name} AS (SELECT *, 0 AS band, hi AS reach FROM {name}_i WHERE k = 1 UNION ALL SELECT i.*, CASE WHEN reach - i.lo <= i.s THEN band + 1 ELSE band END, CASE WHEN reach - i.lo <= i.s THEN i.hi ELSE greatest(reach, i.hi) END
FROM {name} r JOIN {name}_i i ON i.{doc} = r.{doc} AND i.k = r.k + 1)"""


@query(f"WITH RECURSIVE {bands_sql('b', 'SELECT sketch_id, element_id, y AS lo, y + h AS hi, 0.15 * h AS s FROM elements_gold', 'sketch_id', 'lo, element_id')} SELECT sketch_id, element_id, band::INT AS band FROM b", "elements_gold")
def win_bands(spark, sf):
    e = S.elements_gold(spark, sf).withColumn("bottom", F.col("y") + F.col("h"))
    return W.bands(e, "sketch_id", "element_id", "y", "bottom", 0.15 * F.col("h")).drop("n_bands")


def rows_sql(doc: str) -> str:
    joins = "least(y1, i.y + i.h) - greatest(y0, i.y) > 0.5 * least(i.h, y1 - y0)"
    return f"""i AS (SELECT {doc}, element_id, x, y, h, row_number() OVER (PARTITION BY {doc} ORDER BY y, x, element_id) AS k FROM elements_gold),
r AS (SELECT {doc}, element_id, x, k, 0 AS row, y AS y0, y + h AS y1 FROM i WHERE k = 1 UNION ALL SELECT i.{doc}, i.element_id, i.x, i.k, CASE WHEN {joins} THEN row ELSE row + 1 END,
CASE WHEN {joins} THEN least(y0, i.y) ELSE i.y END, CASE WHEN {joins} THEN greatest(y1, i.y + i.h) ELSE i.y + i.h END FROM r JOIN i ON i.{doc} = r.{doc} AND i.k = r.k + 1)"""


@query(f"WITH RECURSIVE {rows_sql('frame_id')} SELECT frame_id, element_id, row::INT AS row FROM r", "elements_gold")
def win_row_group(spark, sf):
    return W.row_group(S.elements_gold(spark, sf), "frame_id", "element_id")


@query(f"WITH RECURSIVE {rows_sql('sketch_id')} SELECT sketch_id, element_id, row::INT AS row, row_number() OVER (PARTITION BY sketch_id ORDER BY row, x, element_id)::INT AS place FROM r", "elements_gold")
def win_reading_order(spark, sf):
    return W.reading_order(S.elements_gold(spark, sf), "sketch_id", "element_id")


@query("""WITH RECURSIVE t AS (SELECT sketch_id, element_id, row_number() OVER (PARTITION BY sketch_id ORDER BY element_id) AS k, CASE WHEN element_id % 7 = 0 THEN '9' || text WHEN element_id % 7 = 1 THEN split_part(text, ' ', 1) || ' 2' ELSE split_part(text, ' ', 1) END AS text FROM elements_gold),
s AS (SELECT *, coalesce(text, 'Screen ' || k) AS shown FROM t), u AS (SELECT *, regexp_replace(regexp_replace(lower(shown), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM s),
i AS (SELECT *, left(CASE WHEN slug = '' THEN 'screen' || k WHEN regexp_matches(slug, '^[a-z]') THEN slug ELSE 's_' || slug END, 28) AS base FROM u),
r AS (SELECT sketch_id, element_id, k, shown, base AS name, [base] AS used FROM i WHERE k = 1 UNION ALL
SELECT sketch_id, element_id, k, shown, name, list_append(used, name) FROM (SELECT i.sketch_id, i.element_id, i.k, i.shown, used, ([x FOR x IN list_concat([base], [base || '_' || n FOR n IN generate_series(2, i.k + 1)]) IF NOT list_contains(used, x)])[1] AS name FROM r JOIN i ON i.sketch_id = r.sketch_id AND i.k = r.k + 1))
SELECT sketch_id, element_id, name, left(shown, 40) AS title FROM r""", "elements_gold")
def win_dedupe_names(spark, sf):
    """First words of texts as names, some with a number of their own, some after a digit."""
    word, turn = F.split_part("text", F.lit(" "), F.lit(1)), F.col("element_id") % 7
    text = F.when(turn == 0, F.concat(F.lit("9"), "text")).when(turn == 1, F.concat(word, F.lit(" 2"))).otherwise(word)
    return W.dedupe_names(S.elements_gold(spark, sf).select("sketch_id", "element_id", text.alias("text")), "sketch_id", "element_id", "text")


@query("""WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_type, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a) SELECT user_id, island::INT AS island, any_value(event_type) AS event_type, least(count(*), 3)::INT AS n FROM i GROUP BY user_id, island""")
def win_collapse_runs(spark, sf):
    return W.collapse_runs(S.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", 3).select("user_id", "island", "event_type", "n")


@query("""WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a) SELECT event_id, island::INT AS island, ((row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) // 2)::INT AS part FROM i""")
def win_group_runs_capped(spark, sf):
    return W.group_runs_capped(S.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2).select("event_id", "island", "part")


@query("SELECT element_id, row_number() OVER (PARTITION BY sketch_id ORDER BY frame_id, floor(y + 0.5), floor(x + 0.5), element_id)::INT AS number FROM elements_pred", "elements_gold", "elements_pred")
def win_renumber(spark, sf):
    from annomill.functions.numeric import half_up

    return W.renumber(S.elements_pred(spark, sf), "sketch_id", ["frame_id", half_up(F.col("y")), half_up(F.col("x")), "element_id"]).select("element_id", "number")


STROKES = "SELECT sketch_id, stroke_id, min(t) AS t0, max(t) AS t1 FROM points GROUP BY ALL"


@query(f"WITH s AS ({STROKES}) SELECT sketch_id, stroke_id, coalesce(t0 - lag(t1) OVER w, 0)::BIGINT AS pause, round((t0 - first(t0) OVER w) / 60000, 6) AS minutes FROM s WINDOW w AS (PARTITION BY sketch_id ORDER BY stroke_id)", "points")
def win_lag_pause(spark, sf):
    strokes = S.points(spark, sf).groupBy("sketch_id", "stroke_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return W.lag_pause(strokes, "sketch_id", "stroke_id", "t0", "t1").select("sketch_id", "stroke_id", "pause", F.round("minutes", 6).alias("minutes"))


@query("WITH d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM points WINDOW w AS (PARTITION BY sketch_id, stroke_id ORDER BY seq)) SELECT sketch_id, stroke_id, seq::INT AS seq, round(sum(step) OVER (PARTITION BY sketch_id, stroke_id ORDER BY seq), 5) AS length FROM d", "points")
def win_arc_length(spark, sf):
    return W.arc_length(S.points(spark, sf), ["sketch_id", "stroke_id"], "seq").select("sketch_id", "stroke_id", "seq", F.round("length", 5).alias("length"))


RESAMPLE = """d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM points WINDOW w AS (PARTITION BY sketch_id, stroke_id ORDER BY seq)),
l AS (SELECT *, sum(step) OVER (PARTITION BY sketch_id, stroke_id ORDER BY seq) AS len FROM d), s AS (SELECT *, lag(len) OVER (PARTITION BY sketch_id, stroke_id ORDER BY seq) AS l0 FROM l),
t AS (SELECT sketch_id, stroke_id, max(len) AS total, arg_min(x, seq) AS fx, arg_min(y, seq) AS fy FROM s GROUP BY ALL), w AS (SELECT *, least(total * i / {last}, total) AS at0 FROM t, generate_series(0, {last}) g(i)),
h AS (SELECT w.*, s.l0, s.len, s.x0, s.y0, s.x, s.y, row_number() OVER (PARTITION BY w.sketch_id, w.stroke_id, i ORDER BY s.len) AS k FROM w LEFT JOIN s ON s.sketch_id = w.sketch_id AND s.stroke_id = w.stroke_id AND s.len > s.l0 AND at0 BETWEEN s.l0 AND s.len),
e AS (SELECT sketch_id, stroke_id, i, coalesce(x0 + (at0 - l0) / (len - l0) * (x - x0), fx) AS x, coalesce(y0 + (at0 - l0) / (len - l0) * (y - y0), fy) AS y FROM h WHERE k = 1 AND (total = 0 OR l0 IS NOT NULL))"""


@query(f"WITH {RESAMPLE.format(last=7)} SELECT sketch_id, stroke_id, i::INT AS i, round(x, 4) AS x, round(y, 4) AS y FROM e", "points")
def win_resample(spark, sf):
    return W.resample(S.points(spark, sf), ["sketch_id", "stroke_id"], "seq", 8).select("sketch_id", "stroke_id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


TURNS = """i AS (SELECT sketch_id, stroke_id, seq AS k, y, {least} AS s FROM {points}),
r AS (SELECT sketch_id, stroke_id, k, y AS anchor, 0 AS dir, 0 AS turns FROM i WHERE k = 1 UNION ALL
SELECT i.sketch_id, i.stroke_id, i.k, CASE WHEN abs(i.y - anchor) >= s OR (sign(i.y - anchor) = dir AND dir <> 0) THEN i.y ELSE anchor END, CASE WHEN abs(i.y - anchor) >= s THEN sign(i.y - anchor) ELSE dir END,
turns + CASE WHEN abs(i.y - anchor) >= s AND dir <> 0 AND sign(i.y - anchor) <> dir THEN 1 ELSE 0 END FROM r JOIN i ON i.sketch_id = r.sketch_id AND i.stroke_id = r.stroke_id AND i.k = r.k + 1)"""


@query(f"WITH RECURSIVE {TURNS.format(least='5.0', points='points')} SELECT sketch_id, stroke_id, arg_max(turns, k)::INT AS turns FROM r GROUP BY ALL", "points")
def win_direction_turns(spark, sf):
    return W.direction_turns(S.points(spark, sf), ["sketch_id", "stroke_id"], "seq", F.lit(5.0))


@query("WITH a AS (SELECT *, CASE WHEN x - lag(x + w) OVER o > 8 THEN 1 ELSE 0 END AS n FROM elements_gold WINDOW o AS (PARTITION BY sketch_id ORDER BY x, element_id)) SELECT element_id, (sum(n) OVER (PARTITION BY sketch_id ORDER BY x, element_id))::INT AS grp FROM a", "elements_gold")
def win_gap_groups(spark, sf):
    e = S.elements_gold(spark, sf).withColumn("right", F.col("x") + F.col("w"))
    return W.gap_groups(e, "sketch_id", ["x", "element_id"], "x", "right", 8.0).select("element_id", "grp")


@query("WITH a AS (SELECT sketch_id, y - lag(y) OVER (PARTITION BY sketch_id ORDER BY y) AS gap FROM elements_gold) SELECT sketch_id, count(*) FILTER (gap > 18) + 1 AS lines FROM a GROUP BY 1", "elements_gold")
def win_line_count(spark, sf):
    return W.line_count(S.elements_gold(spark, sf), "sketch_id", "y", 18.0)


@query("""WITH RECURSIVE p AS (SELECT frame_id, element_id, x, y, row_number() OVER (PARTITION BY frame_id ORDER BY y, x, element_id) AS k FROM elements_gold WHERE x - fx < 100),
i AS (SELECT p.*, coalesce(abs(q.x - p.x) < 18 AND abs(r.x - p.x) < 18 AND r.y - p.y < 250, false) AS good FROM p LEFT JOIN p q ON q.frame_id = p.frame_id AND q.k = p.k + 1 LEFT JOIN p r ON r.frame_id = p.frame_id AND r.k = p.k + 2),
f AS (SELECT frame_id, element_id, k, good AS taken, CASE WHEN good THEN k + 2 ELSE 0 END AS used FROM i WHERE k = 1 UNION ALL
SELECT i.frame_id, i.element_id, i.k, i.k > used AND good, CASE WHEN i.k > used AND good THEN i.k + 2 ELSE used END FROM f JOIN i ON i.frame_id = f.frame_id AND i.k = f.k + 1) SELECT frame_id, element_id FROM f WHERE taken""", "elements_gold")
def win_triples(spark, sf):
    """The left column of each frame."""
    return W.triples(S.elements_gold(spark, sf).filter("x - fx < 100"), "frame_id", "element_id", 18.0, 250.0)


@query("SELECT sketch_id, element_id, round(coalesce(sum(w / 0.5 + 120) OVER (PARTITION BY sketch_id ORDER BY floor(y / 80), x, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM elements_gold", "elements_gold")
def win_synthetic_time(spark, sf):
    e = S.elements_gold(spark, sf).withColumn("arc", F.col("w"))
    return W.synthetic_time(e, "sketch_id", "element_id", 80.0, 0.5, 120.0).select("sketch_id", "element_id", F.round("start", 6).alias("start"))


@query("SELECT doc_id, (k // 500)::INT AS shard, k AS place FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents)")
def win_shard_index(spark, sf):
    return W.shard_index(S.table(spark, sf, "documents"), "lang", ["doc_id"], 500).select("doc_id", "shard", "place")


@query("""WITH d AS (SELECT doc_id, n_chars, (('0x' || substr(sha1('b/row:' || doc_id), 1, 8))::BIGINT % greatest(1, ((SELECT count(*) FROM documents) + 199) // 200))::INT AS chunk FROM documents), p AS (SELECT *, ((row_number() OVER (PARTITION BY chunk ORDER BY n_chars, doc_id) - 1) // 16)::INT AS batch FROM d)
SELECT doc_id, chunk, batch, ('0x' || substr(sha1('b/batch:' || chunk || '/' || batch), 1, 8))::BIGINT AS turn FROM p""")
def win_length_buckets(spark, sf):
    return W.length_buckets(S.table(spark, sf, "documents"), "doc_id", "n_chars", seed="b", chunk=200, batch=16).select("doc_id", "chunk", "batch", "turn")


@query("""WITH l AS (SELECT *, sum((kind = 'launch')::INT) OVER (PARTITION BY device ORDER BY ts) AS life FROM run_log), n AS (SELECT * FROM l QUALIFY life = max(life) OVER (PARTITION BY device)),
v AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 WHEN kind IN ('end', 'fail') THEN -1 ELSE 0 END) OVER (PARTITION BY device, step ORDER BY ts) AS level FROM n),
o AS (SELECT device, step, arg_max(level, ts) AS level, least(0, min(level)) AS low, max(ts) FILTER (kind = 'start') AS started FROM v GROUP BY ALL)
SELECT device, arg_max(step, started) AS step FROM o WHERE level > low GROUP BY device""", "run_log")
def win_unfinished_step(spark, sf):
    return W.unfinished_steps(S.run_log(spark, sf), "device", "ts", "kind", "step")


@query("""WITH b AS (SELECT user_id, event_id, value, max(value) OVER w AS best, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN best > coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY event_id), '-inf'::DOUBLE) THEN k END AS rose FROM b)
SELECT event_id, best, (k - max(rose) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INT AS waited FROM r""")
def win_best_so_far(spark, sf):
    return W.best_so_far(S.table(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", "best", "waited")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def top_k_global(spark, sf):
    from annomill.operators.aggregates import count_by

    return count_by(S.table(spark, sf, "part"), "p_name").limit(20)


@query("SELECT lang, doc_id, k::INT AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def top_first_n_per_split(spark, sf):
    return W.top_per_group(S.table(spark, sf, "documents"), ["lang"], ["doc_id"], 5).select("lang", "doc_id", "rank")


@query("SELECT sketch_id, element_id FROM (SELECT sketch_id, element_id, row_number() OVER (PARTITION BY sketch_id ORDER BY w * h, element_id) AS k FROM elements_gold) WHERE k = 1", "elements_gold")
def top_best_one(spark, sf):
    area = F.struct(F.col("w") * F.col("h"), F.col("element_id"))
    return S.elements_gold(spark, sf).groupBy("sketch_id").agg(F.min_by("element_id", area).alias("element_id"))


@query("SELECT doc_id FROM documents ORDER BY ('0x' || substr(sha1('take:' || doc_id), 1, 8))::BIGINT, doc_id LIMIT 40")
def top_shuffle_take(spark, sf):
    return W.shuffle_take(S.table(spark, sf, "documents"), "doc_id", "take", 40).select("doc_id")


@query("SELECT source, row_number() OVER (ORDER BY substr(source, 4)::INT)::INT AS place FROM (SELECT DISTINCT source FROM documents)")
def top_natural_sort(spark, sf):
    return W.natural_sort(S.table(spark, sf, "documents").select("source").distinct(), "source").select("source", F.col("place").cast("int").alias("place"))


@query("SELECT c_custkey FROM customer ORDER BY ('0x' || substr(sha1('sample:' || c_custkey), 1, 8))::BIGINT, c_custkey LIMIT 25")
def top_sample_n(spark, sf):
    return W.shuffle_take(S.table(spark, sf, "customer"), "c_custkey", "sample", 25).select("c_custkey")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[:4]::VARCHAR AS kept FROM orders GROUP BY 1")
def top_cap_children(spark, sf):
    first = W.top_per_group(S.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)
    keys = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return keys.select("o_custkey", F.concat(F.lit("["), F.array_join(F.transform("k", lambda x: x.cast("string")), ", "), F.lit("]")).alias("kept"))


@query("SELECT 'doc' AS origin, doc_id AS id FROM documents UNION ALL SELECT 'benchmark', item_id FROM benchmark")
def set_union_sources(spark, sf):
    docs = S.table(spark, sf, "documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"))
    return docs.unionByName(S.table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id")))


@query("SELECT type, count(*) AS n FROM (SELECT sketch_id, type FROM elements_gold INTERSECT ALL SELECT sketch_id, type FROM elements_pred) GROUP BY 1", "elements_gold", "elements_pred")
def set_bag_intersect(spark, sf):
    a, b = S.elements_gold(spark, sf).select("sketch_id", "type"), S.elements_pred(spark, sf).select("sketch_id", "type")
    return a.intersectAll(b).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_minus(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id").subtract(S.table(spark, sf, "labels").select("doc_id"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n FROM documents GROUP BY 1")
def set_distinct(spark, sf):
    return S.table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n"))


@query("SELECT o_custkey AS doc, 'order' AS slot, o_orderkey AS id FROM orders UNION ALL SELECT c_custkey, 'customer', c_custkey FROM customer UNION ALL SELECT user_id, 'event', event_id FROM events")
def set_slots_union(spark, sf):
    pick = lambda t, d, s, i: S.table(spark, sf, t).select(F.col(d).alias("doc"), F.lit(s).alias("slot"), F.col(i).alias("id"))
    return pick("orders", "o_custkey", "order", "o_orderkey").unionByName(pick("customer", "c_custkey", "customer", "c_custkey")).unionByName(pick("events", "user_id", "event", "event_id"))
