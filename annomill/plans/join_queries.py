"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from annomill.operators import joins as J

from . import standins as S
from .registry import query

IOU = "CASE WHEN (p.w + 4) * (p.h + 4) + (g.w + 4) * (g.h + 4) > 0 THEN greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x) + 4) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y) + 4) END"
UNION = f"((p.w + 4) * (p.h + 4) + (g.w + 4) * (g.h + 4) - ({IOU}))"
PAIRS = f"SELECT g.sketch_id, g.element_id, p.element_id AS p_element_id, g.type, p.type AS p_type, ({IOU}) / {UNION} AS iou FROM elements_gold g JOIN elements_pred p ON g.sketch_id = p.sketch_id WHERE ({IOU}) / {UNION} >= 0.5"


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def jn_lookup_left(spark, sf):
    nation = S.table(spark, sf, "nation").filter("n_nationkey % 3 <> 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup_left(S.table(spark, sf, "customer"), nation, "c_nationkey", "n_name", "unknown").select("c_custkey", "n_name")


@query("SELECT g.element_id, g.type, p.type AS p_type FROM elements_gold g JOIN elements_pred p USING (element_id)", "elements_gold", "elements_pred")
def jn_pair_inner(spark, sf):
    return J.pair_inner(S.elements_gold(spark, sf), S.elements_pred(spark, sf), ["element_id"]).select("element_id", "type", "p_type")


@query("SELECT g.element_id, coalesce(p.score, 0)::DOUBLE AS score FROM elements_gold g LEFT JOIN (SELECT element_id, (w + h)::DOUBLE AS score FROM elements_pred) p USING (element_id)", "elements_gold", "elements_pred")
def jn_pair_left_zero(spark, sf):
    pred = S.elements_pred(spark, sf).select("element_id", (F.col("w") + F.col("h")).alias("score"))
    return J.pair_left_zero(S.elements_gold(spark, sf).select("element_id"), pred, ["element_id"], "score")


@query("SELECT element_id, type FROM elements_gold WHERE element_id IN (SELECT element_id FROM elements_pred)", "elements_gold", "elements_pred")
def jn_restrict_semi(spark, sf):
    return J.restrict_semi(S.elements_gold(spark, sf), S.elements_pred(spark, sf), ["element_id"]).select("element_id", "type")


@query("SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def jn_new_keys_anti(spark, sf):
    seen = S.table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return J.new_keys_anti(seen, S.table(spark, sf, "customer").filter("c_custkey % 4 <> 0"), ["c_custkey"])


@query(f"WITH pairs AS ({PAIRS}) SELECT 'miss' AS kind, element_id AS key FROM elements_gold WHERE element_id NOT IN (SELECT element_id FROM pairs) UNION ALL SELECT 'false_positive', element_id FROM elements_pred WHERE element_id NOT IN (SELECT p_element_id FROM pairs)", "elements_gold", "elements_pred")
def jn_unmatched_anti(spark, sf):
    gold, pred = S.elements_gold(spark, sf), S.elements_pred(spark, sf)
    found = J.greedy_match(J.iou_pairs(gold, pred, "sketch_id"), "sketch_id", "element_id", "p_element_id", "iou")
    return J.unmatched(gold, pred.withColumnRenamed("element_id", "p_element_id"), found, "element_id", "p_element_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def jn_dangling_anti(spark, sf):
    screens = S.table(spark, sf, "orders").filter("o_orderstatus <> 'F'")
    return J.dangling(S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), screens, "l_orderkey", "o_orderkey")


@query(f"""WITH r AS (SELECT doc_id, source, ('0x' || substr(sha1('peers:' || doc_id), 1, 8))::BIGINT AS mark FROM documents),
ringed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mark, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM r)
SELECT a.doc_id, j::INT AS rank, b.doc_id AS peer FROM ringed a, (VALUES (1), (2)) t(j), ringed b WHERE a.mark % 100 < 30 AND j < a.n AND b.source = a.source AND b.k = (a.k - 1 + j) % a.n + 1""")
def jn_same_group_peers(spark, sf):
    return J.same_group_peers(S.table(spark, sf, "documents"), "doc_id", "source", seed="peers", share=30)


@query("SELECT l_orderkey, list(p_type ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)[1] AS first_type, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def jn_index_deref(spark, sf):
    kinds = S.table(spark, sf, "part").select("p_partkey", "p_type")
    groups = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "p_type")))
    arrays = S.table(spark, sf, "lineitem").join(kinds, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(groups.alias("groups"))
    found = arrays.withColumn("picked", J.index_deref(F.sequence(F.lit(0), F.size("groups") - 1), F.col("groups")))
    return found.select("l_orderkey", F.col("picked")[0]["p_type"].alias("first_type"), F.size("picked").cast("long").alias("n"))


@query("SELECT l.sketch_id, l.frame_id, f.ord::INT AS ord, l.element_id FROM elements_gold l JOIN frames f ON l.sketch_id = f.sketch_id AND l.frame_id = f.frame_id", "frames", "elements_gold")
def jn_link_to_ordinal(spark, sf):
    links = S.elements_gold(spark, sf).select("sketch_id", "frame_id", "element_id")
    return J.link_to_ordinal(links, S.frames(spark, sf), "sketch_id", "frame_id", "frame_id", "ord").select("sketch_id", "frame_id", F.col("ord").cast("int").alias("ord"), "element_id")


@query("SELECT o_orderkey, coalesce(new, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN (VALUES ('1-URGENT', 'first'), ('5-LOW', 'last')) t(old, new) ON o_orderpriority = old")
def jn_rename_links(spark, sf):
    names = spark.createDataFrame([("1-URGENT", "first"), ("5-LOW", "last")], "o_orderpriority string, new string")
    return J.rename_links(S.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), names, "o_orderpriority", "new").select("o_orderkey", "o_orderpriority")


@query(f"SELECT sketch_id, element_id, p_element_id, round(iou, 6) AS iou FROM ({PAIRS})", "elements_gold", "elements_pred")
def jn_iou_pairs(spark, sf):
    found = J.iou_pairs(S.elements_gold(spark, sf), S.elements_pred(spark, sf), "sketch_id")
    return found.select("sketch_id", "element_id", "p_element_id", F.round("iou", 6).alias("iou"))


@query(f"SELECT sketch_id, element_id, p_element_id, round(iou, 6) AS iou FROM ({PAIRS})", "elements_gold", "elements_pred")
def jn_greedy_match(spark, sf):
    pairs = J.iou_pairs(S.elements_gold(spark, sf), S.elements_pred(spark, sf), "sketch_id")
    return J.greedy_match(pairs, "sketch_id", "element_id", "p_element_id", "iou").select("sketch_id", "element_id", "p_element_id", F.round("iou", 6).alias("iou"))


@query(f"""WITH RECURSIVE c AS (SELECT * FROM elements_pred UNION ALL SELECT sketch_id, frame_id, element_id + 50000, type, x + w / 4, y, w, h, text FROM elements_pred),
p AS (SELECT g.sketch_id, g.element_id, p.element_id AS p_element_id, round(({IOU}) / {UNION}, 9) AS iou FROM elements_gold g JOIN c p ON g.sketch_id = p.sketch_id WHERE ({IOU}) / {UNION} >= 0.5),
i AS (SELECT *, row_number() OVER (PARTITION BY sketch_id ORDER BY iou DESC, p_element_id DESC, element_id DESC) AS k FROM p),
r AS (SELECT sketch_id, element_id, p_element_id, iou, k, true AS taken, [element_id] AS gs, [p_element_id] AS ps FROM i WHERE k = 1 UNION ALL SELECT sketch_id, element_id, p_element_id, iou, k, free, CASE WHEN free THEN list_append(gs, element_id) ELSE gs END, CASE WHEN free THEN list_append(ps, p_element_id) ELSE ps END
FROM (SELECT i.*, gs, ps, NOT list_contains(gs, i.element_id) AND NOT list_contains(ps, i.p_element_id) AS free FROM r JOIN i ON i.sketch_id = r.sketch_id AND i.k = r.k + 1)) SELECT sketch_id, element_id, p_element_id, iou FROM r WHERE taken""", "elements_gold", "elements_pred")
def jn_greedy_contended(spark, sf):
    """Each predicted box stands twice, the second a quarter of its width further right."""
    gold, pred = S.elements_both(spark, sf)
    twice = pred.unionByName(pred.withColumns({"element_id": F.col("element_id") + 50_000, "x": F.col("x") + F.col("w") / 4}))
    pairs = J.iou_pairs(gold.select("sketch_id", "element_id", *"xywh"), twice.select("sketch_id", "element_id", *"xywh"), "sketch_id").withColumn("iou", F.round("iou", 9))
    return J.greedy_match(pairs, "sketch_id", "element_id", "p_element_id", "iou")


@query("SELECT e.sketch_id, element_id, frame_id AS in_frame, y + h / 2 <= 760 AS inside FROM elements_gold e", "elements_gold")
def jn_containing_first(spark, sf):
    f = S.frames(spark, sf).select("sketch_id", F.col("frame_id").alias("in_frame"), "ord", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"))
    points = S.elements_gold(spark, sf).select("sketch_id", "element_id", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    return J.containing_first(points, f, "sketch_id", "element_id", "in_frame", "ord")


def _cards(spark, sf):
    f = S.frames(spark, sf)
    cards = f.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("sketch_id", (F.col("frame_id") * 10 + F.col("c")).alias("card"), (F.col("fx") + 5).alias("x"), (5.0 + 200 * F.col("c")).alias("y"), F.lit(350.0).alias("w"), F.lit(195.0).alias("h"))
    return cards.unionByName(f.select("sketch_id", (F.col("frame_id") * 10 + 9).alias("card"), F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h")))


CARDS = "SELECT sketch_id, frame_id * 10 + c AS card, fx + 5 AS x, 5.0 + 200 * c AS y, 350.0 AS w, 195.0 AS h FROM frames, (VALUES (0), (1), (2), (3)) t(c) UNION ALL SELECT sketch_id, frame_id * 10 + 9, fx, fy, fw, fh FROM frames"


@query(f"""WITH cards AS ({CARDS}) SELECT e.sketch_id, element_id, arg_min(card, (c.w * c.h) * 1e9 + card % 10) AS card FROM elements_gold e JOIN cards c ON e.sketch_id = c.sketch_id
AND e.x + e.w / 2 BETWEEN c.x AND c.x + c.w AND e.y + e.h / 2 BETWEEN c.y AND c.y + c.h AND c.w * c.h > e.w * e.h GROUP BY ALL""", "frames", "elements_gold")
def jn_smallest_container(spark, sf):
    return J.smallest_container(S.elements_gold(spark, sf).select("sketch_id", "element_id", "x", "y", "w", "h"), _cards(spark, sf), "sketch_id", "element_id", "card")


ARROWS = "SELECT sketch_id, min(frame_id) FILTER (ord = 0) AS arrow, 10.0 + (min(frame_id) FILTER (ord = 0)) % 300 AS tx, 10.0 + 7 * ((min(frame_id) FILTER (ord = 0)) % 100) AS ty FROM frames GROUP BY sketch_id HAVING count(*) >= 2"


def _arrows(spark, sf):
    first = F.min(F.when(F.col("ord") == 0, F.col("frame_id")))
    a = S.frames(spark, sf).groupBy("sketch_id").agg(first.alias("arrow"), F.count("*").alias("n")).filter("n >= 2")
    return a.select("sketch_id", "arrow", (10.0 + F.col("arrow") % 300).alias("tx"), (10.0 + 7 * (F.col("arrow") % 100)).alias("ty"))


@query(f"""WITH arrows AS ({ARROWS}), near AS (SELECT a.sketch_id, arrow, element_id, w * h AS area, tx BETWEEN x - 14.4 AND x + w + 14.4 AND ty BETWEEN y - 14.4 AND y + h + 14.4 AS hit,
sqrt(greatest(x - tx, 0, tx - x - w) ** 2 + greatest(y - ty, 0, ty - y - h) ** 2) AS far FROM arrows a JOIN elements_gold e ON a.sketch_id = e.sketch_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sketch_id, arrow ORDER BY NOT hit, CASE WHEN hit THEN area ELSE far END, element_id) AS k FROM near WHERE hit OR far < 54)
SELECT sketch_id, arrow, element_id FROM ranked WHERE k = 1""", "frames", "elements_gold")
def jn_arrow_source(spark, sf):
    return J.arrow_source(_arrows(spark, sf), S.elements_gold(spark, sf).select("sketch_id", "element_id", "x", "y", "w", "h"), "sketch_id", "arrow", "element_id", 360.0)


@query(f"""WITH arrows AS ({ARROWS}), near AS (SELECT a.sketch_id, arrow, frame_id, ord, tx + 500 BETWEEN fx AND fx + fw AND ty BETWEEN fy AND fy + fh AS hit,
sqrt(greatest(fx - tx - 500, 0, tx + 500 - fx - fw) ** 2 + greatest(fy - ty, 0, ty - fy - fh) ** 2) AS far FROM arrows a JOIN frames f ON a.sketch_id = f.sketch_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sketch_id, arrow ORDER BY NOT hit, CASE WHEN hit THEN ord ELSE far END, ord) AS k FROM near)
SELECT sketch_id, arrow, frame_id AS in_frame, hit AS inside FROM ranked WHERE k = 1""", "frames")
def jn_arrow_target(spark, sf):
    f = S.frames(spark, sf).select("sketch_id", F.col("frame_id").alias("in_frame"), "ord", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"))
    heads = _arrows(spark, sf).select("sketch_id", "arrow", (F.col("tx") + 500).alias("px"), F.col("ty").alias("py"))
    return J.containing_first(heads, f, "sketch_id", "arrow", "in_frame", "ord")


WORDS = "SELECT sketch_id, element_id AS w_id, (i - 1)::INT AS w_at, ws[i] AS word, x + 4 + 30 * (i - 1) AS w_x, y + 5 AS w_y, 28.0 AS w_w, 12.0 AS w_h FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM elements_gold WHERE text IS NOT NULL))"


@query(f"""WITH words AS ({WORDS}) SELECT element_id, string_agg(word, ' ' ORDER BY w_y, w_x, w_id, w_at) AS words FROM words w JOIN elements_gold z ON w.sketch_id = z.sketch_id
WHERE greatest(0, least(w_x + w_w, x + w + h / 3) - greatest(w_x, x - h / 3)) * greatest(0, least(w_y + w_h, y + h + h / 3) - greatest(w_y, y - h / 3)) >= 0.5 * w_w * w_h GROUP BY element_id""", "elements_gold")
def jn_overlap_words(spark, sf):
    e = S.elements_gold(spark, sf)
    words = e.filter("text IS NOT NULL").select("sketch_id", F.col("element_id").alias("w_id"), F.posexplode(F.split("text", " ")).alias("w_at", "word"), "x", "y")
    words = words.select("sketch_id", "w_id", "w_at", "word", (F.col("x") + 4 + 30 * F.col("w_at")).alias("w_x"), (F.col("y") + 5).alias("w_y"), F.lit(28.0).alias("w_w"), F.lit(12.0).alias("w_h"))
    found = J.overlap_words(words, e.select("sketch_id", "element_id", "x", "y", "w", "h"), "sketch_id", "element_id")
    ordered = F.array_sort(F.collect_list(F.struct("w_y", "w_x", "w_id", "w_at", "word")))
    return found.groupBy("element_id").agg(F.array_join(F.transform(ordered, lambda s: s["word"]), " ").alias("words"))


@query("""WITH i AS (SELECT sketch_id, element_id, x + w / 2 AS cx FROM elements_gold WHERE type = 'icon'), t AS (SELECT sketch_id, element_id AS o, x + w / 2 AS r_cx, text AS label FROM elements_gold WHERE type = 'text')
SELECT i.sketch_id, i.element_id, coalesce(arg_min(label, o) FILTER (abs(cx - r_cx) < 28.8), 'Tab ' || i.element_id % 100) AS label FROM i LEFT JOIN t ON i.sketch_id = t.sketch_id GROUP BY i.sketch_id, i.element_id""", "elements_gold")
def jn_nearest_label(spark, sf):
    e = S.elements_gold(spark, sf)
    icons = e.filter("type = 'icon'").select("sketch_id", "element_id", (F.col("x") + F.col("w") / 2).alias("cx"))
    texts = e.filter("type = 'text'").select("sketch_id", F.col("element_id").alias("o"), (F.col("x") + F.col("w") / 2).alias("r_cx"), F.col("text").alias("label"))
    return J.nearest_by_x(icons, texts, "sketch_id", "element_id", 28.8, "label", "o", F.concat(F.lit("Tab "), (F.col("element_id") % 100).cast("string")))


@query("SELECT sketch_id, element_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY sketch_id ORDER BY x, element_id) AS place FROM elements_gold WHERE y + h / 2 BETWEEN 0 AND 76) WHERE place <= 4", "elements_gold")
def jn_band_members(spark, sf):
    return J.band_members(S.elements_gold(spark, sf), "sketch_id", "element_id", 0.0, 76.0, 4).select("sketch_id", "element_id", "place")


@query("""WITH s AS (SELECT sketch_id, element_id, x, y, w, h FROM elements_pred), l AS (SELECT sketch_id, x, y, w * 0.95 AS w, h FROM elements_gold WHERE type IN ('img', 'card'))
SELECT sketch_id, element_id FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.sketch_id = s.sketch_id AND greatest(0, least(s.x + s.w, l.x + l.w) - greatest(s.x, l.x)) * greatest(0, least(s.y + s.h, l.y + l.h) - greatest(s.y, l.y)) / (s.w * s.h) >= 0.8)""", "elements_gold", "elements_pred")
def jn_covered_anti(spark, sf):
    large = S.elements_gold(spark, sf).filter("type IN ('img', 'card')").select("sketch_id", "x", "y", (F.col("w") * 0.95).alias("w"), "h")
    return J.covered_anti(S.elements_pred(spark, sf).select("sketch_id", "element_id", "x", "y", "w", "h"), large, "sketch_id", "element_id").select("sketch_id", "element_id")


@query("""WITH m AS (SELECT sketch_id, element_id, y + h / 2 AS cy FROM elements_gold WHERE type = 'listmark'), r AS (SELECT sketch_id, (y // 100)::INT AS row_no, min(y) AS y0, max(y + h) AS y1 FROM elements_gold GROUP BY 1, 2)
SELECT m.sketch_id, element_id, min(row_no) AS row_no FROM m JOIN r ON m.sketch_id = r.sketch_id AND cy BETWEEN y0 - 10.8 AND y1 + 10.8 GROUP BY 1, 2""", "elements_gold")
def jn_mark_to_row(spark, sf):
    e = S.elements_gold(spark, sf)
    marks = e.filter("type = 'listmark'").select("sketch_id", "element_id", (F.col("y") + F.col("h") / 2).alias("cy"))
    rows = e.groupBy("sketch_id", F.floor(F.col("y") / 100).cast("int").alias("row_no")).agg(F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return J.mark_to_row(marks, rows, "sketch_id", "element_id", "row_no", 10.8)


@query("""WITH c AS (SELECT e.sketch_id, e.element_id, t.element_id AS text_id, e.y - t.y - t.h AS away FROM elements_gold e JOIN elements_gold t ON e.sketch_id = t.sketch_id AND t.type IN ('text', 'heading')
AND e.y - t.y - t.h BETWEEN 0 AND 80 AND t.x < e.x + e.w AND e.x < t.x + t.w WHERE e.type IN ('input', 'img', 'switch')) SELECT sketch_id, element_id, text_id FROM (SELECT *, row_number() OVER (PARTITION BY sketch_id, element_id ORDER BY away, text_id) AS k FROM c) WHERE k = 1""", "elements_gold")
def jn_neighbour_text(spark, sf):
    e = S.elements_gold(spark, sf).select("sketch_id", "element_id", "type", "x", "y", "w", "h")
    texts = e.filter("type IN ('text', 'heading')").drop("type").withColumnRenamed("element_id", "text_id")
    return J.neighbour_text(e.filter("type IN ('input', 'img', 'switch')"), texts, "sketch_id", "element_id", "text_id", 80.0)


@query("SELECT s.kind, f.flag, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'pending' ELSE 'done' END AS status FROM (SELECT DISTINCT event_type AS kind FROM events) s, (SELECT unnest(['A', 'N', 'R', 'X']) AS flag) f LEFT JOIN (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1) r ON r.flag = f.flag")
def jn_method_grid(spark, sf):
    kinds = S.table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct()
    expected = kinds.withColumn("flag", F.explode(F.array(*map(F.lit, "ANRX"))))
    results = S.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return J.method_grid(expected, results, ["flag"], "n").select("kind", "flag", F.coalesce("n", F.lit(0)).alias("n"), "status")


@query(f"WITH pairs AS ({PAIRS}) SELECT p.element_id, coalesce(g.text, p.text) AS text FROM elements_pred p LEFT JOIN pairs m ON p.element_id = m.p_element_id LEFT JOIN elements_gold g ON g.element_id = m.element_id", "elements_gold", "elements_pred")
def jn_attach_gold_text(spark, sf):
    gold, pred = S.elements_both(spark, sf)
    matched = J.greedy_match(J.iou_pairs(*(e.select("sketch_id", "element_id", *"xywh") for e in (gold, pred)), "sketch_id"), "sketch_id", "element_id", "p_element_id", "iou").select("element_id", "p_element_id")
    return J.attach_text(pred.withColumnRenamed("element_id", "p_element_id").select("p_element_id", "text"), gold, matched, "p_element_id", "element_id").select(F.col("p_element_id").alias("element_id"), "text")


@query("""SELECT a.sketch_id, a.element_id AS a, b.element_id AS b FROM elements_gold a JOIN elements_gold b ON a.sketch_id = b.sketch_id AND a.element_id < b.element_id AND a.type = 'text' AND b.type = 'text'
WHERE least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 0.5 * least(a.h, b.h) AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) < 60""", "elements_gold")
def jn_same_line_pairs(spark, sf):
    return J.same_line_pairs(S.elements_gold(spark, sf).filter("type = 'text'").select("sketch_id", "element_id", "x", "y", "w", "h"), "sketch_id", "element_id", 60.0)


@query("WITH s AS (SELECT DISTINCT sketch_id, stroke_id FROM points) SELECT sketch_id, stroke_id, CASE WHEN stroke_id % 3 = 0 THEN 'text' ELSE 'shape' END AS cls, CASE WHEN stroke_id % 3 = 0 THEN (stroke_id // 3)::INT ELSE -1 END AS grp FROM s", "points")
def jn_step_to_stroke(spark, sf):
    strokes = S.points(spark, sf).select("sketch_id", "stroke_id").distinct()
    steps = strokes.filter("stroke_id % 3 = 0").groupBy("sketch_id", F.floor(F.col("stroke_id") / 3).cast("int").alias("grp")).agg(F.collect_set("stroke_id").alias("strokes")).withColumn("cls", F.lit("text"))
    return J.step_to_stroke(steps, strokes, "sketch_id", "stroke_id").select("sketch_id", "stroke_id", "cls", "grp")
