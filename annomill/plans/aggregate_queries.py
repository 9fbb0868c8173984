"""Queries of the aggregate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from annomill.operators import aggregates as A
from annomill.operators import joins as J

from . import standins as S
from .join_queries import PAIRS
from .registry import query


def _matched(spark, sf, both=None):
    gold, pred = both or S.elements_both(spark, sf)
    pairs = J.iou_pairs(gold, pred, "sketch_id")
    return J.greedy_match(pairs, "sketch_id", "element_id", "p_element_id", "iou", ["type", "p_type", *"xywh", *("p_" + c for c in "xywh")])


@query("SELECT type, count(*) AS n FROM elements_gold GROUP BY type", "elements_gold")
def ag_count_by(spark, sf):
    return A.count_by(S.elements_gold(spark, sf), "type")


@query("SELECT o_orderpriority AS split, count(*) AS n, count(DISTINCT o_custkey) AS entities, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def ag_split_summary(spark, sf):
    return A.split_summary(S.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "split"), "split", "o_custkey", F.col("o_orderstatus") != "F")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS most FROM events WHERE NOT isnan(value) GROUP BY 1")
def ag_quantiles(spark, sf):
    q = A.quantiles(S.table(spark, sf, "events"), ["event_type"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return q.select("event_type", *(F.round(c, 6).alias(c) for c in ("median", "p10", "p90")), "most")


@query("SELECT event_type, list(value ORDER BY value)[len(list(value)) // 2 + 1] AS median FROM events GROUP BY 1")
def ag_upper_median(spark, sf):
    return A.upper_median(S.table(spark, sf, "events"), ["event_type"], "value")


@query("SELECT t, count(*) AS n FROM (SELECT 'order' AS t FROM orders UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'line' END FROM lineitem) GROUP BY t")
def ag_node_type_counts(spark, sf):
    lines = S.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "returned").otherwise("line").alias("t"))
    nodes = S.table(spark, sf, "orders").select(F.lit("order").alias("t")).unionByName(S.table(spark, sf, "customer").select(F.lit("customer").alias("t"))).unionByName(lines)
    return A.count_by(nodes, "t")


@query("SELECT type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM elements_gold GROUP BY type", "elements_gold")
def ag_class_share(spark, sf):
    return A.class_share(S.elements_gold(spark, sf), "type").select("type", "n", F.round("share", 9).alias("share"))


@query("SELECT p_name, count(*) AS n FROM part WHERE regexp_full_match(p_name, '[A-Za-z]+( [A-Za-z]+)*') AND len(string_split(p_name, ' ')) <= 2 GROUP BY 1 ORDER BY n DESC, p_name LIMIT 50")
def ag_label_pool(spark, sf):
    return A.label_pool(S.table(spark, sf, "part"), "p_name", limit=50)


@query(f"""WITH pairs AS ({PAIRS}), n AS (SELECT (SELECT count(*) FROM pairs)::DOUBLE AS tp, (SELECT count(*) FROM elements_pred)::DOUBLE AS np, (SELECT count(*) FROM elements_gold)::DOUBLE AS ng)
SELECT round(tp / np, 9) AS precision, round(tp / ng, 9) AS recall, round(2 * tp / (np + ng), 9) AS f1 FROM n""", "elements_gold", "elements_pred")
def ag_detection_prf(spark, sf):
    docs = lambda df, n: df.groupBy("sketch_id").agg(F.count("*").alias(n))
    gold, pred = S.elements_both(spark, sf)
    counts = docs(gold, "gold").join(docs(pred, "pred"), "sketch_id", "full").join(docs(_matched(spark, sf, (gold, pred)), "tp").hint("merge"), "sketch_id", "left").na.fill(0)
    return A.prf(counts, "tp", "pred", "gold").select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"SELECT type, p_type, count(*) AS n FROM ({PAIRS}) GROUP BY ALL", "elements_gold", "elements_pred")
def ag_confusion(spark, sf):
    return A.confusion(_matched(spark, sf), "type", "p_type")


@query(f"SELECT type, count(*) AS n, round(avg(CASE WHEN type = p_type THEN 1 ELSE 0 END), 9) AS accuracy FROM ({PAIRS}) GROUP BY type", "elements_gold", "elements_pred")
def ag_type_accuracy(spark, sf):
    return A.type_accuracy(_matched(spark, sf), "type", "p_type").select("type", "n", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN quality = (n_chars > 1000)::INT THEN 1 ELSE 0 END), 9) AS accuracy FROM labels JOIN documents USING (doc_id)")
def ag_sequence_accuracy(spark, sf):
    rows = S.table(spark, sf, "labels").join(S.table(spark, sf, "documents"), "doc_id")
    item = F.struct("doc_id", "quality", (F.col("n_chars") > 1000).cast("int").alias("guess"))
    seqs = rows.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("s")).select(F.transform("s", lambda x: x["quality"]).alias("g"), F.transform("s", lambda x: x["guess"]).alias("p"))
    return A.sequence_accuracy(seqs, "g", "p").select("n", F.round("accuracy", 9).alias("accuracy"))


BAGS = """WITH g AS (SELECT sketch_id, type, count(*) AS g FROM elements_gold GROUP BY ALL), p AS (SELECT sketch_id, type, count(*) AS p FROM elements_pred GROUP BY ALL),
b AS (SELECT sketch_id, sum(least(coalesce(g, 0), coalesce(p, 0))) AS c, sum(coalesce(g, 0)) AS ng, sum(coalesce(p, 0)) AS np FROM g FULL JOIN p USING (sketch_id, type) GROUP BY sketch_id)"""


@query(f"{BAGS} SELECT f.sketch_id, round(CASE WHEN coalesce(ng + np, 0) = 0 THEN 1 ELSE 2 * c / (ng + np) END, 9)::DOUBLE AS f1 FROM (SELECT DISTINCT sketch_id FROM frames) f LEFT JOIN b USING (sketch_id)", "frames", "elements_gold", "elements_pred")
def ag_multiset_f1(spark, sf):
    found = A.multiset_f1(S.elements_gold(spark, sf), S.elements_pred(spark, sf), S.frames(spark, sf), "sketch_id", "type")
    return found.select("sketch_id", F.round("f1", 9).alias("f1"))


@query(f"{BAGS} SELECT f.sketch_id, round(CASE WHEN coalesce(ng, 0) = 0 THEN 1 ELSE c / ng END, 9)::DOUBLE AS recall FROM (SELECT DISTINCT sketch_id FROM frames) f LEFT JOIN b USING (sketch_id)", "frames", "elements_gold", "elements_pred")
def ag_multiset_recall(spark, sf):
    found = A.multiset_recall(S.elements_gold(spark, sf), S.elements_pred(spark, sf), S.frames(spark, sf), "sketch_id", "type")
    return found.select("sketch_id", F.round("recall", 9).alias("recall"))


@query("SELECT round(avg(quality), 9) AS quality, count(quality) AS n_quality, round(avg(toxic), 9) AS toxic, count(toxic) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def ag_mean_defined(spark, sf):
    found = A.mean_defined(S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left"), "quality", "toxic")
    return found.select(F.round("quality", 9).alias("quality"), "n_quality", F.round("toxic", 9).alias("toxic"), "n_toxic")


@query(f"WITH m AS (SELECT g.x AS gx, g.y AS gy, g.w AS gw, g.h AS gh, p.x, p.y, p.w, p.h FROM ({PAIRS}) a JOIN elements_gold g ON a.element_id = g.element_id JOIN elements_pred p ON a.p_element_id = p.element_id) SELECT round(stddev_pop(d), 8) AS box_std FROM (SELECT unnest([x - gx, y - gy, w - gw, h - gh]) / 360 AS d FROM m)", "elements_gold", "elements_pred")
def ag_noise_offsets(spark, sf):
    return A.noise_offsets(_matched(spark, sf), 360.0).select(F.round("box_std", 8).alias("box_std"))


@query(f"SELECT g.type, round(avg(CASE WHEN a.element_id IS NULL THEN 1 ELSE 0 END), 9) AS miss_rate FROM elements_gold g LEFT JOIN ({PAIRS}) a ON a.element_id = g.element_id GROUP BY g.type", "elements_gold", "elements_pred")
def ag_measure_noise_misses(spark, sf):
    gold, pred = S.elements_both(spark, sf)
    found = A.miss_rates(gold, _matched(spark, sf, (gold, pred)), "element_id", "type")
    return found.select("type", F.round("miss_rate", 9).alias("miss_rate"))


@query(f"SELECT type, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY type), 9) AS p FROM ({PAIRS}) GROUP BY type, p_type", "elements_gold", "elements_pred")
def ag_measure_noise_confusion(spark, sf):
    return A.row_shares(A.confusion(_matched(spark, sf), "type", "p_type"), "type").select("type", "p_type", "n", F.round("p", 9).alias("p"))


@query(f"""WITH f AS (SELECT p.type FROM elements_pred p WHERE element_id NOT IN (SELECT p_element_id FROM ({PAIRS})) AND sketch_id IN (SELECT sketch_id FROM elements_gold)), n AS (SELECT count(DISTINCT sketch_id) AS n FROM elements_gold WHERE sketch_id IN (SELECT sketch_id FROM elements_pred))
SELECT type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share, round(sum(count(*)) OVER () / (SELECT n FROM n), 9)::DOUBLE AS per_sketch FROM f GROUP BY type""", "elements_gold", "elements_pred")
def ag_measure_noise_extras(spark, sf):
    gold, pred = S.elements_both(spark, sf)
    both = gold.select("sketch_id").distinct().join(pred.select("sketch_id").distinct().hint("merge"), "sketch_id")
    found = A.false_positives(pred.withColumnRenamed("element_id", "p_element_id"), _matched(spark, sf, (gold, pred)), both, "sketch_id", "p_element_id", "type")
    return found.select("type", "n", F.round("share", 9).alias("share"), F.round("per_sketch", 9).alias("per_sketch"))


@query(f"""WITH m AS (SELECT g.x AS gx, g.y AS gy, g.w AS gw, g.h AS gh, p.x, p.y, p.w, p.h, CASE WHEN f.ord = 1 THEN 400 ELSE fw END AS fw FROM ({PAIRS}) a JOIN elements_gold g ON a.element_id = g.element_id JOIN elements_pred p ON a.p_element_id = p.element_id JOIN frames f ON f.frame_id = g.frame_id)
SELECT round(stddev_pop(d), 8) AS box_std FROM (SELECT unnest([x - gx, y - gy, w - gw, h - gh]) / fw AS d FROM m)""", "frames", "elements_gold", "elements_pred")
def ag_noise_offsets_by_frame(spark, sf):
    """Offsets over each frame's own width; second frames are wider."""
    wide = S.frames(spark, sf).select("sketch_id", F.col("frame_id").alias("__f"), F.when(F.col("ord") == 1, 400.0).otherwise(F.col("fw")).alias("fw"))
    pairs = _matched(spark, sf).withColumn("__f", F.floor(F.col("element_id") / 100_000))
    return A.noise_offsets(pairs.join(wide.hint("merge"), ["sketch_id", "__f"]), F.col("fw")).select(F.round("box_std", 8).alias("box_std"))


@query("""WITH h AS (SELECT *, props->>'k' AS k, event_id % 5 < 3 AS hit FROM events), c AS (SELECT user_id, event_type, count(*) FILTER (hit) AS n, min(event_id) FILTER (hit) AS first, count(*) AS a FROM h GROUP BY ALL), t AS (SELECT user_id, sum(n) AS n, sum(a) AS a FROM c GROUP BY 1),
b AS (SELECT user_id, event_type FROM c WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1), v AS (SELECT t.user_id, CASE WHEN n / a < 0.5 THEN 'noise' ELSE event_type END AS vote FROM t LEFT JOIN b USING (user_id)),
k AS (SELECT user_id, event_type, event_id % 3 AS kind, count(*) AS n, min(event_id) AS first FROM h WHERE hit GROUP BY user_id, event_type, event_id % 3 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, first) = 1)
SELECT v.user_id, vote, kind FROM v LEFT JOIN k ON k.user_id = v.user_id AND k.event_type = v.vote""")
def ag_class_vote(spark, sf):
    hits = S.table(spark, sf, "events").withColumns({"hit": F.col("event_id") % 5 < 3, "kind": F.col("event_id") % 3})
    return A.class_vote(hits, ["user_id"], "event_type", "kind", "event_id")


@query("WITH s AS (SELECT user_id, event_type, sum(event_id % 7) AS s FROM events GROUP BY ALL) SELECT user_id, event_type, s::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS k FROM s) WHERE k = 1")
def ag_pool_argmax(spark, sf):
    return A.pool_argmax(S.table(spark, sf, "events").withColumn("p", F.col("event_id") % 7), ["user_id"], "event_type", "p")


@query("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (event_id % 5 < 3) AS n, min(event_id) FILTER (event_id % 5 < 3) AS first, count(*) AS a FROM events GROUP BY ALL),
t AS (SELECT user_id, sum(n) AS n, sum(a) AS a FROM c GROUP BY 1), b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c WHERE n > 0)
SELECT t.user_id, CASE WHEN n / a < 0.5 THEN 'noise' ELSE event_type END AS vote FROM t LEFT JOIN b ON t.user_id = b.user_id AND k = 1""")
def ag_majority_vote(spark, sf):
    return A.majority_vote(S.table(spark, sf, "events").withColumn("hit", F.col("event_id") % 5 < 3), ["user_id"], "event_type", "event_id")


@query("SELECT sketch_id, frame_id, round(min(x), 1) AS x, round(min(y), 1) AS y, round(max(x + w) - min(x), 1) AS w, round(max(y + h) - min(y), 1) AS h FROM elements_gold GROUP BY ALL", "elements_gold")
def ag_bbox_union(spark, sf):
    return A.bbox_union(S.elements_gold(spark, sf), ["sketch_id", "frame_id"])


@query("SELECT stage, round(quantile_cont(ms, 0.5), 6) AS median_ms, count(*) AS n FROM stage_times GROUP BY 1", "stage_times")
def ag_stage_latency(spark, sf):
    return A.stage_latency(S.stage_times(spark, sf), "stage", "ms").select("stage", F.round("median_ms", 6).alias("median_ms"), "n")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT unnest(['click', 'view', 'purchase']) AS stage), v AS (SELECT user_id, event_type, max(event_id) AS us FROM events GROUP BY ALL)
SELECT stage, round(quantile_cont(coalesce(us, 0) / 1000, 0.5), 6) AS median_ms FROM u CROSS JOIN s LEFT JOIN v ON v.user_id = u.user_id AND v.event_type = stage GROUP BY 1""")
def ag_stage_latency_map(spark, sf):
    last = S.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("us"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "us"))).alias("times"))
    return A.stage_latency_map(maps, "times", ["click", "view", "purchase"]).select("stage", F.round("median_ms", 6).alias("median_ms"))


@query("SELECT stage, count(*) FILTER (fell_back) AS fallbacks, count(*) AS n FROM stage_times GROUP BY 1", "stage_times")
def ag_fallback_counts(spark, sf):
    return A.fallback_counts(S.stage_times(spark, sf), "stage", "fell_back")


@query("SELECT round(sum(l_discount) / sum(l_quantity), 9) AS ratio_of_sums, round(avg(l_discount / l_quantity), 9) AS mean_of_ratios FROM lineitem")
def ag_two_ratios(spark, sf):
    return A.two_ratios(S.table(spark, sf, "lineitem"), "l_discount", "l_quantity").select(F.round("ratio_of_sums", 9).alias("ratio_of_sums"), F.round("mean_of_ratios", 9).alias("mean_of_ratios"))


@query("SELECT count(n_chars) AS n, quantile_cont(n_chars, 0.5) AS median, round(avg(n_chars), 6) AS mean, max(n_chars) AS most, min(n_chars) AS least FROM documents")
def ag_number_summary(spark, sf):
    return A.number_summary(S.table(spark, sf, "documents"), "n_chars").select("n", "median", F.round("mean", 6).alias("mean"), "most", "least")


@query("SELECT round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 9) AS valid, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT 'code ' || (event_id % 17) AS e FROM events WHERE event_type = 'error' ORDER BY e LIMIT 10)) AS errors FROM events")
def ag_pipeline_rates(spark, sf):
    e = S.table(spark, sf, "events").withColumn("e", F.when(F.col("event_type") == "error", F.concat(F.lit("code "), (F.col("event_id") % 17).cast("string"))))
    return A.pipeline_rates(e, F.col("event_type") != "error", "e").select(F.round("valid", 9).alias("valid"), "errors")


@query("SELECT split, count(*) AS n FROM (SELECT DISTINCT source, CASE WHEN ('0x' || substr(sha1(source), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'rest' END AS split FROM documents) GROUP BY 1")
def ag_entities_per_split(spark, sf):
    from annomill.functions.numeric import hash_bucket

    entities = S.table(spark, sf, "documents").select("source").distinct()
    return A.count_by(entities.withColumn("split", F.when(hash_bucket(F.col("source")) < 80, "train").otherwise("rest")), "split")


@query("SELECT o_custkey AS doc, count(*) AS leaves FROM (SELECT o_custkey, 'l' || l_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT o_custkey, 'o' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) GROUP BY 1")
def ag_leaf_count(spark, sf):
    orders, lines = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    o = orders.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"))
    number = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    leaf = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc"), F.concat(F.lit("l"), number).alias("node"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent"))
    return A.leaf_count(o.unionByName(leaf), "doc", "node", "parent")


@query("""WITH d AS (SELECT a.sketch_id, a.stroke_id, a.seq AS i, b.seq AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM points a JOIN points b ON a.sketch_id = b.sketch_id AND a.stroke_id = b.stroke_id AND a.seq < b.seq)
SELECT sketch_id, stroke_id, i::INT AS i, j::INT AS j, round(d2, 4) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY sketch_id, stroke_id ORDER BY d2 DESC, i, j) AS r FROM d) WHERE r = 1""", "points")
def ag_farthest_pair(spark, sf):
    found = A.farthest_pair(S.points(spark, sf), ["sketch_id", "stroke_id"], "seq")
    return found.select("sketch_id", "stroke_id", "i", "j", F.round("d2", 4).alias("d2"))


@query("SELECT type, count(DISTINCT sketch_id) AS docs FROM elements_gold GROUP BY 1", "elements_gold")
def ag_type_coverage(spark, sf):
    return A.type_coverage(S.elements_gold(spark, sf), "sketch_id", "type")


@query("""WITH f AS (SELECT sketch_id, min(fx) AS fx, min(fy) AS fy, quantile_cont(fh, 0.5) / 2 AS fu FROM frames GROUP BY 1), i AS (SELECT sketch_id, min(x) AS ix, min(y) AS iy, (max(y) - min(y)) / 2 AS iu FROM points GROUP BY 1)
SELECT sketch_id, coalesce(fx, ix) AS ox, coalesce(fy, iy) AS oy, round(greatest(coalesce(fu, iu), 0.001), 6) AS unit FROM i FULL JOIN f USING (sketch_id)""", "frames", "points")
def ag_sketch_unit(spark, sf):
    f = S.frames(spark, sf).select("sketch_id", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fh").alias("h"))
    return A.sketch_unit(f, S.points(spark, sf), "sketch_id").select("sketch_id", "ox", "oy", F.round("unit", 6).alias("unit"))


@query("SELECT sketch_id, frame_id, round(min(x), 1) AS x, round(min(y), 1) AS y, round(max(x + w) - min(x), 1) AS w, round(max(y + h) - min(y), 1) AS h, string_agg(element_id, ',' ORDER BY element_id) AS strokes FROM elements_gold GROUP BY ALL", "elements_gold")
def ag_element_records(spark, sf):
    return A.element_records(S.elements_gold(spark, sf), "sketch_id", "frame_id", "element_id")


@query("SELECT round(avg(n_chars), 6) AS n_chars, count(n_chars) AS n_n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def ag_paired_subset(spark, sf):
    found = A.paired_subset(S.table(spark, sf, "documents"), S.table(spark, sf, "labels"), "doc_id", "n_chars")
    return found.select(F.round("n_chars", 6).alias("n_chars"), "n_n_chars")
