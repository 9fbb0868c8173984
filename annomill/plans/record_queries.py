"""Queries of projections, gates, splits, samples and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from annomill.functions import numeric as N
from annomill.functions import text as T
from annomill.operators import records as R
from annomill.operators import sampling as P

from . import standins as S
from .registry import query
from .standins import bucket_sql

U = lambda key: f"(('0x' || substr(sha1({key}), 1, 8))::BIGINT / 4294967296)"
#: The inverse Poisson distribution function of mean one half of a draw u of 32 bits: beyond 9 events no such draw is left.
POISSON_HALF = "CASE " + " ".join(f"WHEN u < exp(-0.5) * ({' + '.join(f'pow(0.5, {i}) / {math.factorial(i)}' for i in range(k + 1))}) THEN {k}" for k in range(12)) + " ELSE 12 END"


@query("""WITH n AS (SELECT sketch_id, element_id, w, h, type IN ('fab') AS over, text FROM elements_gold), c AS (SELECT sketch_id, count(*) AS leaves, count(*) FILTER (over) AS overlays, count(*) FILTER (coalesce(text, '') <> '') AS texts FROM n GROUP BY 1)
SELECT sketch_id, leaves, CASE WHEN sketch_id % 7 = 0 THEN 'not_portrait' WHEN overlays > 0 THEN 'overlay' WHEN leaves < 3 THEN 'too_few' WHEN leaves > 30 THEN 'too_many' ELSE 'ok' END AS reason FROM c""", "elements_gold")
def prj_gate_documents(spark, sf):
    e = S.elements_gold(spark, sf)
    nodes = e.select("sketch_id", F.when(F.col("type") == "fab", "Modal").otherwise("Text").alias("label"), "text", F.lit(True).alias("is_leaf"), F.lit(1440.0).alias("root_w"), F.when(F.col("sketch_id") % 7 == 0, 900.0).otherwise(2560.0).alias("root_h"))
    return R.gate_documents(nodes, "sketch_id")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'home' WHEN 'STANDARD' THEN 'list' ELSE 'circle' END AS icon FROM part")
def prj_map_vocab(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", R.map_vocab(F.col("p_type"), {"ECONOMY": "home", "STANDARD": "list"}, "circle").alias("icon"))


@query("""SELECT element_id, CASE WHEN type = 'text' AND length(text) > 40 THEN 'para' WHEN type = 'text' THEN 'text' WHEN type = 'btn' THEN 'btn' WHEN type = 'input' THEN 'input' WHEN type = 'img' AND w = h AND h < 76 THEN 'avatar' WHEN type = 'img' THEN 'img'
WHEN type = 'icon' THEN 'icon' WHEN type = 'check' THEN 'check' WHEN type = 'switch' THEN 'switch' END AS kind FROM elements_gold""", "elements_gold")
def prj_type_leaves(spark, sf):
    label = R.map_vocab(F.col("type"), {"text": "Text", "btn": "Text Button", "input": "Input", "img": "Image", "icon": "Icon", "check": "Checkbox", "switch": "On/Off Switch"}, "Other")
    return S.elements_gold(spark, sf).select("element_id", R.type_leaves(label, F.col("text"), F.lit(""), F.col("w"), F.col("h"), F.lit(760.0)).alias("kind"))


@query("""WITH t AS (SELECT element_id, type, CASE WHEN element_id % 3 = 0 THEN 'AppCompatButton' ELSE 'TextView' END AS cls, CASE element_id % 5 WHEN 0 THEN 'user_Password' WHEN 1 THEN 'pin_code' ELSE 'field' END || ' ' || lower(coalesce(text, '')) AS hint, coalesce(text, '') AS text, h FROM elements_gold)
SELECT element_id, CASE WHEN type = 'input' THEN 'input' WHEN type = 'btn' AND cls = 'TextView' THEN 'link' WHEN type = 'btn' THEN 'btn' END AS kind, CASE WHEN type = 'input' THEN CASE WHEN regexp_matches(lower(hint), 'pass|pin') THEN 'secure' WHEN h > 0.12 * 600 THEN 'multiline' END END AS input FROM t""", "elements_gold")
def prj_link_and_input_kinds(spark, sf):
    """Buttons of a text's class are links; inputs are secure by id or text, else multiline by height."""
    e = S.elements_gold(spark, sf)
    label = R.map_vocab(F.col("type"), {"btn": "Text Button", "input": "Input"}, "Other")
    cls = F.when(F.col("element_id") % 3 == 0, "AppCompatButton").otherwise("TextView")
    hint = F.when(F.col("element_id") % 5 == 0, "user_Password").when(F.col("element_id") % 5 == 1, "pin_code").otherwise("field")
    kind = R.type_leaves(label, F.coalesce("text", F.lit("")), cls, F.col("w"), F.col("h"), F.lit(600.0))
    return e.select("element_id", kind.alias("kind"), F.when(F.col("type") == "input", R.input_kind(hint, F.col("text"), F.col("h"), F.lit(600.0))).alias("input"))


@query("SELECT element_id, CASE WHEN r >= 1.8 THEN 'h1' WHEN r >= 1.35 THEN 'h2' WHEN r <= 0.75 THEN 'caption' ELSE 'body' END AS style FROM (SELECT element_id, h / quantile_cont(h, 0.5) OVER (PARTITION BY sketch_id) AS r FROM elements_gold)", "elements_gold")
def prj_bucket_by_ratio(spark, sf):
    return R.bucket_by_ratio(S.elements_gold(spark, sf), "sketch_id", "h", 19.0).select("element_id", "style")


@query("SELECT doc_id, concat_ws(';', CASE WHEN n_chars < 50 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN text LIKE '%***%' THEN 'junk' END) AS problems FROM documents")
def prj_check_records(spark, sf):
    checks = [("short", F.col("n_chars") < 50), ("language", F.col("lang") != "en"), ("junk", F.col("text").contains("***"))]
    return R.check_records(S.table(spark, sf, "documents"), checks).select("doc_id", F.array_join("problems", ";").alias("problems"))


@query("""WITH s AS (SELECT sketch_id, element_id, 'range' AS code FROM elements_gold WHERE h > 75), d AS (SELECT sketch_id, element_id, 'dup_id' AS code FROM (SELECT *, row_number() OVER (PARTITION BY sketch_id, text ORDER BY element_id::VARCHAR) AS k FROM elements_gold WHERE text IS NOT NULL) WHERE k > 1)
SELECT sketch_id, element_id::VARCHAR AS path, code FROM s UNION ALL SELECT sketch_id, element_id::VARCHAR, code FROM d WHERE sketch_id NOT IN (SELECT sketch_id FROM s)""", "elements_gold")
def prj_validate_specs(spark, sf):
    nodes = S.elements_gold(spark, sf).withColumn("path", F.col("element_id").cast("string"))
    return R.validate_nodes(nodes, "sketch_id", [("range", F.col("h") > 75)], [R.duplicate_ids(nodes, "sketch_id", "text")])


@query("""WITH v AS (SELECT l_orderkey AS doc, l_linenumber AS path, unnest(['n', 'label', 'q']) AS key, unnest([l_quantity::INT::VARCHAR, l_returnflag, 'x']) AS value FROM lineitem)
SELECT doc, path::VARCHAR AS path, CASE WHEN key = 'q' THEN 'unknown_key' ELSE 'range' END AS code FROM v WHERE key = 'q' OR (key = 'n' AND value::INT > 30)""")
def prj_structural_rules(spark, sf):
    pairs = F.explode(F.create_map(F.lit("n"), F.col("l_quantity").cast("int").cast("string"), F.lit("label"), F.col("l_returnflag"), F.lit("q"), F.lit("x"))).alias("key", "value")
    values = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("string").alias("path"), F.lit("list").alias("t"), pairs)
    domain = spark.createDataFrame([("list", "n", "int", 1, 30), ("list", "label", "str", 1, 40)], "t string, key string, kind string, least int, most int")
    return R.structural_rules(values, domain)


@query("SELECT item_id, status FROM (SELECT item_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) > 50 THEN 'too_long' ELSE 'fits' END AS status FROM benchmark)")
def prj_token_budget(spark, sf):
    return R.token_budget(S.table(spark, sf, "benchmark").withColumn("completion", F.lit("")), "text", "completion", 50).select("item_id", "status")


@query("SELECT sketch_id, count(*) AS n FROM points GROUP BY 1 HAVING count(*) BETWEEN 1 AND 110", "points")
def prj_length_filter(spark, sf):
    lists = S.points(spark, sf).groupBy("sketch_id").agg(F.collect_list("x").alias("xs"))
    return R.length_filter(lists, "xs", 1, 110).select("sketch_id", F.size("xs").cast("long").alias("n"))


@query("SELECT event_id, value FROM events WHERE event_type <> 'view'")
def prj_nan_filter(spark, sf):
    e = S.table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") == "view", float("nan")).otherwise(F.col("value")))
    return R.nan_filter(e, "value").select("event_id", "value")


@query("SELECT element_id, CASE WHEN w > 120 AND type = 'text' THEN 'arrow' WHEN type = 'text' THEN 'text' WHEN h > 60 THEN 'shape' ELSE 'frame' END AS cls FROM elements_gold", "elements_gold")
def prj_implied_class(spark, sf):
    e = S.elements_gold(spark, sf)
    return R.implied_class(e, [("shape", e.filter("h > 60")), ("text", e.filter("type = 'text'")), ("arrow", e.filter("type = 'text' AND w > 120"))], ["element_id"], "frame")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END AS go FROM lineitem")
def prj_drop_dead_links(spark, sf):
    links = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("go"), F.lit(1).alias("doc"))
    targets = S.table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.lit(1).alias("doc"), "s_suppkey")
    return R.drop_dead_links(links, targets, "doc", "go", "s_suppkey").drop("doc")


@query("SELECT element_id, type FROM elements_pred WHERE type <> 'divider'", "elements_gold", "elements_pred")
def prj_drop_noise_groups(spark, sf):
    return R.drop_noise_groups(S.elements_pred(spark, sf), "type", "divider").select("element_id", "type")


@query("SELECT element_id, CASE type WHEN 'menu' THEN 'menu' WHEN 'icon' THEN 'circle' END AS icon, least(6, element_id % 9)::INT AS n, left(array_to_string(string_split(text, ' ')[:3], ' '), 20) AS label FROM elements_gold", "elements_gold")
def prj_simplify_spec(spark, sf):
    e = S.elements_gold(spark, sf).select("element_id", F.when(F.col("type").isin("menu", "icon"), F.col("type")).alias("icon"), (F.col("element_id") % 9).cast("int").alias("n"), F.col("text").alias("label"))
    return R.simplify_nodes(e)


@query("SELECT frame_id, count(*) AS leaves FROM elements_gold GROUP BY 1 HAVING count(*) BETWEEN 4 AND 10", "elements_gold")
def prj_leaf_bounds(spark, sf):
    return R.leaf_bounds(S.elements_gold(spark, sf).groupBy("frame_id").agg(F.count("*").alias("leaves")), "leaves")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 0 THEN 'n/a' ELSE printf('%.3f', n_chars / 1000) END AS shown FROM documents LEFT JOIN labels l USING (doc_id)")
def prj_format_metric(spark, sf):
    rows = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    value = F.when(F.col("quality") == 1, F.col("n_chars") / 1000)
    return rows.select("doc_id", R.format_metric(value, F.col("quality").isNotNull()).alias("shown"))


@query("SELECT element_id, CASE WHEN w > 130 THEN 'rect' WHEN w > 115 THEN 'ellipse' WHEN h > 60 THEN 'hline' ELSE 'scribble' END AS cls FROM elements_gold", "elements_gold")
def prj_primitive_class(spark, sf):
    w, h = F.col("w"), F.col("h")
    area = F.when(w > 130, 0.9).when(w > 115, 0.7).otherwise(0.1)
    return S.elements_gold(spark, sf).select("element_id", R.primitive_class(F.lit(0.1), 2 * (w + h), w, h, area, F.lit(0), F.when(h > 60, 0.95).otherwise(0.5), F.lit(3.0)).alias("cls"))


@query("SELECT element_id FROM elements_gold WHERE type IN ('btn', 'input', 'text', 'heading', 'check', 'radio', 'switch') AND element_id % 3 <> 0", "elements_gold")
def prj_readable_elements(spark, sf):
    e = S.elements_gold(spark, sf).withColumn("text_strokes", F.when(F.col("element_id") % 3 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return R.readable_elements(e, S.TEXT_TYPES).select("element_id")


@query(f"SELECT doc_id, CASE WHEN {bucket_sql('source')} < 80 THEN 'train' WHEN {bucket_sql('source')} < 90 THEN 'val' ELSE 'test' END AS split FROM documents")
def smp_split_by_entity(spark, sf):
    return P.split_by_entity(S.table(spark, sf, "documents"), "source").select("doc_id", "split")


@query(f"SELECT source, CASE WHEN substr(source, 4)::INT < 5 THEN 'old' WHEN {bucket_sql('source')} < 40 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT source FROM documents)")
def smp_freeze_split(spark, sf):
    docs = S.table(spark, sf, "documents")
    registry = docs.select("source").distinct().filter("int(substring(source, 4)) < 5").withColumn("split", F.lit("old"))
    return P.freeze_split(docs, registry, "source")


@query("SELECT source, count(DISTINCT lang) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def smp_leakage_audit(spark, sf):
    return P.leakage_audit(S.table(spark, sf, "documents"), "source", "lang")


@query(f"SELECT doc_id FROM documents WHERE {U(chr(39) + 'b:' + chr(39) + ' || doc_id')} < 0.3")
def smp_bernoulli(spark, sf):
    return S.table(spark, sf, "documents").filter(P.bernoulli(0.3, "b", F.col("doc_id"))).select("doc_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(sha1('c:' || doc_id), 1, 8))::BIGINT, doc_id) AS k FROM documents) WHERE k <= 7")
def smp_choose_k(spark, sf):
    return P.choose_k(S.table(spark, sf, "documents"), ["lang"], "doc_id", 7, "c").select("lang", "doc_id")


@query(f"WITH u AS (SELECT doc_id, {U(chr(39) + 'w:' + chr(39) + ' || doc_id')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS chosen FROM u")
def smp_weighted_choice(spark, sf):
    weights = spark.createDataFrame([("en", "a", 0.5), ("en", "b", 0.3), ("en", "c", 0.2)], "k string, kind string, p double")
    docs = S.table(spark, sf, "documents").select("doc_id", F.lit("en").alias("k"))
    return P.weighted_choice(docs, weights, "k", "kind", "p", N.uniform("w", F.col("doc_id"))).select("doc_id", "chosen")


@query(f"WITH u AS (SELECT frame_id, {U(chr(39) + 'p:' + chr(39) + ' || frame_id')} AS u FROM frames), n AS (SELECT frame_id, {POISSON_HALF} AS n FROM u) SELECT frame_id, unnest(range(n))::INT AS event FROM n", "frames")
def smp_poisson_k(spark, sf):
    return P.with_poisson(S.frames(spark, sf).select("frame_id"), 0.5, "p", "frame_id")


@query(f"SELECT doc_id, round(sqrt(-2 * ln(1 - {U(chr(39) + 'g/r:' + chr(39) + ' || doc_id')})) * cos(2 * pi() * {U(chr(39) + 'g/a:' + chr(39) + ' || doc_id')}), 6) AS z FROM documents")
def smp_gauss(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.round(N.gauss("g", F.col("doc_id")), 6).alias("z"))


@query(f"""WITH m AS (SELECT * FROM elements_gold WHERE {U(chr(39) + 'n/miss:' + chr(39) + ' || element_id')} >= CASE WHEN type = 'text' THEN 0.25 ELSE 0 END)
SELECT element_id, CASE WHEN type = 'btn' AND {U(chr(39) + 'n/type:' + chr(39) + ' || element_id')} < 0.5 THEN 'input' ELSE type END AS type, {", ".join(f"round({k} + 2 * sqrt(-2 * ln(1 - {U(chr(39) + f'n/{k}/r:' + chr(39) + ' || element_id')})) * cos(2 * pi() * {U(chr(39) + f'n/{k}/a:' + chr(39) + ' || element_id')}), 4) AS {k}" for k in "xywh")} FROM m""", "elements_gold")
def smp_corrupt_elements(spark, sf):
    rates = spark.createDataFrame([("text", 0.25)], "type string, miss_rate double")
    confusions = spark.createDataFrame([("btn", "input", 0.5)], "type string, other string, p double")
    found = P.corrupt_elements(S.elements_gold(spark, sf), rates, confusions, key="element_id", seed="n", jitter=2.0, cer=0.1)
    return found.select("element_id", "type", *(F.round(k, 4).alias(k) for k in "xywh"))


@query(f"""WITH k AS (SELECT sketch_id, count(*) AS frames, {U(chr(39) + 'x/fp:' + chr(39) + ' || sketch_id')} AS u FROM frames GROUP BY 1),
n AS (SELECT sketch_id, frames, {POISSON_HALF} AS n FROM k), e AS (SELECT sketch_id, frames, unnest(range(n)) AS event FROM n),
d AS (SELECT e.*, floor({U(chr(39) + 'x/fp/frame:' + chr(39) + ' || sketch_id || ' + chr(39) + ':' + chr(39) + ' || event')} * frames)::BIGINT AS ord, CASE WHEN {U(chr(39) + 'x/fp/type:' + chr(39) + ' || sketch_id || ' + chr(39) + ':' + chr(39) + ' || event')} < 0.25 THEN 'icon' ELSE 'text' END AS type, 0.04 + 0.16 * {U(chr(39) + 'x/fp/size:' + chr(39) + ' || sketch_id || ' + chr(39) + ':' + chr(39) + ' || event')} AS size, {U(chr(39) + 'x/fp/x:' + chr(39) + ' || sketch_id || ' + chr(39) + ':' + chr(39) + ' || event')} AS ux, {U(chr(39) + 'x/fp/y:' + chr(39) + ' || sketch_id || ' + chr(39) + ':' + chr(39) + ' || event')} AS uy FROM e)
SELECT sketch_id, frame_id, element_id, type, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h, CASE WHEN {U(chr(39) + 'x/gone:' + chr(39) + ' || element_id')} >= 0.05 THEN text END AS text FROM elements_gold
UNION ALL SELECT d.sketch_id, frame_id, 10000 + event, type, round(fx + 0.9 * ux * fw, 4), round(fy + 0.95 * uy * fh, 4), round(size * fw, 4), round(size * fw * 0.4, 4), NULL FROM d JOIN frames f ON f.sketch_id = d.sketch_id AND f.ord = d.ord""", "frames", "elements_gold")
def smp_false_positives(spark, sf):
    """Elements of whole sketches with some texts gone and some elements that nobody drew."""
    e = S.elements_gold(spark, sf).drop("fx")
    frames = S.frames(spark, sf).select("sketch_id", "frame_id", "ord", *(F.col("f" + c).alias(c) for c in "xywh"))
    mix = spark.createDataFrame([("text", 0.75), ("icon", 0.25)], "type string, p double")
    found = P.add_false_positives(P.missing_text(e, key="element_id", seed="x", rate=0.05), frames, mix, doc="sketch_id", seed="x", per_sketch=0.5)
    return found.select("sketch_id", "frame_id", "element_id", "type", *(F.round(c, 4).alias(c) for c in "xywh"), "text")


@query(f"SELECT doc_id, CASE WHEN lang <> 'en' THEN 1 WHEN {U(chr(39) + 'm:' + chr(39) + ' || doc_id')} < 0.2 THEN 0 ELSE round(0.5 + {U(chr(39) + 'm/s:' + chr(39) + ' || doc_id')}, 8) END::DOUBLE AS strength FROM documents")
def smp_clean_mix(spark, sf):
    docs = S.table(spark, sf, "documents").withColumn("split", F.when(F.col("lang") == "en", "train").otherwise("val"))
    return P.clean_mix(docs, "doc_id", "split", "m").select("doc_id", F.round("strength", 8).alias("strength"))


@query(f"""WITH e AS (SELECT sketch_id, 0 AS late, element_id AS o, CASE WHEN type = 'card' AND {U(chr(39) + 'a/card-grid:' + chr(39) + ' || sketch_id')} < 0.3 THEN 'grid' ELSE type END AS type FROM elements_gold UNION ALL SELECT DISTINCT sketch_id, 1, 0, 'radio' FROM elements_gold WHERE {U(chr(39) + 'a/radio:' + chr(39) + ' || sketch_id')} < 0.4 UNION ALL SELECT DISTINCT sketch_id, 2, 0, 'fab' FROM elements_gold WHERE {U(chr(39) + 'a/fab:' + chr(39) + ' || sketch_id')} < 0.2)
SELECT sketch_id, type, ord::INT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY sketch_id ORDER BY late, o, type) - 1 AS ord FROM e) WHERE ord < 10""", "elements_gold")
def smp_augment_documents(spark, sf):
    return P.augment_children(S.elements_gold(spark, sf), [("radio", 0.4), ("fab", 0.2)], doc="sketch_id", order="element_id", kind="type", seed="a", most=10, swap=("card", "grid", 0.3)).select("sketch_id", "type", "ord")


@query(f"""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part), u AS (SELECT *, {U("'t:' || p_partkey || ':' || i")} AS u, substr('abcdefghijklmnopqrstuvwxyz', (floor({U("'t/c:' || p_partkey || ':' || i")} * 26) + 1)::INT, 1) AS o FROM c)
SELECT p_partkey, string_agg(CASE WHEN u < 0.1 THEN '' WHEN u < 0.2 THEN o WHEN u < 0.3 THEN c || o ELSE c END, '' ORDER BY i) AS noisy FROM u GROUP BY 1""")
def fn_typo(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", P.typo(F.col("p_name"), 0.3, "t", F.col("p_partkey")).alias("noisy"))


@query(f"""WITH g AS (SELECT sketch_id, frame_id, ord, count(*) OVER (PARTITION BY sketch_id) AS n FROM frames),
c AS (SELECT sketch_id, frame_id, element_id, row_number() OVER (PARTITION BY sketch_id, frame_id ORDER BY ('0x' || substr(sha1('l:' || element_id), 1, 8))::BIGINT, element_id) AS k FROM elements_gold WHERE type IN ('btn', 'card', 'text')),
p AS (SELECT c.*, ord, n FROM c JOIN g USING (sketch_id, frame_id) WHERE n > 1 AND (k = 1 OR (k = 2 AND {U("'l/two:' || sketch_id || ':' || frame_id")} < 0.5)))
SELECT p.sketch_id, p.element_id, t.frame_id AS go FROM p JOIN g t ON t.sketch_id = p.sketch_id AND t.ord = (p.ord + 1 + ('0x' || substr(sha1('l/to:' || element_id), 1, 8))::BIGINT % (p.n - 1)) % p.n""", "frames", "elements_gold")
def smp_add_links(spark, sf):
    return P.add_links(S.elements_gold(spark, sf), S.frames(spark, sf), doc="sketch_id", key="element_id", screen="frame_id", kinds=["btn", "card", "text"], seed="l")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def fn_clean_text(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("SELECT doc_id, regexp_full_match(replace(text, chr(10), ' '), '[\\x20-\\x7E\\x{A0}-\\x{24F}\\x{2018}-\\x{201D}\\x{2026}\\x{20AC}\\x{20B9}]*') AS latin FROM documents")
def fn_is_latin(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.is_latin(F.replace("text", F.lit("\n"), F.lit(" "))).alias("latin"))


@query("SELECT s_suppkey, 'Supplier' AS label FROM supplier")
def fn_label_from_id(spark, sf):
    rid = F.concat(F.lit("et_new_"), F.regexp_replace("s_name", "#", "_"))
    return S.table(spark, sf, "supplier").select("s_suppkey", T.label_from_id(rid).alias("label"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name WHEN length(string_split(p_name, ' ')[1]) + 1 > 8 THEN left(p_name, 8) ELSE string_split(p_name, ' ')[1] END AS short FROM part")
def fn_short_words(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", T.short_words(F.col("p_name"), 8).alias("short"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, 's_' || c_custkey AS digits FROM customer")
def fn_slug(spark, sf):
    return S.table(spark, sf, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"), T.slug(F.col("c_custkey").cast("string")).alias("digits"))


@query(r"SELECT item_id, nullif(left(trim(regexp_replace(replace(text, '\"', ''''), '\s+', ' ', 'g')), 40), '') AS p FROM benchmark".replace('\\"', '"'))
def fn_prompt_text(spark, sf):
    return S.table(spark, sf, "benchmark").select("item_id", T.prompt_text(F.col("text")).alias("p"))


@query("SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def fn_tail_of(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", T.tail_of(F.col("url"), "/").alias("tail"))


@query("SELECT event_id, CASE WHEN event_id % 120 < 100 THEN greatest(1, least(50, event_id % 120)) END::INT AS n FROM events")
def fn_list_mark(spark, sf):
    return S.table(spark, sf, "events").select("event_id", T.list_mark(F.concat(F.lit(" x "), (F.col("event_id") % 120).cast("string"))).alias("n"))


@query("""SELECT element_id, CASE WHEN type = 'btn' THEN (element_id % 50)::INT + 1 WHEN type = 'listmark' AND element_id % 2 = 0 THEN least(50, greatest(1, element_id % 60))::INT WHEN type = 'listmark' THEN 3 END AS n FROM elements_gold""", "elements_gold")
def fn_repeat_count(spark, sf):
    """Buttons marked in their text, list marks read at the third try or not at all."""
    e = S.elements_gold(spark, sf)
    mark = F.concat(F.lit("x"), (F.col("element_id") % F.when(F.col("type") == "btn", 50).otherwise(60) + F.when(F.col("type") == "btn", 1).otherwise(0)).cast("string"))
    text = F.when(F.col("type") == "btn", mark).otherwise(F.lit("oops"))
    readings = F.when((F.col("type") == "listmark") & (F.col("element_id") % 2 == 0), F.array(F.lit("o"), F.lit("?"), mark, F.lit("x7"))).otherwise(F.array(F.lit("o"), F.lit("?"), F.lit("!"), F.lit("x7")))
    return e.select("element_id", T.repeat_count(F.col("type"), text, readings).alias("n"))


@query("SELECT item_id, regexp_matches(text, '(?i)pass|pin|secret|otp') AS secret FROM benchmark")
def fn_secret_hint(spark, sf):
    return S.table(spark, sf, "benchmark").select("item_id", T.secret_hint(F.col("text")).alias("secret"))


@query("SELECT c_custkey, coalesce(nullif(regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g'), ''), 'anon') AS code FROM customer")
def fn_sanitize_code(spark, sf):
    return S.table(spark, sf, "customer").select("c_custkey", T.sanitize_code(F.col("c_name")).alias("code"))


@query("SELECT doc_id, printf('%s-%06d', lang, doc_id) AS id FROM documents")
def fn_sample_id(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.sample_id(F.col("lang"), F.col("doc_id")).alias("id"))


@query("SELECT conv_id, string_agg('<' || role || '>' || chr(10) || text || chr(10) || '</' || role || '>', chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY 1")
def fn_chat_format(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return S.table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("m")).select("conv_id", T.chat_format(F.col("m")).alias("chat"))


@query("SELECT event_id, floor(-value + 0.5)::BIGINT AS up, round_even(value, 0) AS even, greatest(1, least(50, value)) AS held FROM events")
def fn_rounding(spark, sf):
    v = F.col("value")
    return S.table(spark, sf, "events").select("event_id", N.half_up(-v).alias("up"), N.half_even(v).alias("even"), N.clamp(v, 1.0, 50.0).alias("held"))


@query("SELECT element_id, floor(100 * (x - fx) / 360 + 0.5)::BIGINT AS px, floor(100 * y / 760 + 0.5)::BIGINT AS py FROM elements_gold", "elements_gold")
def fn_percent(spark, sf):
    return S.elements_gold(spark, sf).select("element_id", N.percent(F.col("x"), F.col("fx"), F.lit(360.0)).alias("px"), N.percent(F.col("y"), F.lit(0.0), F.lit(760.0)).alias("py"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS s, round(exp(value / 100) / (exp(value / 100) + exp(1) + exp(2)), 9) AS first FROM events")
def fn_softmax(spark, sf):
    v = F.col("value") / 100
    return S.table(spark, sf, "events").select("event_id", F.round(N.sigmoid(v), 9).alias("s"), F.round(N.softmax(F.array(v, F.lit(1.0), F.lit(2.0)))[0], 9).alias("first"))


@query("SELECT element_id, round(w * h, 6) AS area, round(2 * x + y + 5, 6) AS ax, round(x - y, 6) AS ay FROM elements_gold", "elements_gold")
def fn_geometry(spark, sf):
    b = N.Box.of()
    ax, ay = N.affine(b.x, b.y, (2.0, 1.0, 5.0, 1.0, -1.0, 0.0))
    area = N.shoelace(F.array(b.x, b.x + b.w, b.x + b.w, b.x), F.array(b.y, b.y, b.y + b.h, b.y + b.h))
    return S.elements_gold(spark, sf).select("element_id", F.round(area, 6).alias("area"), F.round(ax, 6).alias("ax"), F.round(ay, 6).alias("ay"))


@query(f"SELECT doc_id, {bucket_sql('doc_id::VARCHAR')} AS bucket FROM documents")
def fn_hash_bucket(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", N.hash_bucket(F.col("doc_id").cast("string")).alias("bucket"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def fn_json_path(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, epoch(o_orderdate)::BIGINT AS secs FROM orders")
def fn_date_parts(spark, sf):
    return S.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("secs"))
