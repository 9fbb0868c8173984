"""Queries of trees, features, sources, sinks, user functions and streams."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from annomill.functions import text as T
from annomill.operators import features as X
from annomill.operators import trees as R
from annomill.session import shared_dir
from annomill.sources import readers, writers
from annomill.streaming import ingest

from . import standins as S
from .layout_queries import CORNERS
from .registry import query
from .window_queries import RESAMPLE, TURNS


def _nested(spark, sf):
    """One JSON document per customer: orders, and their lines."""
    lines = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    line = F.struct(F.lit("line").alias("t"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("part"), F.col("q"))
    inner = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("children"))
    order = F.struct(F.col("o_orderkey").alias("k"), F.lit("order").alias("t"), "children")
    docs = S.table(spark, sf, "orders").join(inner, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("children"))
    return docs.select(F.col("o_custkey").alias("doc"), F.to_json(F.struct(F.lit("customer").alias("t"), "children")).alias("text"))


@query("SELECT o_custkey AS doc, l_linenumber AS k, l_partkey AS part, l_quantity::INT AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def tre_flatten(spark, sf):
    nodes = R.flatten(_nested(spark, sf), "doc", "text")
    get = lambda k, t: F.try_variant_get("node", f"$.{k}", t).alias(k)
    return nodes.filter("depth = 2").select("doc", get("k", "int"), get("part", "long"), get("q", "int"))


@query("SELECT o_custkey AS doc, 'customer' AS t, 1::BIGINT AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'order', count(*) FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'line', count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def tre_node_types(spark, sf):
    nodes = R.flatten(_nested(spark, sf), "doc", "text")
    return nodes.groupBy("doc", F.try_variant_get("node", "$.t", "string").alias("t")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS doc, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_orderkey) > 0")
def tre_splice_unlabelled(spark, sf):
    nodes = R.flatten(_nested(spark, sf), "doc", "text").withColumn("label", F.when(F.col("depth") != 1, F.try_variant_get("node", "$.t", "string"))).select("doc", "path", "parent", "depth", "label")
    lines = R.splice_unlabelled(nodes, "doc", "label").filter("label = 'line' AND parent = ''").groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("path", "^(/children/\\d+)/", 1)).alias("with_lines"))
    orders = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("orders"))
    return lines.join(orders, "doc").select("doc", (F.col("n") + F.col("orders") - F.col("with_lines")).alias("lines"), "orders")


@query("SELECT o_custkey AS doc, min(o_orderkey)::VARCHAR AS title FROM orders GROUP BY 1")
def tre_first_heading(spark, sf):
    nodes = R.flatten(_nested(spark, sf), "doc", "text").withColumns({"t": F.try_variant_get("node", "$.t", "string"), "v": F.try_variant_get("node", "$.k", "string")})
    return R.first_heading(nodes.withColumn("path", F.lpad(F.col("ord").cast("string"), 6, "0")), "doc", "t", "v", ["order"])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, coalesce('(' || repeat('line,', (count(l_orderkey) - 1)::INT) || 'line)', '') AS sub, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_custkey AS doc, 'customer(' || string_agg('order' || CASE WHEN n > 0 THEN sub ELSE '' END, ',' ORDER BY o_orderkey) || ')' AS sig FROM o GROUP BY 1""")
def tre_signature(spark, sf):
    nodes = R.flatten(_nested(spark, sf), "doc", "text").withColumn("t", F.try_variant_get("node", "$.t", "string"))
    return R.signature(nodes, "doc", "t").filter("path = ''").select("doc", "sig")


@query("SELECT frame_id, 'switch' AS control, max(text) FILTER (type = 'text') AS label FROM elements_gold WHERE type IN ('text', 'switch') GROUP BY 1 HAVING count(*) = 2 AND count(*) FILTER (type = 'text') = 1", "elements_gold")
def tre_merge_label_control(spark, sf):
    e = S.elements_gold(spark, sf).filter("type IN ('text', 'switch')")
    return R.merge_label_control(e.withColumn("parent", F.lit(0)), "frame_id", "parent").select("frame_id", "control", "label")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4 AND count(DISTINCT l_returnflag) = 1")
def tre_detect_grid(spark, sf):
    lines = S.table(spark, sf, "lineitem").withColumn("parent", F.lit(0))
    return R.detect_grid(lines, "l_orderkey", "parent", "l_returnflag").select("l_orderkey", "n")


@query("SELECT o_custkey AS doc, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, o_orderkey AS screen FROM orders")
def tre_per_screen_docs(spark, sf):
    arrays = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("s"))
    return R.per_screen(arrays, "doc", "s")


def _spec(shift: int = 0):
    """A screen of a frame's elements as JSON text."""
    kind = F.when((F.col("element_id") + shift) % 11 == 0, "divider").otherwise(F.col("type"))
    child = F.struct(F.col("element_id").alias("o"), F.struct(kind.alias("t"), F.col("text").alias("v"), F.lit("body").alias("s")).alias("n"))
    return F.to_json(F.struct(F.lit("col").alias("t"), F.transform(F.array_sort(F.collect_list(child)), lambda x: x["n"]).alias("c")))


@query("""SELECT frame_id, '{"t":"col","c":[' || string_agg('{"t":"' || type || '"' || CASE WHEN type = 'text' THEN '' ELSE ',"s":"body"' END || CASE WHEN text IS NOT NULL THEN ',"v":"' || text || '"' ELSE '' END || '}', ',' ORDER BY element_id) || ']}' AS canonical FROM (SELECT element_id, frame_id, text, CASE WHEN element_id % 11 = 0 THEN 'divider' ELSE type END AS type FROM elements_gold) GROUP BY 1""", "elements_gold")
def prj_canonicalize(spark, sf):
    """Keys a type doesn't know stay, in alphabetical order after those it does; the default style of texts goes."""
    specs = S.elements_gold(spark, sf).groupBy("frame_id").agg(_spec().alias("text"))
    return specs.select("frame_id", R.canonical_json("text").alias("canonical"))


LETTER = "chr((65 + list_position(['" + "', '".join(S.TYPES) + "'], {kind}))::INT)"


@query("""WITH t AS (SELECT frame_id, element_id, CASE WHEN element_id % 11 = 0 THEN 'divider' ELSE type END AS a, CASE WHEN (element_id + 3) % 11 = 0 THEN 'divider' ELSE type END AS b FROM elements_gold)
SELECT frame_id, 1 - levenshtein(string_agg(""" + LETTER.format(kind="a") + ", '' ORDER BY element_id), string_agg(" + LETTER.format(kind="b") + ", '' ORDER BY element_id)) / (count(*) + 1) AS similarity FROM t GROUP BY 1", "elements_gold")
def udf_tree_similarity(spark, sf):
    """Similarity of each frame's tree to a changed one; equal pairs are scored once."""
    e = S.elements_gold(spark, sf)
    pairs = e.groupBy("frame_id").agg(_spec(0).alias("a"), _spec(3).alias("b"))
    distinct = pairs.select("a", "b").distinct().withColumn("similarity", R.tree_similarity("a", "b"))
    return pairs.join(distinct.hint("merge"), ["a", "b"]).select("frame_id", "similarity")


def _documents(elements):
    """(sketch_id, spec): a whole document a sketch: a screen a frame with its elements in a column; icons also stand in the screen's bar, and checks in its navigation."""
    leaf = F.struct("element_id", F.struct(F.col("type").alias("t"), F.when(F.col("type") == "icon", F.col("name")).alias("name"), F.when(F.col("frame_id") % 2 == 0, "body").alias("s"), F.col("text").alias("v")).alias("n"))
    screens = elements.groupBy("sketch_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["n"]).alias("c"))
    screens = screens.withColumn("c", F.filter("c", lambda n: n["t"].isNotNull()))
    of = lambda kind: F.filter("c", lambda n: n["t"] == kind)
    bar = F.when(F.size(of("icon")) > 0, F.struct(F.lit("appbar").alias("t"), of("icon").alias("icons")))
    nav = F.when(F.size(of("check")) > 0, F.struct(F.lit("bottomnav").alias("t"), F.transform(of("check"), lambda n: F.struct(n["v"].alias("label"))).alias("items")))
    screen = F.struct("frame_id", F.struct(F.col("frame_id").cast("string").alias("id"), bar.alias("appbar"), F.struct(F.lit("col").alias("t"), F.col("c")).alias("body"), nav.alias("bottomnav")).alias("s"))
    docs = screens.groupBy("sketch_id").agg(F.transform(F.array_sort(F.collect_list(screen)), lambda x: x["s"]).alias("screens"))
    return docs.select("sketch_id", F.to_json(F.struct(F.lit(1).alias("v"), "screens")).alias("spec"))


@query("""WITH e AS (SELECT sketch_id, frame_id, type, sha1('gone:' || element_id) < '2' AS gone, element_id % 11 = 0 AS bare FROM elements_gold),
s AS (SELECT sketch_id, frame_id, count(*) AS n, count(*) FILTER (type = 'icon') AS icons, count(*) FILTER (type = 'check') AS checks, count(*) FILTER (gone AND type NOT IN ('icon', 'check', 'divider')) AS less, count(*) FILTER (bare AND NOT gone AND type NOT IN ('icon', 'check', 'divider')) AS other FROM e GROUP BY ALL),
t AS (SELECT sketch_id, 1 + sum(3 + n + (icons > 0)::INT + icons + (checks > 0)::INT + checks) AS size, sum(less + other) AS d FROM s GROUP BY 1) SELECT sketch_id, round(1 - d / size, 9)::DOUBLE AS similarity FROM t""", "elements_gold")
def udf_spec_similarity(spark, sf):
    """Whole documents against themselves without some elements and with some as dividers, which no shorter way than that can mend. Icons and checks stay, so the bars do, and dividers."""
    e = S.elements_gold(spark, sf).withColumn("name", F.concat(F.lit("i"), (F.col("element_id") % 5).cast("string")))
    kept = F.col("type").isin("icon", "check")
    gone = F.sha1(F.concat(F.lit("gone:"), F.col("element_id").cast("string"))) < "2"
    shown = e.filter(kept | (F.col("type") == "divider") | ~gone).withColumn("type", F.when((F.col("element_id") % 11 == 0) & ~kept, "divider").otherwise(F.col("type")))
    all_screens = e.select("sketch_id", "frame_id").distinct()
    pred = _documents_with(all_screens, shown)
    pairs = _documents(e).join(pred.withColumnRenamed("spec", "pred").hint("merge"), "sketch_id")
    return pairs.select("sketch_id", F.round(R.tree_similarity("spec", "pred"), 9).alias("similarity"))


def _documents_with(screens, elements):
    """Documents whose screens are all there, those without elements too."""
    empty = screens.join(elements.select("sketch_id", "frame_id").distinct().hint("merge"), ["sketch_id", "frame_id"], "left_anti")
    return _documents(elements.select("sketch_id", "frame_id", "element_id", "type", "name", "text").unionByName(empty.select("sketch_id", "frame_id", F.lit(None).cast("long").alias("element_id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"))))


@query("""WITH d AS (SELECT frame_id, frame_id % 9 AS m, count(*) AS k, min(element_id % 100000) AS first FROM elements_gold GROUP BY 1)
SELECT frame_id, code, path FROM (SELECT frame_id, CASE m WHEN 1 THEN 'schema' WHEN 2 THEN 'bad_go' WHEN 3 THEN 'nesting' WHEN 4 THEN 'dup_id' WHEN 5 THEN 'schema' WHEN 6 THEN 'schema' WHEN 7 THEN 'schema' WHEN 8 THEN 'depth' END AS code,
CASE m WHEN 1 THEN ['/screens/0/body/colour'] WHEN 2 THEN [('/screens/0/body/c/' || i || '/go') FOR i IN range(k)] WHEN 3 THEN ['/screens/0/body/item'] WHEN 4 THEN ['/screens/1/id'] WHEN 5 THEN ['/screens/0/body/n'] WHEN 6 THEN [('/screens/0/body/c/' || i || '/s') FOR i IN range(k)] WHEN 7 THEN ['/'] WHEN 8 THEN [('/screens/0/body/c/0/c/0/c/0/c/0/c/0/c/0/c/0/c/0/c/0/c/' || i) FOR i IN range(k)] ELSE []::VARCHAR[] END AS paths FROM d), unnest(paths) p(path)""", "elements_gold")
def prj_validate_documents(spark, sf):
    """Each frame's texts as a document with one kind of fault: an unknown key, links to no screen, repeats in repeats, equal ids, a number out of range, a word outside an enumeration, no JSON, too deep a body."""
    from annomill.operators.spec_rules import validate_specs

    m = F.col("frame_id") % 9
    more = F.when(m == 2, ',"go":"nowhere"').when(m == 6, ',"s":"huge"').otherwise("")
    text = F.concat(F.lit('{"t":"text","v":"'), "type", F.lit('"'), more, F.lit("}"))
    docs = S.elements_gold(spark, sf).groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", text.alias("n")))), lambda x: x["n"]), ",").alias("ns"))
    body = F.concat(F.lit('{"t":"col",'), F.when(m == 1, '"colour":1,"c":[').otherwise('"c":['), "ns", F.lit("]}"))
    listed = lambda n, b: F.concat(F.lit(f'{{"t":"list","n":{n},"item":'), b, F.lit("}"))
    deep = F.concat(F.lit('{"t":"col","c":[' * 9), body, F.lit("]}" * 9))
    body = F.when(m == 3, listed(2, listed(3, body))).when(m == 5, listed(51, body)).when(m == 8, deep).otherwise(body)
    screen = F.concat(F.lit('{"id":"a","title":"Frame","body":'), body, F.lit("}"))
    whole = F.concat(F.lit('{"v":1,"screens":['), screen, F.when(m == 4, ',{"id":"a","title":"Again","body":{"t":"spacer"}}').otherwise(""), F.when(m == 7, "").otherwise("]}"))
    return validate_specs(docs.select("frame_id", whole.alias("spec")), "frame_id", "spec").select(F.col("doc").alias("frame_id"), "code", "path")


@query("""WITH c AS (SELECT frame_id, element_id, '{"t":"text","v":"' || type || element_id % 100 || '"}' AS n FROM elements_gold), d AS (SELECT frame_id, list(n ORDER BY element_id) AS ns, count(*) AS k FROM c GROUP BY 1),
b AS (SELECT frame_id, frame_id % 8 AS m, k, '{"t":"col","c":[' || array_to_string(ns, ',') || ']}' AS body, CASE WHEN frame_id % 8 = 3 THEN array_to_string(ns, ',') END AS cs FROM d)
SELECT frame_id, CASE WHEN m = 7 THEN NULL ELSE '{"v":1,"screens":[{"id":"s' || frame_id || '","title":"Frame","body":' || CASE WHEN m = 6 THEN '{"t":"list","n":2,"item":' || body || '}' ELSE body END || '}]}' END AS spec,
CASE m WHEN 0 THEN '' WHEN 1 THEN 'stripped text around JSON' WHEN 2 THEN 'removed trailing commas' WHEN 3 THEN 'closed unbalanced brackets' WHEN 4 THEN 'dropped unknown keys on col|dropped node of unknown type' WHEN 5 THEN 'removed links to missing screens' WHEN 6 THEN 'unwrapped nested list' ELSE 'not JSON' END AS fixes FROM b""", "elements_gold")
def prj_repair_documents(spark, sf):
    """Each frame's texts as a document: whole, amid prose, with commas too many, cut off, with odd keys and nodes, dead links, repeats in repeats, or none at all."""
    from annomill.operators.repair import repair_specs

    m = F.col("frame_id") % 8
    text = F.concat(F.lit('{"t":"text","v":"'), "type", (F.col("element_id") % 100).cast("string"), F.lit('"'), F.when(m == 5, ',"go":"nowhere"}').otherwise("}"))
    docs = S.elements_gold(spark, sf).groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", text.alias("n")))), lambda x: x["n"]), ",").alias("ns"))
    body = F.concat(F.lit('{"t":"col",'), F.when(m == 4, '"colour":1,"c":[{"t":"map"},').otherwise('"c":['), "ns", F.when(m == 2, ",]}").otherwise("]}"))
    body = F.when(m == 6, F.concat(F.lit('{"t":"list","n":2,"item":{"t":"list","n":3,"item":'), body, F.lit("}}"))).otherwise(body)
    whole = F.concat(F.lit('{"v":1,"screens":[{"id":"s'), F.col("frame_id").cast("string"), F.lit('","title":"Frame","body":'), body, F.when(m == 3, "").otherwise("}]}"))
    raw = F.when(m == 1, F.concat(F.lit("Sure:\n"), whole, F.lit("\nDone."))).when(m == 7, F.lit("I can't draw that.")).otherwise(whole)
    return repair_specs(docs.select("frame_id", raw.alias("raw")), "frame_id", "raw").select("frame_id", "spec", F.array_join("fixes", "|").alias("fixes"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def prj_repair_text_json(spark, sf):
    """Text around, a trailing comma or a missing bracket is mended."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: "), "props", F.lit(" ok"))).when(F.col("event_id") % 3 == 1, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.regexp_replace("props", r"\}$", ""))
    return S.table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json(R.repair_json(broken)), "$.k", "int").alias("k"))


@query("SELECT event_id, props AS json FROM events")
def prj_extract_json(spark, sf):
    return S.table(spark, sf, "events").select("event_id", T.extract_json(F.concat(F.lit("out: "), "props", F.lit("."))).alias("json"))


@query("""WITH RECURSIVE t AS (SELECT sketch_id, element_id, x, y, w, h FROM elements_gold WHERE type <> 'btn'),
p AS (SELECT a.sketch_id, a.element_id AS a, b.element_id AS b FROM t a JOIN t b ON a.sketch_id = b.sketch_id AND a.element_id <> b.element_id WHERE least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 0.5 * least(a.h, b.h) AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) < 60),
r AS (SELECT sketch_id, element_id AS a, element_id AS b FROM t UNION SELECT r.sketch_id, r.a, p.b FROM r JOIN p ON p.sketch_id = r.sketch_id AND p.a = r.b) SELECT sketch_id, a AS element_id, min(b) AS component FROM r GROUP BY 1, 2""", "elements_gold")
def jn_same_line_groups(spark, sf):
    from annomill.operators.joins import same_line_pairs

    e = S.elements_gold(spark, sf).filter("type <> 'btn'").select("sketch_id", "element_id", "x", "y", "w", "h")
    return R.connected(same_line_pairs(e, "sketch_id", "element_id", 60.0), e, "sketch_id", "element_id")


GEO = """WITH d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM points WINDOW w AS (PARTITION BY sketch_id, stroke_id ORDER BY seq)),
g AS (SELECT sketch_id, stroke_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sum(step) AS len, count(*) AS n, arg_min(x, seq) AS sx, arg_min(y, seq) AS sy, arg_max(x, seq) AS ex, arg_max(y, seq) AS ey, min(t) AS t0, max(t) AS t1 FROM d GROUP BY ALL),
f AS (SELECT *, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS gap, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS diag FROM g)"""


@query(f"""{GEO} SELECT sketch_id, stroke_id, n, round((x0 + x1) / 2, 6) AS cx, round(ln(len + 1), 6) AS log_length, round(CASE WHEN diag > 0 THEN gap / diag ELSE 0 END, 6) AS closure, round(CASE WHEN len > 0 THEN gap / len ELSE 1 END, 6) AS straightness,
t1 - t0 AS duration, coalesce(t0 - lag(t1) OVER (PARTITION BY sketch_id ORDER BY stroke_id), 0)::BIGINT AS pause, round(ln((x1 - x0 + 1) / (y1 - y0 + 1)), 6) AS aspect FROM f""", "points")
def feat_stroke_geometry(spark, sf):
    g = X.stroke_geometry(S.points(spark, sf))
    return g.select("sketch_id", "stroke_id", "n", *(F.round(c, 6).alias(c) for c in ("cx", "log_length", "closure", "straightness", "aspect")), "duration", "pause")


@query(f"""{GEO}, u AS (SELECT sketch_id, coalesce(fx, ix) AS ox, coalesce(fy, iy) AS oy, greatest(coalesce(fu, iu), 0.001) AS unit FROM (SELECT sketch_id, min(x) AS ix, min(y) AS iy, (max(y) - min(y)) / 2 AS iu FROM points GROUP BY 1) LEFT JOIN (SELECT sketch_id, min(fx) AS fx, min(fy) AS fy, quantile_cont(fh, 0.5) / 2 AS fu FROM frames GROUP BY 1) USING (sketch_id)),
p AS (SELECT *, coalesce(t0 - lag(t1) OVER w, 0) AS pause, (t0 - first(t0) OVER w) / 60000 AS minutes FROM f WINDOW w AS (PARTITION BY sketch_id ORDER BY stroke_id))
SELECT sketch_id, stroke_id, unnest(range(16))::INT AS k, unnest([round(v, 5) FOR v IN [((x0 + x1) / 2 - ox) / unit, ((y0 + y1) / 2 - oy) / unit, (x1 - x0) / unit, (y1 - y0) / unit, ln(1 + 10 * len / unit), CASE WHEN diag > 0 THEN gap / diag ELSE 0 END, CASE WHEN len > 0 THEN gap / len ELSE 1 END, ln(1 + n) / 6,
ln(1 + greatest(t1 - t0, 0) / 100), ln(1 + greatest(pause, 0) / 100), minutes, (sx - ox) / unit, (sy - oy) / unit, (ex - ox) / unit, (ey - oy) / unit, ln((x1 - x0 + 0.001) / (y1 - y0 + 0.001)) / 4]]) AS v FROM p JOIN u USING (sketch_id)""", "frames", "points")
def feat_scaled_geometry(spark, sf):
    from annomill.operators.aggregates import sketch_unit

    points = S.points(spark, sf)
    frames = S.frames(spark, sf).select("sketch_id", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fh").alias("h"))
    found = X.scaled_geometry(X.stroke_geometry(points), sketch_unit(frames, points, "sketch_id"))
    return found.select("sketch_id", "stroke_id", F.posexplode("geometry").alias("k", "v")).withColumn("v", F.round("v", 5))


@query(f"""WITH {RESAMPLE.format(last=31)}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY sketch_id, stroke_id) AS rx, y - avg(y) OVER (PARTITION BY sketch_id, stroke_id) AS ry,
coalesce(lead(x) OVER w - x, 0) AS dx, coalesce(lead(y) OVER w - y, 0) AS dy FROM e WINDOW w AS (PARTITION BY sketch_id, stroke_id ORDER BY i)),
u AS (SELECT *, CASE WHEN sqrt(dx ** 2 + dy ** 2) > 0 THEN sqrt(dx ** 2 + dy ** 2) ELSE 1 END AS size FROM c)
SELECT sketch_id, stroke_id, count(*)::INT AS n, round(sum(abs(rx)), 3) AS spread_x, round(sum(abs(ry)), 3) AS spread_y, round(sum(dx / size), 3) AS way_x, round(sum(dy / size), 3) AS way_y, round(arg_min(rx, i), 3) AS first_x FROM u GROUP BY ALL""", "points")
def feat_stroke_shape(spark, sf):
    total = lambda f: F.round(F.aggregate("shape", F.lit(0.0), lambda a, s: a + f(s)), 3)
    return X.stroke_shape(S.points(spark, sf)).select(
        "sketch_id", "stroke_id", F.size("shape").alias("n"), total(lambda s: F.abs(s[0])).alias("spread_x"), total(lambda s: F.abs(s[1])).alias("spread_y"), total(lambda s: s[2]).alias("way_x"), total(lambda s: s[3]).alias("way_y"),
        F.round(F.col("shape")[0][0], 3).alias("first_x"),
    )


@query(f"""WITH RECURSIVE {GEO[5:]}, pt AS (SELECT p.*, 0.06 * greatest(diag, 1e-6) AS tol, greatest(0.4 * (y1 - y0), 0.5) AS swing FROM points p JOIN f USING (sketch_id, stroke_id)), {TURNS.format(least='swing', points='pt')}, {CORNERS.format(points='pt', tolerance='max(tol)')},
tu AS (SELECT sketch_id, stroke_id, arg_max(turns, k)::INT AS turns FROM r GROUP BY ALL), co AS (SELECT sketch_id, stroke_id, ((count(*) - 1) // 2)::INT AS corners FROM seg GROUP BY ALL),
ar AS (SELECT sketch_id, stroke_id, CASE WHEN count(*) < 3 THEN 0 ELSE abs(sum(x * ny - nx * y)) / 2 END AS area FROM (SELECT sketch_id, stroke_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM points WINDOW w AS (PARTITION BY sketch_id, stroke_id ORDER BY seq)) GROUP BY ALL)
SELECT sketch_id, stroke_id, round(CASE WHEN diag > 0 THEN gap / diag ELSE 0 END, 5) AS closure, round(CASE WHEN len > 0 THEN gap / len ELSE 1 END, 5) AS straightness, corners, round(area / greatest((x1 - x0) * (y1 - y0), 1e-6), 4) AS area_ratio, turns FROM f JOIN tu USING (sketch_id, stroke_id) JOIN co USING (sketch_id, stroke_id) JOIN ar USING (sketch_id, stroke_id)""", "points")
def feat_rule_features(spark, sf):
    return X.rule_features(S.points(spark, sf)).select("sketch_id", "stroke_id", F.round("closure", 5).alias("closure"), F.round("straightness", 5).alias("straightness"), "corners", F.round("area_ratio", 4).alias("area_ratio"), "turns")


@query("SELECT element_id, list_position(['btn', 'input', 'text'], type) AS p, coalesce(list_position(['btn', 'input', 'text'], type) - 1, 3)::INT AS type_index FROM elements_gold".replace("list_position(['btn', 'input', 'text'], type) AS p, ", ""), "elements_gold")
def feat_stroke_labels(spark, sf):
    e = S.elements_gold(spark, sf)
    groups = e.select("sketch_id", F.col("element_id").alias("grp"), F.lit("element").alias("kind"), "type")
    return X.stroke_labels(e.select("sketch_id", "element_id", F.col("element_id").alias("grp")), groups, "sketch_id", "grp", ["btn", "input", "text"]).select("element_id", "type_index")


@query("SELECT a.sketch_id, a.stroke_id AS i, b.stroke_id AS j, a.stroke_id % 3 = b.stroke_id % 3 AS same FROM (SELECT DISTINCT sketch_id, stroke_id FROM points) a JOIN (SELECT DISTINCT sketch_id, stroke_id FROM points) b ON a.sketch_id = b.sketch_id AND a.stroke_id <> b.stroke_id", "points")
def feat_pair_targets(spark, sf):
    strokes = S.points(spark, sf).select("sketch_id", "stroke_id").distinct().withColumn("g", F.col("stroke_id") % 3)
    return X.pair_targets(strokes, "sketch_id", "stroke_id", "g")


@query("WITH n AS (SELECT sketch_id, stroke_id, count(*) AS n FROM points GROUP BY ALL) SELECT sketch_id, stroke_id, (max(n) OVER (PARTITION BY sketch_id))::INT AS padded, n::INT AS own FROM n", "points")
def feat_pad_batches(spark, sf):
    seqs = S.points(spark, sf).groupBy("sketch_id", "stroke_id").agg(F.collect_list("x").alias("xs"))
    padded = X.pad_batches(seqs, ["sketch_id"], "xs", -100.0)
    return padded.select("sketch_id", "stroke_id", F.size("padded").alias("padded"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("own"))


@query("SELECT doc_id, lang AS split, n_chars, sha256(text) AS text_sha256 FROM documents")
def src_shards_round_trip(spark, sf):
    """Documents written as compressed JSON shards by language, and the shards of all languages read again."""
    path = shared_dir(spark, "shards")
    docs = S.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split"), "n_chars", "text")
    writers.write_shards(docs, path, "split", ["doc_id"], 200)
    back = spark.read.schema("doc_id long, split string, n_chars long, text string").option("basePath", path).json(path)
    return back.select("doc_id", "split", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def src_read_shards(spark, sf):
    path = shared_dir(spark, "shards")
    writers.write_shards(S.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split"), "n_chars"), path, "split", ["doc_id"], 200)
    return readers.read_shards(spark, path, "en", "doc_id long, n_chars long").select("doc_id", "n_chars")


@query("SELECT conv_id, turn, role, text FROM conversations")
def src_jsonl_round_trip(spark, sf):
    path = shared_dir(spark, "rows")
    writers.write_rows(S.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    return readers.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT c_custkey, c_name FROM customer")
def src_lookup_csv(spark, sf):
    path = shared_dir(spark, "csv")
    S.table(spark, sf, "customer").select("c_custkey", "c_name").write.csv(path, header=True)
    return readers.read_lookup_csv(spark, path, "c_custkey long, c_name string")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'error' ELSE 'ok' END AS reason, CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS name FROM supplier")
def src_documents(spark, sf):
    """A file per supplier, some of which are no JSON."""
    path = shared_dir(spark, "documents")
    text = F.when(F.col("s_suppkey") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("s_name").alias("name"))))
    rows = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("value"))
    # few bytes but many files: a stated number of tasks isn't joined to one, and each moves its own files into place
    rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("id").text(path)
    return readers.read_documents(spark, path, r"id=(\d+)/").select("id", "reason", F.try_variant_get("doc", "$.name", "string").alias("name"))


@query("SELECT p_partkey::VARCHAR || '.json' AS name, p_name AS part FROM part")
def src_bundle(spark, sf):
    """Parts zipped by a hash of their key; an archive is a text row whose line separator is the zero byte it ends with."""
    path = shared_dir(spark, "bundles")
    parts = S.table(spark, sf, "part").select("p_partkey", F.to_json(F.struct("p_name")).alias("text"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for k, t in zip(pdf["p_partkey"], pdf["text"], strict=True):
                z.writestr(f"{k}.json", t)
        return pd.DataFrame({"zip": [held.getvalue()[:-1]]})

    bundles = max(1, parts.count() // 200)
    zipped = parts.withColumn("bundle", F.pmod(F.xxhash64("p_partkey"), F.lit(bundles))).groupBy("bundle").applyInPandas(work, "zip binary")
    zipped.select(F.col("zip").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return readers.read_bundle(spark, path, "part-*").select("name", F.get_json_object("text", "$.p_name").alias("part"))


@query("SELECT s_nationkey::BIGINT AS s_nationkey, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT -1, NULL")
def src_blobs(spark, sf):
    """Suppliers' rows as files, the files' names as records, and one record without a file."""
    path = shared_dir(spark, "blobs")
    S.table(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    where = F.col("_metadata.file_path")
    records = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_extract(where, r"s_nationkey=(\d+)/", 1).cast("long").alias("s_nationkey"), F.substring_index(where, "/", -2).alias("file")).distinct()
    records = records.unionByName(spark.createDataFrame([(-1, "none")], records.schema))
    blobs = readers.read_blobs(spark, records, path, "file", parts=2)
    lines = F.size(F.split(F.rtrim(F.col("blob").cast("string"), F.lit("\n")), "\n"))
    return blobs.groupBy("s_nationkey").agg(F.sum(F.when(F.col("blob").isNotNull(), lines)).alias("n"))


@query("SELECT l.kind, l.flag, r.n, CASE WHEN n IS NULL THEN 'pending' ELSE 'done' END AS status FROM (SELECT kind, flag FROM (SELECT DISTINCT event_type AS kind FROM events), (SELECT DISTINCT l_returnflag AS flag FROM lineitem)) l LEFT JOIN (SELECT event_type AS kind, CASE event_id % 2 WHEN 0 THEN 'A' ELSE 'N' END AS flag, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL) r USING (kind, flag)")
def src_results(spark, sf):
    """Results of some methods as JSON rows, read against the whole grid."""
    path = shared_dir(spark, "results")
    e = S.table(spark, sf, "events")
    e.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("N").alias("flag")).agg(F.count("*").alias("n")).write.json(path)
    kinds, flags = e.select(F.col("event_type").alias("kind")).distinct(), S.table(spark, sf, "lineitem").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    grid = kinds.join(F.broadcast(flags)).select("kind", F.explode("flags").alias("flag"))  # one row: the set of flags
    return readers.read_results(spark, path, "kind string, flag string, n long", grid, ["kind", "flag"], "n")


@query("SELECT element_id, type FROM elements_pred", "elements_gold", "elements_pred")
def src_eval_inputs(spark, sf):
    gold, recognized = shared_dir(spark, "gold"), shared_dir(spark, "recognized")
    for df, path in ((S.elements_gold(spark, sf), gold), (S.elements_pred(spark, sf), recognized)):
        writers.write_rows(df.select("element_id", "type"), path)
    return readers.read_eval_inputs(spark, gold, recognized, "recognized", "element_id long, type string")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def snk_stats(spark, sf):
    path = shared_dir(spark, "stats")
    writers.write_stats(S.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), path, "documents", "all")
    return spark.read.schema("lang string, n long").json(f"{path}/documents_all")


@query("""WITH l AS (SELECT lang, count(*) AS n, sum(n_chars) / count(*) AS mean FROM documents GROUP BY 1) SELECT line FROM (SELECT unnest(['## Documents', '', '| lang | n | mean |', '|---|---|---|']) AS line UNION ALL SELECT '| ' || lang || ' | ' || n || ' | ' || printf('%.3f', mean) || ' |' FROM l)""")
def snk_report(spark, sf):
    figures = S.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), (F.sum("n_chars") / F.count("*")).alias("mean"))
    return spark.createDataFrame([(x,) for x in writers.render_report(figures, "Documents", ["lang"]).split("\n")], "line string")


@query("SELECT lang, count(*) AS n FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 30 GROUP BY 1")
def snk_export_eval(spark, sf):
    path = shared_dir(spark, "eval")
    writers.export_eval(S.table(spark, sf, "documents"), path, "lang", ["doc_id"], 30, {"gold": ["doc_id", "n_chars"], "ink": ["doc_id", "text"]})
    return spark.read.schema("lang string, doc_id long").json(f"{path}/gold").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents")
def snk_write_new(spark, sf):
    """Half the documents, then all: the second call adds the rest alone."""
    path = shared_dir(spark, "cache")
    docs = S.table(spark, sf, "documents").select("doc_id", "n_chars")
    writers.write_new(docs.filter("doc_id % 2 = 0"), path, "doc_id")
    writers.write_new(docs, path, "doc_id")
    return spark.read.schema(docs.schema).parquet(path)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def snk_upsert_by_id(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_id", "value")
    return writers.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'repair' ELSE 'strict' END AS engine, event_id % 4 = 0 AS fell_back, props->>'k' AS output FROM events")
def udf_with_fallback(spark, sf):
    """A strict parser, and one that looks for the value where the text is cut off."""

    def strict(text):
        return str(json.loads(text)["k"])

    def repair(text):
        return re.search(r'"k"\s*:\s*(-?\d+)', text)[1]

    cut = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    rows = R.with_fallback(S.table(spark, sf, "events").select("event_id", cut.alias("text")), [("strict", strict), ("repair", repair)], "text")
    return rows.select("event_id", "engine", "fell_back", "output")


@query(f"{GEO} SELECT sketch_id, stroke_id, round(1 / (1 + exp(-(2 * CASE WHEN diag > 0 THEN gap / diag ELSE 0 END - CASE WHEN len > 0 THEN gap / len ELSE 1 END + 0.1 * ln(len + 1)))), 6) AS score FROM f", "points")
def udf_score_batches(spark, sf):
    """A linear model over stroke features, batch by batch."""

    def make():
        weights = np.array([2.0, -1.0, 0.1])

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            z = pdf[["closure", "straightness", "log_length"]].to_numpy() @ weights
            return pdf[["sketch_id", "stroke_id"]].assign(score=(1 / (1 + np.exp(-z))).round(6))

        return score

    features = X.stroke_geometry(S.points(spark, sf)).select("sketch_id", "stroke_id", "closure", "straightness", "log_length")
    return R.score_batches(features, make, "sketch_id long, stroke_id long, score double")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))::INT AS n FROM documents")
def udf_token_count(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


def _log_files(spark, sf, parts: int = 3) -> tuple[str, str, int]:
    """The run log as files that are written one period after another, as a stream finds them: path, schema and files a period. A device's rows of a period are in one file."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, "log")
    log = S.run_log(spark, sf)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = log.select(at.alias("t")).approxQuantile("t", [k / parts for k in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        period = log if low is None else log.filter(at > int(low))
        (period if high is None else period.filter(at <= int(high))).repartition(files, "device").write.mode("append").parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema), files


@query("SELECT kind, count(*) AS n, count(DISTINCT device) AS devices FROM run_log WHERE kind <> 'info' GROUP BY 1", "run_log")
def str_ingest_records(spark, sf):
    path, schema, files = _log_files(spark, sf)
    out = shared_dir(spark, "ingest")
    for k in ("good", "bad", "registry"):  # the folders are there before the first batch
        spark.createDataFrame([], "batch int").write.parquet(f"{out}/{k}/batch=-1")
    ingest.ingest_records(ingest.event_stream(spark, path, schema, files), f"{out}/good", f"{out}/bad", f"{out}/registry", f"{out}/checkpoint", [("info", F.col("kind") == "info")], "device").awaitTermination()
    good = spark.read.schema(f"{schema}, split string, batch int").parquet(f"{out}/good").filter("batch >= 0")
    return good.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("device").alias("devices"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def str_ingest_upsert(spark, sf):
    path, out = shared_dir(spark, "events"), shared_dir(spark, "upsert")
    e = S.table(spark, sf, "events").select("user_id", "event_id", "value")
    e.repartitionByRange(3, "event_id").write.parquet(path)
    stream = ingest.ingest_upsert(ingest.event_stream(spark, path, "user_id long, event_id long, value double"), f"{out}/table", f"{out}/checkpoint", "user_id", "event_id", fan=2)
    stream.awaitTermination()
    return ingest.read_upserted(spark, f"{out}/table", "user_id long, event_id long, value double", "user_id", "event_id", fan=2)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, kind, step) AS k FROM run_log), l AS (SELECT *, sum((kind = 'launch')::INT) OVER (PARTITION BY device ORDER BY k) AS life FROM o), n AS (SELECT * FROM l QUALIFY life = max(life) OVER (PARTITION BY device)),
v AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 WHEN kind IN ('end', 'fail') THEN -1 ELSE 0 END) OVER (PARTITION BY device, step ORDER BY k) AS level FROM n)
SELECT device, step, (arg_max(level, k) - least(0, min(level)))::INT AS open FROM v GROUP BY ALL HAVING arg_max(level, k) > least(0, min(level))""", "run_log")
def str_unfinished_steps(spark, sf):
    """The open steps after the last batch of a device, from a stream in time order; rows of one time go by kind, then step."""
    path, schema, files = _log_files(spark, sf)
    out = shared_dir(spark, "steps")
    found = ingest.unfinished_steps(ingest.event_stream(spark, path, schema, files))

    def keep(df, number):
        df.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema("device long, steps array<string>, open array<int>, batch int").parquet(f"{out}/table").groupBy("device").agg(F.max_by(F.struct("steps", "open"), "batch").alias("s"))
    return last.select("device", F.explode(F.arrays_zip("s.steps", "s.open")).alias("x")).select("device", F.col("x.steps").alias("step"), F.col("x.open").alias("open"))


@query("SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS median_ms FROM stage_times GROUP BY 1", "stage_times")
def str_stage_metrics(spark, sf):
    path, out = shared_dir(spark, "stages"), shared_dir(spark, "metrics")
    S.stage_times(spark, sf).write.parquet(path)
    ingest.stage_metrics(ingest.event_stream(spark, path, "event_id long, stage string, ms double, fell_back boolean"), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").groupBy("stage").agg(F.count("*").alias("n"), F.round(F.percentile("ms", 0.5), 6).alias("median_ms"))
