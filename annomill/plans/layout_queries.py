"""Queries of layout, prompt and document-score operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annomill.functions.numeric import uniform
from annomill.functions.text import token_count
from annomill.operators import joins as J
from annomill.operators import layouts as L

from . import standins as S
from .registry import query


def _frames(spark, sf):
    return S.frames(spark, sf).select("sketch_id", "frame_id", "ord", *(F.col("f" + c).alias(c) for c in "xywh"))


def _arrows(spark, sf):
    from .join_queries import _arrows as arrows

    return arrows(spark, sf).withColumns({"hx": F.col("tx") + 500, "hy": F.col("ty")})


def xy_sql(doc: str, rounds: int) -> str:
    """Bands of y and x by turns, each round within the regions of the one before."""
    from .window_queries import bands_sql

    parts = [f"n0 AS (SELECT {doc}, element_id, x, y, w, h, '' AS path FROM elements_gold)"]
    for k in range(2 * rounds):
        a, size = ("y", "h") if k % 2 == 0 else ("x", "w")
        parts.append(bands_sql(f"b{k}", f"SELECT *, {doc} || '|' || path AS region, {a} AS lo, {a} + {size} AS hi, 0.15 * {size} AS s FROM n{k}", "region", "lo, element_id"))
        parts.append(f"n{k + 1} AS (SELECT {doc}, element_id, x, y, w, h, CASE WHEN max(band) OVER (PARTITION BY region) > 0 THEN path || '{a}' || lpad(band::VARCHAR, 3, '0') ELSE path END AS path FROM b{k})")
    return ", ".join(parts) + f", cut AS (SELECT {doc}, element_id, path, row_number() OVER (PARTITION BY {doc} ORDER BY path, y, x, element_id) AS place FROM n{2 * rounds})"


@query(f"WITH RECURSIVE {xy_sql('frame_id', 2)} SELECT frame_id, element_id, path, place::INT AS place FROM cut", "elements_gold")
def win_xy_cut(spark, sf):
    return L.xy_cut(S.elements_gold(spark, sf), "frame_id", "element_id", rounds=2)


@query(f"WITH RECURSIVE {xy_sql('sketch_id', 7)} SELECT sketch_id, element_id, path, place::INT AS place FROM cut", "elements_gold")
def win_xy_cut_whole(spark, sf):
    """Until nothing splits; whole sketches here, of at most three frames of seven elements."""
    return L.xy_cut(S.elements_gold(spark, sf), "sketch_id", "element_id")


@query("""WITH RECURSIVE m AS (SELECT frame_id, quantile_cont(h, 0.5) / 2 AS m FROM elements_gold GROUP BY 1), i AS (SELECT frame_id, element_id, y + h / 2 AS c, m, row_number() OVER (PARTITION BY frame_id ORDER BY y + h / 2, x, element_id) AS k FROM elements_gold JOIN m USING (frame_id)),
r AS (SELECT frame_id, element_id, k, 0 AS line, c AS first FROM i WHERE k = 1 UNION ALL SELECT i.frame_id, i.element_id, i.k, CASE WHEN i.c - first <= m THEN line ELSE line + 1 END, CASE WHEN i.c - first <= m THEN first ELSE i.c END FROM r JOIN i ON i.frame_id = r.frame_id AND i.k = r.k + 1)
SELECT frame_id, element_id, line::INT AS line FROM r""", "elements_gold")
def win_line_group(spark, sf):
    return L.line_group(S.elements_gold(spark, sf), "frame_id", "element_id")


def diverse_sql(docs: str, seed: str, k: int) -> str:
    """docs: (frame_id, kinds). Documents in hash order, one a step, until k are taken."""
    u = f"('0x' || substr(sha1('{seed}/luck:' || frame_id), 1, 8))::BIGINT / 4294967296"
    return f"""d AS (SELECT frame_id, kinds, {u} AS luck, row_number() OVER (ORDER BY ('0x' || substr(sha1('{seed}:' || frame_id), 1, 8))::BIGINT, frame_id) AS k FROM ({docs})),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS out, []::VARCHAR[] AS seen UNION ALL SELECT k, CASE WHEN take THEN list_append(out, frame_id) ELSE out END, CASE WHEN take THEN list_concat(seen, kinds) ELSE seen END
FROM (SELECT d.*, f.out, f.seen, luck < 0.3 OR len([t FOR t IN kinds IF len([s FOR s IN seen IF s = t]) < 4]) > 0 AS take FROM f JOIN d ON d.k = f.k + 1 WHERE len(f.out) < {k})),
picked AS (SELECT unnest(out) AS frame_id, generate_subscripts(out, 1) - 1 AS place FROM (SELECT arg_max(out, k) AS out FROM f))"""


@query(f"WITH RECURSIVE {diverse_sql('SELECT frame_id, list(DISTINCT type) AS kinds FROM elements_gold GROUP BY 1', 'pick', 25)} SELECT place::INT AS place, frame_id FROM picked", "elements_gold")
def top_greedy_diverse(spark, sf):
    kinds = S.elements_gold(spark, sf).groupBy("frame_id").agg(F.collect_set("type").alias("kinds"))
    return L.greedy_diverse(kinds, "frame_id", "kinds", k=25, seed="pick").select(F.col("place").cast("int").alias("place"), "frame_id")


FORMAT = """WITH n AS (SELECT e.*, f.ord, row_number() OVER (PARTITION BY e.sketch_id ORDER BY f.ord, floor(y + 0.5), floor(x + 0.5), element_id) AS number FROM elements_gold e JOIN frames f ON e.sketch_id = f.sketch_id AND e.frame_id = f.frame_id),
l AS (SELECT sketch_id, ord AS a, number AS b, number || ' ' || type || ' ' || floor(100 * (x - fx) / 360 + 0.5)::INT || ',' || floor(100 * y / 760 + 0.5)::INT || ',' || floor(100 * w / 360 + 0.5)::INT || ',' || floor(100 * h / 760 + 0.5)::INT || coalesce(' "' || text || '"', '') AS s FROM n
UNION ALL SELECT sketch_id, ord, 0, 'S' || (ord + 1) FROM frames)"""


@query(f"{FORMAT} SELECT sketch_id, string_agg(s, chr(10) ORDER BY a, b) AS prompt FROM l GROUP BY 1", "frames", "elements_gold")
def fn_format_elements(spark, sf):
    none = _arrows(spark, sf).filter(F.lit(False))
    return L.format_elements(S.elements_gold(spark, sf).drop("frame_id", "fx"), _frames(spark, sf), none, "sketch_id")


@query(f"""{FORMAT}, a AS (SELECT sketch_id, min(frame_id) FILTER (ord = 0) AS arrow, 10.0 + (min(frame_id) FILTER (ord = 0)) % 300 AS tx, 10.0 + 7 * ((min(frame_id) FILTER (ord = 0)) % 100) AS ty FROM frames GROUP BY 1 HAVING count(*) >= 2),
e AS (SELECT a.sketch_id, n.frame_id, n.number, tx BETWEEN x - 14.4 AND x + w + 14.4 AND ty BETWEEN y - 14.4 AND y + h + 14.4 AS hit, w * h AS area, sqrt(greatest(x - tx, 0, tx - x - w) ** 2 + greatest(y - ty, 0, ty - y - h) ** 2) AS far, element_id FROM a JOIN n ON n.sketch_id = a.sketch_id),
src AS (SELECT * FROM e WHERE hit OR far < 54 QUALIFY row_number() OVER (PARTITION BY sketch_id ORDER BY NOT hit, CASE WHEN hit THEN area ELSE far END, element_id) = 1),
tgt AS (SELECT a.sketch_id, f.frame_id, f.ord FROM a JOIN frames f ON f.sketch_id = a.sketch_id QUALIFY row_number() OVER (PARTITION BY a.sketch_id ORDER BY NOT (tx + 500 BETWEEN fx AND fx + fw AND ty BETWEEN fy AND fy + fh),
CASE WHEN tx + 500 BETWEEN fx AND fx + fw AND ty BETWEEN fy AND fy + fh THEN f.ord ELSE sqrt(greatest(fx - tx - 500, 0, tx + 500 - fx - fw) ** 2 + greatest(fy - ty, 0, ty - fy - fh) ** 2) END, f.ord) = 1),
m AS (SELECT * FROM l UNION ALL SELECT src.sketch_id, 1073741824, 1, 'L ' || number || '>S' || (tgt.ord + 1) FROM src JOIN tgt ON tgt.sketch_id = src.sketch_id AND tgt.frame_id <> src.frame_id)
SELECT sketch_id, string_agg(s, chr(10) ORDER BY a, b) AS prompt FROM m GROUP BY 1""", "frames", "elements_gold")
def fn_format_with_links(spark, sf):
    return L.format_elements(S.elements_gold(spark, sf).drop("frame_id", "fx"), _frames(spark, sf), _arrows(spark, sf), "sketch_id")


@query(f"""{FORMAT}, p AS (SELECT sketch_id, string_agg(s, chr(10) ORDER BY a, b) AS prompt FROM l GROUP BY 1), c AS (SELECT sketch_id, string_agg(type, ' ' ORDER BY element_id) AS completion FROM elements_gold GROUP BY 1),
t AS (SELECT sketch_id, len(regexp_extract_all(prompt, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) + len(regexp_extract_all(completion, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) AS n FROM p JOIN c USING (sketch_id)) SELECT sketch_id, n::INT AS n_tokens, CASE WHEN n > 150 THEN 'too_long' ELSE 'fits' END AS status FROM t""", "frames", "elements_gold")
def smp_build_sft(spark, sf):
    e = S.elements_gold(spark, sf)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", "type"))), lambda x: x["type"]), " ")
    prompts = L.format_elements(e.drop("frame_id", "fx"), _frames(spark, sf), _arrows(spark, sf).filter(F.lit(False)), "sketch_id")
    return L.build_sft(prompts, e.groupBy("sketch_id").agg(words.alias("completion")), "sketch_id", 150).select("sketch_id", "n_tokens", "status")


@query("SELECT frame_id, condition, spec FROM (SELECT frame_id, 'gold' AS condition FROM elements_gold GROUP BY 1 UNION ALL SELECT frame_id, 'recognizer' FROM elements_pred GROUP BY 1) JOIN (SELECT frame_id, 'frame ' || ord AS spec FROM frames) USING (frame_id)", "frames", "elements_gold", "elements_pred")
def smp_eval_prompts(spark, sf):
    ids = lambda df: df.select("frame_id").distinct()
    specs = S.frames(spark, sf).select("frame_id", F.concat(F.lit("frame "), F.col("ord").cast("string")).alias("spec"))
    return L.eval_prompts(ids(S.elements_gold(spark, sf)), ids(S.elements_pred(spark, sf)), specs, "frame_id").select("frame_id", "condition", "spec")


@query("""WITH r AS (SELECT doc_id, source, ('0x' || substr(sha1('peers:' || doc_id), 1, 8))::BIGINT AS mark FROM documents), ringed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mark, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM r),
p AS (SELECT a.doc_id, string_agg(b.doc_id, ',' ORDER BY j) AS peers FROM ringed a, (VALUES (1), (2)) t(j), ringed b WHERE a.mark % 100 < 30 AND j < a.n AND b.source = a.source AND b.k = (a.k - 1 + j) % a.n + 1 GROUP BY 1)
SELECT doc_id, doc_id || coalesce(',' || peers, '') AS members FROM documents LEFT JOIN p USING (doc_id)""")
def smp_compose_samples(spark, sf):
    docs = S.table(spark, sf, "documents")
    found = L.compose_samples(docs, J.same_group_peers(docs, "doc_id", "source", seed="peers", share=30), "doc_id")
    return found.select("doc_id", F.array_join("members", ",").alias("members"))


def _nodes(df):
    return df.select("sketch_id", "type", F.when(F.col("type") == "btn", (F.col("frame_id") % 3).cast("string")).alias("go"), F.col("text").alias("label"), F.col("frame_id").alias("screen"))


def bag_sql(name: str, item: str, where: str) -> str:
    """common, n_gold and n_pred of a bag per sketch."""
    one = lambda t, n: f"SELECT sketch_id, {item} AS item, count(*) AS {n} FROM {t} WHERE {where} GROUP BY ALL"
    return f"{name} AS (SELECT sketch_id, sum(least(coalesce(g, 0), coalesce(p, 0))) AS c, sum(coalesce(g, 0)) AS g, sum(coalesce(p, 0)) AS p FROM ({one('elements_gold', 'g')}) FULL JOIN ({one('elements_pred', 'p')}) USING (sketch_id, item) GROUP BY 1)"


LETTER = "chr((65 + list_position(['" + "', '".join(S.TYPES) + "'], CASE WHEN element_id % 11 = 0 THEN 'divider' ELSE type END))::INT)"
SCORES = f"""WITH d AS (SELECT DISTINCT sketch_id, sketch_id % 6 <> 0 AS ok FROM elements_gold), {bag_sql('b', 'type', 'true')}, {bag_sql('k', 'frame_id % 3', "type = 'btn'")}, {bag_sql('t', 'text', 'text IS NOT NULL')},
gt AS (SELECT sketch_id, count(DISTINCT frame_id) AS frames, string_agg({LETTER}, '' ORDER BY element_id) AS s FROM elements_gold GROUP BY 1), pt AS (SELECT sketch_id, count(DISTINCT frame_id) AS frames, string_agg({LETTER}, '' ORDER BY element_id) AS s FROM elements_pred GROUP BY 1)
SELECT d.sketch_id, (pt.s IS NOT NULL)::INT::DOUBLE AS json_valid, ok::INT::DOUBLE AS schema_valid, round(CASE WHEN NOT ok OR pt.s IS NULL THEN 0 ELSE 1 - levenshtein(gt.s, pt.s) / (greatest(len(gt.s), len(pt.s)) + 1) END, 9) AS tree_similarity,
round(CASE WHEN ok THEN CASE WHEN b.g + b.p = 0 THEN 1 ELSE 2 * b.c / (b.g + b.p) END ELSE 0 END, 9)::DOUBLE AS type_f1, round(CASE WHEN coalesce(k.g, 0) = 0 THEN NULL WHEN ok THEN 2 * k.c / (k.g + k.p) ELSE 0 END, 9)::DOUBLE AS link_f1,
round(CASE WHEN NOT ok THEN 0 WHEN coalesce(t.g, 0) = 0 THEN 1 ELSE t.c / t.g END, 9)::DOUBLE AS label_recall, CASE WHEN ok AND gt.frames IS NOT DISTINCT FROM pt.frames THEN 1 ELSE 0 END::DOUBLE AS screens_correct
FROM d JOIN b USING (sketch_id) LEFT JOIN k USING (sketch_id) LEFT JOIN t USING (sketch_id) JOIN gt USING (sketch_id) LEFT JOIN pt USING (sketch_id)"""


@query(SCORES, "elements_gold", "elements_pred")
def ag_score_documents(spark, sf):
    from .tree_queries import _spec

    gold, pred = S.elements_both(spark, sf)
    specs = gold.groupBy("sketch_id").agg(_spec().alias("gold_spec")).join(pred.groupBy("sketch_id").agg(_spec().alias("pred_spec")).hint("merge"), "sketch_id", "left")
    found = L.score_documents(_nodes(gold), _nodes(pred), specs, "sketch_id", valid=F.col("sketch_id") % 6 != 0, specs=("gold_spec", "pred_spec"))
    return found.select("sketch_id", *(F.round(c, 9).alias(c) for c in found.columns if c != "sketch_id"))


HIERARCHY = """h AS (SELECT frame_id, element_id, k, row_number() OVER (PARTITION BY frame_id ORDER BY k) AS place, x - fx AS x, y, w / CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS w, h,
['Toolbar', 'Bottom Navigation', 'Icon', 'Image', 'Text'][((element_id // 100000 * 7 + k * 3) % 5 + 1)::INT] AS label, ['add', 'edit', 'menu'][((element_id // 100000 + k) % 3 + 1)::INT] AS icon, CASE WHEN k % 4 = 0 THEN '/' || k ELSE '/' || (k - k % 4) || '/' || k END AS path
FROM (SELECT *, element_id % 100000 AS k FROM elements_gold))"""


def _hierarchy(spark, sf):
    """Elements as a hierarchy: each fourth of a frame is the parent of the next three."""
    e = S.elements_gold(spark, sf).withColumn("k", F.col("element_id") % 100_000)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    order, k = F.floor(F.col("element_id") / 100_000), F.col("k")
    parent = F.concat(F.lit("/"), (k - k % 4).cast("string"))
    return e.select(
        "frame_id", "element_id", (k + 1).alias("place"), (F.col("x") - F.col("fx")).alias("x"), "y", (F.col("w") / F.when(k % 3 == 0, 2).otherwise(1)).alias("w"), "h",
        pick(["Toolbar", "Bottom Navigation", "Icon", "Image", "Text"], order * 7 + k * 3).alias("label"), pick(["add", "edit", "menu"], order + k).alias("icon"), F.when(k % 4 == 0, parent).otherwise(F.concat(parent, F.lit("/"), k.cast("string"))).alias("path"),
    )


@query(f"""WITH {HIERARCHY}, s AS (SELECT *, CASE WHEN label = 'Toolbar' AND y < 114 THEN 'appbar' WHEN label = 'Bottom Navigation' THEN 'bottomnav'
WHEN label IN ('Icon', 'Image') AND icon IN ('add', 'edit') AND x + w / 2 > 252 AND y + h / 2 > 570 AND w < 72 THEN 'fab' END AS own FROM h),
f AS (SELECT *, CASE WHEN own IS NOT NULL AND row_number() OVER (PARTITION BY frame_id, own ORDER BY place) = 1 THEN own END AS s FROM s),
b AS (SELECT frame_id, s AS slot, path AS bar FROM f WHERE s IN ('appbar', 'bottomnav'))
SELECT element_id, coalesce(s, (SELECT min(b.slot) FROM b WHERE b.frame_id = f.frame_id AND starts_with(f.path, b.bar || '/')), 'body') AS slot FROM f""", "elements_gold")
def tre_extract_slots(spark, sf):
    return L.extract_slots(_hierarchy(spark, sf), "frame_id", 760.0, 360.0).select("element_id", "slot")


@query("SELECT element_id, place::INT AS place FROM (SELECT element_id, row_number() OVER (PARTITION BY frame_id ORDER BY element_id) AS place, frame_id % 2 = 0 AS is_row FROM elements_gold) WHERE place <= CASE WHEN is_row THEN 5 ELSE 40 END", "elements_gold")
def prj_sanitize_tree(spark, sf):
    e = S.elements_gold(spark, sf).withColumns({"parent": F.col("frame_id"), "depth": F.lit(2), "parent_type": F.when(F.col("frame_id") % 2 == 0, "row").otherwise("col")})
    return L.sanitize_children(e, "sketch_id", "parent", "element_id").select("element_id", "place")


@query("SELECT sketch_id, row_number() OVER (PARTITION BY sketch_id ORDER BY element_id, no)::INT AS step, element_id, part FROM elements_gold JOIN (VALUES ('btn', 1, 'outline'), ('btn', 2, 'label'), ('text', 1, 'words'), ('img', 1, 'box'), ('img', 2, 'cross')) p(type, no, part) USING (type)", "elements_gold")
def tre_plan_steps(spark, sf):
    parts = spark.createDataFrame([("btn", 1, "outline"), ("btn", 2, "label"), ("text", 1, "words"), ("img", 1, "box"), ("img", 2, "cross")], "type string, part_no int, part string")
    return L.plan_steps(S.elements_gold(spark, sf), parts, "sketch_id", ["element_id"])


def _affinity(spark, sf):
    """All pairs of a sketch's strokes: over one half within three classes, under one half between them."""
    ids = S.points(spark, sf).select("sketch_id", F.col("stroke_id").alias("i")).distinct()
    noise = 0.3 * uniform("link", F.col("sketch_id"), F.col("i"), F.col("j"))
    pairs = ids.join(ids.select("sketch_id", F.col("i").alias("j")).hint("merge"), "sketch_id").filter("i < j")
    return pairs.withColumn("p", F.when(F.col("i") % 3 == F.col("j") % 3, 0.6 + noise).otherwise(0.1 + noise))


def _drawn(ids, seed: str, kinds: list[str]):
    return ids.withColumn("type", F.explode(F.array(*map(F.lit, kinds)))).withColumn("p", uniform(seed, F.col("sketch_id"), F.col("i"), F.col("type")))


CLUSTERS = """s AS (SELECT sketch_id, stroke_id, min(x) AS x, min(y) AS y, max(x) AS x1, max(y) AS y1, count(*) AS n FROM points GROUP BY ALL), o AS (SELECT *, min(stroke_id) OVER (PARTITION BY sketch_id, stroke_id % 3) AS cluster FROM s)"""


@query(f"WITH {CLUSTERS} SELECT sketch_id, stroke_id AS i, cluster FROM o WHERE sketch_id IN (SELECT sketch_id FROM s GROUP BY 1 HAVING count(*) > 1)", "points")
def tre_group_strokes(spark, sf):
    from annomill.operators.trees import average_linkage

    return average_linkage(_affinity(spark, sf), "sketch_id")


def _tenth(v: str) -> str:
    """A length to a tenth, halves up, of its decimal value; binary rounding would go either way at halves."""
    return f"round(({v})::DECIMAL(18, 6), 1)::DOUBLE"


def pooled_sql(name: str, seed: str, kinds: list[str]) -> str:
    """The kind with the largest sum of draws of each cluster, and the mean of its strokes' largest draws."""
    u = f"('0x' || substr(sha1('{seed}:' || sketch_id || ':' || stroke_id || ':' || t), 1, 8))::BIGINT / 4294967296"
    return f"""{name}_p AS (SELECT sketch_id, cluster, stroke_id, t, {u} AS p FROM o, (SELECT unnest({kinds}) AS t)), {name}_s AS (SELECT sketch_id, cluster, t, sum(p) AS p FROM {name}_p GROUP BY ALL),
{name} AS (SELECT sketch_id, cluster, t, (SELECT avg(m) FROM (SELECT max(p) AS m FROM {name}_p q WHERE q.sketch_id = {name}_s.sketch_id AND q.cluster = {name}_s.cluster GROUP BY stroke_id)) AS score FROM {name}_s QUALIFY row_number() OVER (PARTITION BY sketch_id, cluster ORDER BY p DESC, t) = 1)"""


@query(f"""WITH {CLUSTERS}, {pooled_sql('c', 'class', ['arrow', 'frame', 'shape', 'text'])}, {pooled_sql('k', 'kind', ['btn', 'none', 'text'])},
x AS (SELECT sketch_id, cluster, {_tenth('min(x)')} AS x, {_tenth('min(y)')} AS y, {_tenth('max(x1) - min(x)')} AS w, {_tenth('max(y1) - min(y)')} AS h FROM o GROUP BY ALL),
d AS (SELECT x.*, CASE WHEN c.t IN ('frame', 'arrow') THEN c.t ELSE 'element' END AS kind, k.t AS type, k.score FROM x JOIN c USING (sketch_id, cluster) JOIN k USING (sketch_id, cluster)),
e AS (SELECT * FROM d WHERE kind = 'element' AND type <> 'none'), f0 AS (SELECT sketch_id, cluster, x, y, w, h FROM d WHERE kind = 'frame' UNION ALL
SELECT sketch_id, NULL, {_tenth('min(x)')}, {_tenth('min(y)')}, {_tenth('max(x + w) - min(x)')}, {_tenth('max(y + h) - min(y)')} FROM e WHERE sketch_id NOT IN (SELECT sketch_id FROM d WHERE kind = 'frame') GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY sketch_id ORDER BY cluster) - 1 AS ord FROM f0),
n AS (SELECT e.sketch_id, e.cluster, min(ord) AS frame FROM e JOIN f ON f.sketch_id = e.sketch_id AND e.x + e.w / 2 BETWEEN f.x AND f.x + f.w AND e.y + e.h / 2 BETWEEN f.y AND f.y + f.h GROUP BY ALL),
p AS (SELECT p.sketch_id, o.cluster, p.stroke_id, p.seq, p.x, p.y, p.seq IN (1, o.n) AS is_end, row_number() OVER (PARTITION BY p.sketch_id, o.cluster ORDER BY p.stroke_id, p.seq) AS at FROM points p JOIN o ON o.sketch_id = p.sketch_id AND o.stroke_id = p.stroke_id JOIN d ON d.sketch_id = p.sketch_id AND d.cluster = o.cluster AND d.kind = 'arrow'),
far AS (SELECT a.sketch_id, a.cluster, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM p a JOIN p b ON a.sketch_id = b.sketch_id AND a.cluster = b.cluster AND a.at < b.at QUALIFY row_number() OVER (PARTITION BY a.sketch_id, a.cluster ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 DESC, a.at, b.at) = 1),
v AS (SELECT far.*, count(*) FILTER (sqrt((p.x - ax) ** 2 + (p.y - ay) ** 2) < 0.2 * sqrt(d2)) > count(*) FILTER (sqrt((p.x - bx) ** 2 + (p.y - b_y) ** 2) < 0.2 * sqrt(d2)) AS swap FROM far LEFT JOIN p ON p.sketch_id = far.sketch_id AND p.cluster = far.cluster AND p.is_end GROUP BY ALL)
SELECT sketch_id, 'element' AS kind, cluster, type, frame::INT AS frame, round(score, 6) AS score, x, y, w, h, NULL::DOUBLE AS tx, NULL::DOUBLE AS ty, NULL::DOUBLE AS hx, NULL::DOUBLE AS hy FROM e LEFT JOIN n USING (sketch_id, cluster)
UNION ALL SELECT sketch_id, 'arrow', cluster, NULL, NULL, NULL, x, y, w, h, CASE WHEN swap THEN bx ELSE ax END, CASE WHEN swap THEN b_y ELSE ay END, CASE WHEN swap THEN ax ELSE bx END, CASE WHEN swap THEN ay ELSE b_y END FROM d LEFT JOIN v USING (sketch_id, cluster) WHERE kind = 'arrow'
UNION ALL SELECT sketch_id, 'frame', cluster, NULL, ord::INT, NULL, x, y, w, h, NULL, NULL, NULL, NULL FROM f""", "points")
def tre_decode_elements(spark, sf):
    p = S.points(spark, sf).withColumnRenamed("stroke_id", "i")
    p = p.withColumn("is_end", (F.col("seq") == 1) | (F.col("seq") == F.count("*").over(Window.partitionBy("sketch_id", "i"))))
    strokes = p.groupBy("sketch_id", "i").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    ids = strokes.select("sketch_id", "i")
    found = L.decode_sketch(strokes, p.select("sketch_id", "i", "seq", "x", "y", "is_end"), _affinity(spark, sf), _drawn(ids, "class", ["arrow", "frame", "shape", "text"]), _drawn(ids, "kind", ["btn", "none", "text"]), "sketch_id")
    return found.withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT a.sketch_id, a.stroke_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM points a JOIN points b ON a.sketch_id = b.sketch_id AND a.stroke_id = b.stroke_id AND a.seq < b.seq
QUALIFY row_number() OVER (PARTITION BY a.sketch_id, a.stroke_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 DESC, a.seq, b.seq) = 1),
v AS (SELECT d.*, count(*) FILTER (sqrt((p.x - ax) ** 2 + (p.y - ay) ** 2) < 0.2 * sqrt(d2)) > count(*) FILTER (sqrt((p.x - bx) ** 2 + (p.y - b_y) ** 2) < 0.2 * sqrt(d2)) AS swap FROM d LEFT JOIN points p ON p.sketch_id = d.sketch_id AND p.stroke_id = d.stroke_id AND p.seq % 2 = 1 GROUP BY ALL)
SELECT sketch_id, stroke_id, CASE WHEN swap THEN bx ELSE ax END AS tx, CASE WHEN swap THEN b_y ELSE ay END AS ty, CASE WHEN swap THEN ax ELSE bx END AS hx, CASE WHEN swap THEN ay ELSE b_y END AS hy FROM v""", "points")
def ag_arrow_ends(spark, sf):
    p = S.points(spark, sf).withColumn("is_end", F.col("seq") % 2 == 1)
    return L.arrow_ends(p.select("sketch_id", "stroke_id", "seq", "x", "y", "is_end"), ["sketch_id", "stroke_id"], "seq")


@query(f"""WITH RECURSIVE {xy_sql('frame_id', 1)}, c AS (SELECT e.sketch_id, e.frame_id, regexp_extract(path, '^(y[0-9]+)?', 0) AS row, place, '{{"t":"' || type || '"' || CASE WHEN text IS NULL THEN '' ELSE ',"v":"' || text || '"' END || '}}' AS n FROM elements_gold e JOIN cut USING (frame_id, element_id)),
r AS (SELECT sketch_id, frame_id, row, CASE WHEN count(*) = 1 THEN any_value(n) ELSE '{{"t":"row","c":[' || string_agg(n, ',' ORDER BY place) || ']}}' END AS n FROM c GROUP BY ALL)
SELECT sketch_id, frame_id, '{{"t":"col","c":[' || string_agg(n, ',' ORDER BY row) || ']}}' AS spec FROM r GROUP BY ALL""", "elements_gold")
def tre_build_layout(spark, sf):
    return L.build_layout(S.elements_gold(spark, sf), "sketch_id", "frame_id")


#: What stands for types whose place in a document depends on others.
PLAIN = {"appbar": "heading", "bottomnav": "text", "fab": "btn", "radio": "check", "menu": "icon"}
BUILT = f"""WITH e AS (SELECT sketch_id, frame_id, element_id, (y / 100)::INT AS r, x, h, text, CASE {" ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in PLAIN.items())} ELSE type END AS type, CASE WHEN type = 'menu' THEN 'menu' ELSE 'circle' END AS icon FROM elements_gold),
n AS (SELECT * REPLACE (CASE WHEN type <> 'heading' THEN text END AS text), CASE type WHEN 'btn' THEN '{{"t":"btn","label":"' || coalesce(text, 'Button') || '"}}' WHEN 'input' THEN '{{"t":"input","label":"' || coalesce(text, 'Input') || CASE WHEN regexp_matches(coalesce(text, ''), 'pass|pin|secret|otp', 'i') THEN '","secure":true}}' WHEN h > 54 THEN '","multiline":true}}' ELSE '"}}' END
WHEN 'text' THEN '{{"t":"text","v":"' || coalesce(text, 'Text') || '"}}' WHEN 'heading' THEN '{{"t":"text","v":"' || 'Heading' || '","s":"' || CASE WHEN h > 36 THEN 'h1' ELSE 'h2' END || '"}}' WHEN 'para' THEN '{{"t":"para","lines":2}}' WHEN 'img' THEN '{{"t":"img","h":' || floor(100 * h / 760 + 0.5)::INT || '}}'
WHEN 'icon' THEN '{{"t":"icon","name":"circle"}}' WHEN 'avatar' THEN '{{"t":"avatar"}}' WHEN 'check' THEN '{{"t":"check","label":"' || coalesce(text, 'Option') || '"}}' WHEN 'switch' THEN '{{"t":"switch","label":"' || coalesce(text, 'Setting') || '"}}' WHEN 'divider' THEN '{{"t":"divider"}}' WHEN 'card' THEN '{{"t":"card","c":[{{"t":"spacer"}}]}}' END AS js,
CASE type WHEN 'text' THEN 'text:body' WHEN 'heading' THEN 'text:' || CASE WHEN h > 36 THEN 'h1' ELSE 'h2' END WHEN 'card' THEN 'card(spacer())' ELSE type END AS sig FROM e),
rows AS (SELECT sketch_id, frame_id, r, count(js) AS k, count(*) FILTER (type = 'listmark') AS marks, count(*) FILTER (type = 'card') AS cards, string_agg(js, ',' ORDER BY x, element_id) AS js, string_agg(sig, ',' ORDER BY x, element_id) FILTER (js IS NOT NULL) AS sig FROM n GROUP BY ALL HAVING count(js) > 0),
made AS (SELECT sketch_id, frame_id, r, CASE WHEN marks > 0 THEN 'list' WHEN k = 1 THEN CASE WHEN cards = 1 THEN 'card' ELSE 'leaf' END WHEN cards = 2 THEN 'grid' ELSE 'row' END AS kind, CASE WHEN marks > 0 THEN '{{"t":"list","n":3,"item":' || js || '}}' WHEN k = 1 THEN js WHEN cards = 2 THEN js ELSE '{{"t":"row","c":[' || js || ']}}' END AS js,
CASE WHEN marks > 0 THEN 'list(' || sig || ')' WHEN k = 1 THEN sig WHEN cards = 2 THEN 'grid' ELSE 'row(' || sig || ')' END AS sig FROM rows),
runs AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY r) AS run FROM (SELECT *, CASE WHEN kind IN ('card', 'row', 'grid') AND sig = lag(sig) OVER (PARTITION BY frame_id ORDER BY r) THEN 0 ELSE 1 END AS new FROM made)),
nodes AS (SELECT sketch_id, frame_id, run, CASE WHEN any_value(kind) = 'grid' THEN '{{"t":"grid","cols":2,"n":' || 2 * count(*) || ',"item":{{"t":"card","c":[{{"t":"spacer"}}]}}}}' WHEN count(*) > 1 THEN '{{"t":"list","n":' || count(*) || ',"item":' || arg_min(js, r) || '}}' ELSE any_value(js) END AS js, count(*) > 1 OR any_value(kind) IN ('grid', 'list') AS whole FROM runs GROUP BY ALL),
body AS (SELECT sketch_id, frame_id, CASE WHEN count(*) = 1 AND any_value(whole) THEN any_value(js) ELSE '{{"t":"col","c":[' || string_agg(js, ',' ORDER BY run) || ']}}' END AS body FROM nodes GROUP BY ALL),
s AS (SELECT f.sketch_id, f.ord, '{{"id":"screen_' || (f.ord + 1) || '","title":"Screen ' || (f.ord + 1) || '","body":' || coalesce(body, '{{"t":"col","c":[{{"t":"spacer"}}]}}') || '}}' AS s FROM frames f LEFT JOIN body USING (sketch_id, frame_id))
SELECT sketch_id, '{{"v":1,"screens":[' || string_agg(s, ',' ORDER BY ord) || ']}}' AS spec FROM s GROUP BY 1"""


@query(BUILT, "frames", "elements_gold")
def tre_build_spec(spark, sf):
    """Whole documents of sketches; headings have no text here, so screens have no names of their own."""
    from annomill.operators.layout_builder import build_spec

    swap = F.create_map(*(F.lit(x) for p in PLAIN.items() for x in p))
    e = S.elements_gold(spark, sf).withColumn("type", F.coalesce(F.try_element_at(swap, F.col("type")), F.col("type")))
    e = e.withColumns({"frame": F.col("frame_id"), "n": F.lit(2), "text": F.when(F.col("type") != "heading", F.col("text"))})
    frames = _frames(spark, sf).withColumnRenamed("frame_id", "frame")
    return build_spec(e, frames, _arrows(spark, sf).filter(F.lit(False)), "sketch_id")


@query(f"""WITH RECURSIVE t AS (SELECT frame_id, list(DISTINCT type) AS kinds, count(*) AS leaves FROM elements_gold GROUP BY 1), {diverse_sql('SELECT frame_id, kinds FROM t WHERE leaves BETWEEN 4 AND 10', 'task', 20)}
SELECT 'example' AS source, frame_id FROM t JOIN orders ON o_orderkey = frame_id WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'sampled', frame_id FROM picked""", "elements_gold")
def tre_build_task_set(spark, sf):
    """Urgent orders' frames are the examples."""
    docs = S.elements_gold(spark, sf).groupBy("frame_id").agg(F.collect_set("type").alias("kinds"), F.count("*").alias("leaves"))
    urgent = S.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("frame_id"))
    return L.task_set(docs, "frame_id", docs.join(urgent, "frame_id", "left_semi"), k=20, seed="task")


CORNERS = """c0 AS (SELECT sketch_id, stroke_id, 1 AS i, max(seq) AS j, {tolerance} AS tol FROM {points} GROUP BY ALL),
seg AS (SELECT * FROM c0 UNION ALL SELECT sketch_id, stroke_id, unnest([i, m.k]), unnest([m.k, j]), tol FROM (SELECT s.sketch_id, s.stroke_id, s.i, s.j, s.tol,
max({{'d': abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)) / greatest(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 1e-12), 'n': -p.seq, 'k': p.seq}}) AS m FROM seg s JOIN {points} a ON a.sketch_id = s.sketch_id AND a.stroke_id = s.stroke_id AND a.seq = s.i
JOIN {points} b ON b.sketch_id = s.sketch_id AND b.stroke_id = s.stroke_id AND b.seq = s.j JOIN {points} p ON p.sketch_id = s.sketch_id AND p.stroke_id = s.stroke_id AND p.seq > s.i AND p.seq < s.j GROUP BY ALL) WHERE m.d > tol)"""


@query(f"WITH RECURSIVE {CORNERS.format(points='points', tolerance='10.0')} SELECT sketch_id, stroke_id, ((count(*) - 1) // 2)::INT AS corners FROM seg GROUP BY ALL", "points")
def fn_polyline_corners(spark, sf):
    return L.polyline_corners(S.points(spark, sf), ["sketch_id", "stroke_id"], "seq", 10.0)


@query("""WITH p AS (SELECT *, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prompt FROM conversations)
SELECT conv_id, turn, sha256(prompt) AS prompt_sha256, sha256(text) AS completion_sha256, len(regexp_extract_all(prompt, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))::INT AS n_tokens FROM p WHERE role = 'assistant'""")
def smp_chat_pairs(spark, sf):
    """Prompt and completion of each assistant turn: the turns before it, and itself."""
    c = S.table(spark, sf, "conversations")
    before = F.collect_list(F.concat_ws(": ", "role", "text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    pairs = c.withColumn("prompt", F.array_join(before, "\n")).filter("role = 'assistant'")
    return pairs.select("conv_id", "turn", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("text", 256).alias("completion_sha256"), token_count(F.col("prompt")).alias("n_tokens"))


@query("""WITH c AS (SELECT frame_id, count(*) AS n, count(*) FILTER (type IN ('text', 'btn', 'input', 'img', 'icon', 'check', 'switch')) AS typed FROM elements_gold GROUP BY 1)
SELECT frame_id, n AS leaves, CASE WHEN frame_id % 10 = 0 THEN 'not_portrait' WHEN n < 3 THEN 'too_few' ELSE 'ok' END AS reason, frame_id % 10 <> 0 AND n >= 3 AND typed > 0 AS has_spec FROM c""", "elements_gold")
def tre_convert_documents(spark, sf):
    """Hierarchies made of each frame's elements, converted with a reason for each rejected one."""
    e = S.elements_gold(spark, sf)
    label = F.create_map(*(F.lit(x) for p in (("text", "Text"), ("btn", "Text Button"), ("input", "Input"), ("img", "Image"), ("icon", "Icon"), ("check", "Checkbox"), ("switch", "On/Off Switch")) for x in p))
    x = F.col("x") - F.col("fx")
    kid = F.struct("element_id", F.struct(F.coalesce(F.try_element_at(label, F.col("type")), F.lit("Other")).alias("componentLabel"), F.array(x, F.col("y"), x + F.col("w"), F.col("y") + F.col("h")).alias("bounds"), "text").alias("n"))
    docs = e.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(kid)), lambda k: k["n"]).alias("children"))
    root = F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(360.0), F.when(F.col("frame_id") % 10 == 0, 300.0).otherwise(760.0)).alias("bounds"), "children")
    found = L.convert_documents(docs.select("frame_id", F.to_json(root).alias("text")), "frame_id", "text")
    return found.select("frame_id", "leaves", "reason", F.col("spec").isNotNull().alias("has_spec"))


LABELS = {"text": "Text", "heading": "Text", "btn": "Text Button", "input": "Input", "img": "Image", "icon": "Icon", "check": "Checkbox", "switch": "On/Off Switch"}
WHOLE = f"""WITH e AS (SELECT frame_id, element_id, (y / 100)::INT AS r, x, h, type, coalesce(nullif(split_part(text, ' ', 1), ''), '') AS text, CASE {" ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE 'Slider' END AS label FROM elements_gold),
m AS (SELECT frame_id, quantile_cont(h, 0.5) AS med FROM (SELECT frame_id, h FROM e WHERE label = 'Text' AND text <> '' UNION ALL SELECT frame_id, 30 FROM frames) GROUP BY 1),
t AS (SELECT e.*, CASE WHEN h / med >= 1.8 THEN 'h1' WHEN h / med >= 1.35 THEN 'h2' WHEN h / med <= 0.75 THEN 'caption' END AS style FROM e JOIN m USING (frame_id)),
n AS (SELECT *, CASE label WHEN 'Text' THEN CASE WHEN text <> '' THEN '{{"t":"text","v":"' || text || '"' || coalesce(',"s":"' || style || '"', '') || '}}' END WHEN 'Text Button' THEN CASE WHEN text <> '' THEN '{{"t":"btn","label":"' || text || '"}}' END
WHEN 'Input' THEN '{{"t":"input","label":"' || CASE WHEN text <> '' THEN text ELSE 'Email' END || '"}}' WHEN 'Image' THEN '{{"t":"img","h":' || round_even(100 * h / 760, 0)::INT || '}}' WHEN 'Icon' THEN '{{"t":"icon","name":"bell"}}'
WHEN 'Checkbox' THEN '{{"t":"check","label":"' || CASE WHEN text <> '' THEN text ELSE 'Option' END || '"}}' WHEN 'On/Off Switch' THEN '{{"t":"switch","label":"' || CASE WHEN text <> '' THEN text ELSE 'Setting' END || '"}}' END AS js,
CASE label WHEN 'Text' THEN 'text' || coalesce(style, 'body') || '()' WHEN 'Text Button' THEN 'btn()' WHEN 'Input' THEN 'input()' WHEN 'Image' THEN 'img()' WHEN 'Icon' THEN 'icon()' WHEN 'Checkbox' THEN 'check()' ELSE 'switch()' END AS sig FROM t),
rows AS (SELECT frame_id, r, count(*) AS k, count(*) FILTER (label = 'Text') AS texts, max(label) FILTER (label IN ('Checkbox', 'On/Off Switch')) AS control, max(text) FILTER (label = 'Text') AS said, string_agg(js, ',' ORDER BY x) AS js, string_agg(sig, ',' ORDER BY x) AS sig FROM n WHERE js IS NOT NULL GROUP BY ALL),
w AS (SELECT frame_id, r, k = 2 AND NOT (texts = 1 AND control IS NOT NULL) AS is_row, CASE WHEN k = 1 THEN js WHEN texts = 1 AND control IS NOT NULL THEN '{{"t":"' || CASE control WHEN 'Checkbox' THEN 'check' ELSE 'switch' END || '","label":"' || said || '"}}' ELSE '{{"t":"row","c":[' || js || ']}}' END AS js, CASE WHEN k = 1 THEN sig WHEN texts = 1 AND control IS NOT NULL THEN 'control' ELSE 'row(' || sig || ')' END AS sig, CASE WHEN k = 1 OR (texts = 1 AND control IS NOT NULL) THEN 1 ELSE 2 END AS leaves FROM rows),
u AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY r) AS run FROM (SELECT *, CASE WHEN is_row AND sig = lag(sig) OVER (PARTITION BY frame_id ORDER BY r) THEN 0 ELSE 1 END AS new FROM w)),
d AS (SELECT frame_id, run, count(*) > 1 AS listed, CASE WHEN count(*) > 1 THEN '{{"t":"list","n":' || count(*) || ',"item":' || arg_min(js, r) || '}}' ELSE any_value(js) END AS js, any_value(leaves) AS leaves FROM u GROUP BY ALL),
b AS (SELECT frame_id, CASE WHEN count(*) = 1 AND any_value(listed) THEN any_value(js) ELSE '{{"t":"col","c":[' || string_agg(js, ',' ORDER BY run) || ']}}' END AS body, sum(leaves) AS leaves FROM d GROUP BY 1),
o AS (SELECT frame_id, body, CASE WHEN frame_id % 10 = 0 THEN 'not_portrait' WHEN frame_id % 10 = 1 THEN 'overlay' WHEN body IS NULL THEN 'empty_body' WHEN leaves + 1 < 3 THEN 'too_few' ELSE 'ok' END AS reason, leaves FROM frames LEFT JOIN b USING (frame_id))
SELECT frame_id, reason, CASE WHEN reason = 'ok' THEN '{{"v":1,"screens":[{{"id":"screen","title":"Order ' || frame_id % 97 || '","appbar":{{"t":"appbar","title":"Order ' || frame_id % 97 || '","icons":[{{"t":"icon","name":"search"}}]}},"body":' || body || '}}]}}' END AS spec FROM o"""


@query(WHOLE, "frames", "elements_gold")
def tre_convert_whole(spark, sf):
    """Hierarchies with a toolbar and wrappers around each three elements; some are wide, some have a drawer."""
    from annomill.operators.hierarchies import convert

    e = S.elements_gold(spark, sf)
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in LABELS.items() for x in p)), F.col("type")), F.lit("Slider"))
    box = lambda *v: F.array(*(c.cast("int") if not isinstance(c, int) else F.lit(c) for c in v))
    x = F.col("x") - F.col("fx")
    part = F.struct(label.alias("componentLabel"), box(x, F.col("y"), x + F.col("w"), F.col("y") + F.col("h")).alias("bounds"), F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)).alias("text"), F.lit("notifications").alias("iconClass"), F.lit("android.widget.Button").alias("class"), F.lit("com.x:id/edit_text_email").alias("resource-id"))
    wraps = e.groupBy("frame_id", F.floor(F.col("element_id") % 100_000 / 3).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("element_id", part.alias("n")))), lambda k: k["n"]).alias("children"))
    held = wraps.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "children"))), lambda k: F.struct(k["children"].alias("children"))).alias("wraps"))
    docs = S.frames(spark, sf).select("frame_id").join(held.hint("merge"), "frame_id", "left")
    bar = F.concat(F.lit('{"componentLabel":"Toolbar","bounds":[0,0,360,5],"children":[{"componentLabel":"Text","bounds":[40,0,200,30],"text":"Order '), (F.col("frame_id") % 97).cast("string"), F.lit('"},{"componentLabel":"Icon","bounds":[300,0,330,5],"iconClass":"search"}]}'))
    drawer = F.when(F.col("frame_id") % 10 == 1, ',{"componentLabel":"Drawer","bounds":[0,0,100,760]}').otherwise("")
    rest = F.coalesce(F.to_json("wraps"), F.lit("[]"))
    root = F.concat(F.lit('{"bounds":[0,0,360,'), F.when(F.col("frame_id") % 10 == 0, "300").otherwise("760"), F.lit('],"children":['), bar, drawer, F.when(F.length(rest) > 2, F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest) - 2))).otherwise(""), F.lit("]}"))
    return convert(docs.select("frame_id", root.alias("text")), "frame_id", "text").select("frame_id", "reason", "spec")


@query("""WITH e AS (SELECT sketch_id, frame_id, element_id, CASE WHEN element_id % 3 <> 0 THEN 'card' ELSE type END AS type, text FROM elements_gold),
m AS (SELECT sketch_id, frame_id, max(type) FILTER (type IN ('switch', 'check')) AS control, max(text) FILTER (type = 'text') AS label FROM e GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (type = 'text') = 1 AND count(*) FILTER (type IN ('switch', 'check')) = 1),
p AS (SELECT *, CASE WHEN type IN ('card', 'row', 'col') THEN type ELSE type || '#' || element_id END AS sig FROM e WHERE (sketch_id, frame_id) NOT IN (SELECT sketch_id, frame_id FROM m)),
n AS (SELECT *, CASE WHEN lag(sig) OVER (PARTITION BY sketch_id, frame_id ORDER BY element_id) IS NOT DISTINCT FROM sig THEN 0 ELSE 1 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY sketch_id, frame_id ORDER BY element_id) AS island FROM n)
SELECT sketch_id, frame_id, island::INT AS place, CASE WHEN count(*) > 1 THEN 'list' ELSE split_part(any_value(sig), '#', 1) END AS type, least(count(*), 50)::INT AS n, NULL::VARCHAR AS label FROM i GROUP BY sketch_id, frame_id, island
UNION ALL SELECT sketch_id, frame_id, 1, control, 1, label FROM m""", "elements_gold")
def tre_finalize(spark, sf):
    e = S.elements_gold(spark, sf).withColumn("type", F.when(F.col("element_id") % 3 != 0, "card").otherwise(F.col("type")))
    return L.finalize_children(e, "sketch_id", "frame_id", "element_id")


@query("""WITH l AS (SELECT frame_id, k // 4 AS g, k, ['card', 'text', 'switch', 'card'][((frame_id + k) % 4 + 1)::INT] AS t FROM (SELECT *, element_id % 100000 AS k FROM elements_gold)),
j AS (SELECT *, ['row', 'card', 'row'][(g % 3 + 1)::INT] AS p, '{"t":"' || t || '","label":"n' || k || '"}' AS js FROM l),
n AS (SELECT frame_id, g, any_value(p) AS p, count(*) AS n, list(t ORDER BY k) AS ts, list(js ORDER BY k) AS js, max('n' || k) FILTER (t = 'text') AS label, max(t) FILTER (t = 'switch') AS control, count(*) FILTER (t = 'text') AS texts FROM j GROUP BY frame_id, g),
m AS (SELECT frame_id, g, CASE WHEN p = 'card' THEN 'card(' || array_to_string(s.sigs, ',') || ')' WHEN n = 1 THEN ts[1] WHEN n = 2 AND texts = 1 AND control IS NOT NULL THEN control WHEN n <= 4 AND len([x FOR x IN ts IF x <> 'card']) = 0 THEN 'grid(card)' ELSE 'row(' || array_to_string(ts, ',') || ')' END AS sig,
CASE WHEN p = 'card' THEN '{"t":"card","c":[' || array_to_string(s.parts, ',') || ']}' WHEN n = 1 THEN js[1] WHEN n = 2 AND texts = 1 AND control IS NOT NULL THEN '{"t":"' || control || '","label":"' || label || '"}' WHEN n <= 4 AND len([x FOR x IN ts IF x <> 'card']) = 0 THEN '{"t":"grid","cols":' || n || ',"n":' || n || ',"item":' || js[1] || '}' ELSE '{"t":"row","c":[' || array_to_string(js, ',') || ']}' END AS js
FROM n JOIN (SELECT frame_id, g, list(CASE WHEN c = 1 THEN sig ELSE 'list(' || sig || ')' END ORDER BY i) AS sigs, list(CASE WHEN c = 1 THEN first ELSE '{"t":"list","n":' || c || ',"item":' || first || '}' END ORDER BY i) AS parts FROM
(SELECT frame_id, g, i, any_value(t) AS sig, count(*) AS c, arg_min(js, k) AS first FROM (SELECT *, sum(new) OVER (PARTITION BY frame_id, g ORDER BY k) AS i FROM (SELECT *, CASE WHEN t = 'card' AND lag(t) OVER (PARTITION BY frame_id, g ORDER BY k) = 'card' THEN 0 ELSE 1 END AS new FROM j)) GROUP BY frame_id, g, i) GROUP BY ALL) s USING (frame_id, g)),
r AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY g) AS i FROM (SELECT *, CASE WHEN split_part(sig, '(', 1) IN ('card', 'row') AND sig = lag(sig) OVER (PARTITION BY frame_id ORDER BY g) THEN 0 ELSE 1 END AS new FROM m)),
z AS (SELECT frame_id, i, count(*) AS c, arg_min(js, g) AS js FROM r GROUP BY ALL) SELECT frame_id, '{"t":"col","c":[' || string_agg(CASE WHEN c = 1 THEN js ELSE '{"t":"list","n":' || c || ',"item":' || js || '}' END, ',' ORDER BY i) || ']}' AS json FROM z GROUP BY 1""", "elements_gold")
def tre_finalize_tree(spark, sf):
    """Each four elements of a frame are a row or a card; these stand in a column."""
    e = S.elements_gold(spark, sf).select("frame_id", (F.col("element_id") % 100_000).alias("k")).withColumn("g", F.floor(F.col("k") / 4))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    none, up = F.lit(None).cast("string"), F.concat(F.lit("/"), F.col("g").cast("string"))
    label = F.concat(F.lit("n"), F.col("k").cast("string"))
    leaves = e.withColumn("t", pick(["card", "text", "switch", "card"], F.col("frame_id") + F.col("k"))).select("frame_id", F.concat(up, F.lit("/"), F.col("k").cast("string")).alias("path"), up.alias("parent"), F.col("k").alias("ord"), F.lit(2).alias("depth"), F.col("t").alias("type"), label.alias("label"), F.to_json(F.struct("t", label.alias("label"))).alias("leaf"))
    groups = e.select("frame_id", "g").distinct().select("frame_id", up.alias("path"), F.lit("").alias("parent"), F.col("g").alias("ord"), F.lit(1).alias("depth"), pick(["row", "card", "row"], F.col("g")).alias("type"), none.alias("label"), none.alias("leaf"))
    roots = e.select("frame_id").distinct().select("frame_id", F.lit("").alias("path"), none.alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("depth"), F.lit("col").alias("type"), none.alias("label"), none.alias("leaf"))
    return L.finalize_tree(leaves.unionByName(groups).unionByName(roots), "frame_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 2 ELSE 2 END AS attempt, event_id % 2 = 0 OR event_id % 3 = 0 AS settled FROM events")
def udf_retry_policy(spark, sf):
    by = lambda k: lambda df, v: df.withColumn("output", F.when(F.col(v) % k == 0, F.concat(F.lit(f"by {k}: "), F.col(v).cast("string"))))
    found = L.retry(S.table(spark, sf, "events").select("event_id"), [by(2), by(3)], "event_id", F.col("output").isNotNull())
    return found.select("event_id", "attempt", F.col("output").isNotNull().alias("settled"))


@query("SELECT frame_id, count(*) + 1 AS nodes FROM elements_gold GROUP BY 1", "elements_gold")
def udf_flatten_tree(spark, sf):
    from .tree_queries import _spec

    L.flatten_udtf(spark)
    specs = S.elements_gold(spark, sf).groupBy("frame_id").agg(_spec().alias("text"))
    return spark.sql("SELECT frame_id, count(*) AS nodes FROM {specs}, LATERAL flatten_tree(text) GROUP BY frame_id", specs=specs)
