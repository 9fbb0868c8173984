"""Operators against small literal cases and brute force."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from annomill.functions import numeric as N
from annomill.functions import text as T
from annomill.operators import aggregates as A
from annomill.operators import features as X
from annomill.operators import joins as J
from annomill.operators import layouts as L
from annomill.operators import records as R
from annomill.operators import sampling as P
from annomill.operators import trees
from annomill.operators import windows as W
from annomill.sources import readers, writers

RNG = np.random.default_rng(5)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rid", "label"),
    [("et_new_login_password", "Login password"), ("userNameField", "User name"), ("edit_text_1", ""), ("card-number", "Card number"), ("", "")],
)
def test_label_from_id(spark, rid, label):
    assert one(spark, T.label_from_id(F.lit(rid))) == label


@pytest.mark.parametrize(("text", "short"), [("abc", "abc"), ("one two three four", "one two"), ("unbreakableword", "unbreakabl"), ("a bcdefghijklm", "a")])
def test_short_words(spark, text, short):
    assert one(spark, T.short_words(F.lit(text), 10)) == short


def test_text_functions(spark):
    assert one(spark, T.clean_text(F.lit(" a\x01b \n c "))) == "a b c"
    assert one(spark, T.is_latin(F.lit("café “ok” €"))) and not one(spark, T.is_latin(F.lit("漢"))) and one(spark, T.is_latin(F.lit("")))
    assert one(spark, T.slug(F.lit("1st Page!"))) == "s_1st_page" and one(spark, T.slug(F.lit("?!"))) == ""
    assert [one(spark, T.list_mark(F.lit(s))) for s in ("x5", " X 99 ", "*0", "x123", "y2")] == [5, 50, 1, None, None]
    assert one(spark, T.prompt_text(F.lit(' "a"  b '))) == "'a' b" and one(spark, T.prompt_text(F.lit("  "))) is None
    assert one(spark, T.sanitize_code(F.lit("p/1 é"))) == "p1" and one(spark, T.sanitize_code(F.lit("é"))) == "anon"


def test_box_functions(spark):
    b = lambda *v: N.Box(*map(F.lit, map(float, v)))
    assert one(spark, N.iou(b(0, 0, 10, 0), b(0, 0, 10, 0))) == 1.0
    assert one(spark, N.iou(b(0, 0, 10, 10), b(100, 0, 10, 10))) == 0.0
    assert one(spark, N.covered_by(b(1, 1, 0, 5), b(0, 0, 10, 10))) == 1.0 and one(spark, N.covered_by(b(5, 0, 10, 10), b(0, 0, 10, 10))) == 0.5
    assert one(spark, N.dist_to_box(F.lit(13.0), F.lit(14.0), b(0, 0, 10, 10))) == 5.0
    assert one(spark, N.half_up(F.lit(-0.5))) == 0 and one(spark, N.half_even(F.lit(2.5))) == 2
    assert one(spark, N.homography(F.lit(2.0), F.lit(4.0), (1, 0, 0, 0, 1, 0, 0, 0, 2))[1]) == 2.0


def test_greedy_match_settles_competition(spark):
    for _ in range(20):
        pairs = [(0, int(g), int(p), float(s)) for g, p, s in zip(RNG.integers(0, 6, 15), RNG.integers(0, 6, 15), RNG.integers(5, 9, 15) / 10, strict=True)]
        used_g, used_p, want = set(), set(), set()
        for _, g, p, s in sorted(pairs, key=lambda r: (r[3], r[2], r[1]), reverse=True):
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                want.add((g, p, s))
        df = spark.createDataFrame(pairs, "doc int, g int, p int, s double").coalesce(1)
        assert {(r.g, r.p, r.s) for r in J.greedy_match(df, "doc", "g", "p", "s").collect()} == want


def test_bands_reset_their_reach(spark):
    rows = [(1, k, float(lo), float(lo + h)) for k, (lo, h) in enumerate(zip(RNG.integers(0, 400, 40), RNG.integers(1, 60, 40), strict=True))]
    want, band, reach = {}, -1, float("-inf")
    for _, k, lo, hi in sorted(rows, key=lambda r: (r[2], r[1])):
        if reach - lo <= 0.15 * (hi - lo):
            band, reach = band + 1, hi
        else:
            reach = max(reach, hi)
        want[k] = band
    df = spark.createDataFrame(rows, "doc int, k int, lo double, hi double")
    assert {r.k: r.band for r in W.bands(df, "doc", "k", "lo", "hi", 0.15 * (F.col("hi") - F.col("lo"))).collect()} == want


def test_row_group(spark):
    rows = [(1, k, float(x), float(y), float(h)) for k, (x, y, h) in enumerate(zip(RNG.integers(0, 300, 30), RNG.integers(0, 300, 30), RNG.integers(10, 50, 30), strict=True))]
    want, row, top, end = {}, -1, 0.0, 0.0
    for _, k, _, y, h in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        if row >= 0 and min(end, y + h) - max(top, y) > 0.5 * min(h, end - top):
            top, end = min(top, y), max(end, y + h)
        else:
            row, top, end = row + 1, y, y + h
        want[k] = row
    df = spark.createDataFrame(rows, "doc int, k int, x double, y double, h double")
    assert {r.k: r.row for r in W.row_group(df, "doc", "k").collect()} == want


def test_dedupe_names(spark):
    titles = ["Home", "Home", None, "home_2", "Home", "9 lives", "?!", "x" * 60]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(titles)], "doc int, k int, title string")
    names = [r.name for r in W.dedupe_names(df, "doc", "k", "title").orderBy("k").collect()]
    assert names == ["home", "home_2", "screen_3", "home_2_2", "home_3", "s_9_lives", "screen7", "x" * 28]


def test_direction_turns(spark):
    ys = [0, 10, 4, 3, 12, 11, 12, 0]
    df = spark.createDataFrame([(1, k, float(y)) for k, y in enumerate(ys)], "s int, k int, y double")
    assert W.direction_turns(df, ["s"], "k", F.lit(5.0)).first()["turns"] == 3
    assert W.direction_turns(df, ["s"], "k", F.lit(50.0)).first()["turns"] == 0


def test_triples_use_a_line_once(spark):
    lines = [(1, k, 10.0, 10.0 * k) for k in range(7)]
    df = spark.createDataFrame(lines, "doc int, k int, x double, y double")
    assert sorted(r.k for r in W.triples(df, "doc", "k", 5.0, 40.0).collect()) == [0, 3]


def test_unfinished_steps(spark):
    log = [(1, 1, "launch", None), (1, 2, "start", "a"), (1, 3, "start", "b"), (1, 4, "end", "b"), (2, 1, "start", "c"), (2, 2, "launch", None), (3, 1, "end", "d"), (3, 2, "start", "d")]
    df = spark.createDataFrame(log, "device int, ts int, kind string, step string")
    assert {(r.device, r.step) for r in W.unfinished_steps(df, "device", "ts", "kind", "step").collect()} == {(1, "a"), (3, "d")}


def test_resample_keeps_ends_and_dots(spark):
    pts = [(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 3.0, 4.0), (2, 0, 7.0, 8.0)]
    df = spark.createDataFrame(pts, "s int, k int, x double, y double")
    got = {(r.s, r.i): (r.x, r.y) for r in W.resample(df, ["s"], "k", 8).collect()}
    assert len(got) == 16 and got[1, 0] == (0.0, 0.0) and got[1, 7] == (3.0, 4.0) and got[1, 3] == (3.0, 0.0) and got[2, 5] == (7.0, 8.0)


def test_shapes_are_centred(spark):
    df = spark.createDataFrame([(1, 1, k, float(k), 0.0) for k in range(5)], "sketch_id int, stroke_id int, seq int, x double, y double")
    shape = X.stroke_shape(df, 5).first()["shape"]
    assert [s[0] for s in shape] == [-2, -1, 0, 1, 2] and [s[2] for s in shape] == [1, 1, 1, 1, 0]


def test_tree_edit_distance():
    leaf = lambda t: {"t": t}
    a = {"t": "col", "c": [leaf("text"), {"t": "row", "c": [leaf("btn"), leaf("img")]}]}
    b = {"t": "col", "c": [leaf("text"), leaf("btn"), leaf("icon")]}
    dist = lambda x, y: trees.tree_distance(x, y)
    assert dist(a, a) == (0, 5) and dist(a, b) == (2, 5) and dist(leaf("a"), leaf("b")) == (1, 1)


def test_canonical_is_idempotent(spark):
    text = '{"s": "body", "v": "x", "t": "text", "go": "a"}'
    first = one(spark, trees.canonical_json(F.lit(text)))
    assert first == '{"t":"text","v":"x","go":"a"}' and one(spark, trees.canonical_json(F.lit(first))) == first
    assert one(spark, trees.canonical_json(F.lit('{"t":"list","n":3.0,"item":{"t":"btn","variant":"primary"}}'))) == '{"t":"list","n":3,"item":{"t":"btn"}}'
    assert one(spark, trees.canonical_json(F.lit("{"))) is None


@pytest.mark.parametrize(("text", "fixed"), [('Sure: {"a":[1,2,],} bye', {"a": [1, 2]}), ('{"a":[1,{"b":2', {"a": [1, {"b": 2}]}), ('{"a":"}{"}', {"a": "}{"}), ("none", None)])
def test_repair_json(spark, text, fixed):
    got = one(spark, trees.repair_json(F.lit(text)))
    assert (json.loads(got) if got else None) == fixed


def test_splice_unlabelled(spark):
    doc = '{"l":"root","children":[{"children":[{"l":"a"},{"children":[{"l":"b"}]}]},{"l":"c","children":[{"l":"d"}]}]}'
    nodes = trees.flatten(spark.createDataFrame([(1, doc), (2, "{bad")], "doc int, text string"), "doc", "text", depth=4).withColumn("l", F.try_variant_get("node", "$.l", "string"))
    found = {r.l: r.parent for r in trees.splice_unlabelled(nodes, "doc", "l").collect()}
    assert found == {"root": None, "a": "", "b": "", "c": "", "d": "/children/1"}


def test_average_linkage(spark):
    pairs = [(1, 1, 2, 0.9), (1, 2, 3, 0.8), (1, 1, 3, 0.3), (1, 3, 4, 0.2), (1, 4, 5, 0.7)]
    got = {r.i: r.cluster for r in trees.average_linkage(spark.createDataFrame(pairs, "doc int, i int, j int, p double"), "doc").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_corruption_is_statistical_and_identity_at_zero(spark):
    e = spark.createDataFrame([(k, "text", 0.0, 0.0, 10.0, 10.0, "hello") for k in range(2000)], "id int, type string, x double, y double, w double, h double, text string")
    rates, conf = spark.createDataFrame([("text", 0.25)], "type string, miss_rate double"), spark.createDataFrame([("text", "btn", 0.5)], "type string, other string, p double")
    run = lambda s, n=3: P.corrupt_elements(e.repartition(n), rates, conf, key="id", seed="q", jitter=1.0, cer=0.3, strength=s)
    assert sorted(map(tuple, run(0.0).collect())) == sorted(map(tuple, e.collect()))
    got = run(1.0).collect()
    assert 1400 < len(got) < 1600 and 0.4 < sum(r.type == "btn" for r in got) / len(got) < 0.6
    assert abs(np.mean([r.x for r in got])) < 0.1 and 0.9 < np.std([r.x for r in got]) < 1.1 and any(r.text != "hello" for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, run(1.0, 7).collect()))


def test_links_go_to_other_screens(spark):
    nodes = spark.createDataFrame([(d, s, 100 * d + 10 * s + k, "btn") for d in range(20) for s in range(3) for k in range(4)], "doc int, screen int, id int, type string")
    screens = nodes.select("doc", "screen").distinct()
    links = P.add_links(nodes, screens, doc="doc", key="id", screen="screen", kinds=["btn"], seed="s").collect()
    assert all(r.go != r.id % 100 // 10 and 0 <= r.go < 3 for r in links) and 60 <= len(links) <= 120
    assert len({(r.doc, r.id % 100 // 10) for r in links}) == 60


def test_peers_are_others_of_the_group(spark):
    rows = spark.createDataFrame([(k, k % 5 if k < 50 else k) for k in range(60)], "id int, g int")
    got = J.same_group_peers(rows, "id", "g", seed="s", share=100, pools=1).collect()
    group = {r.id: r.g for r in rows.collect()}
    assert all(r.id != r.peer for r in got) and len({(r.id, r.peer) for r in got}) == len(got) == 110
    assert all(group[r.id] == group[r.peer] for r in got if r.id < 50) and {r.peer for r in got if r.id >= 50} == set(range(50, 60))


def test_metrics_by_properties(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "d int, t string")
    none = gold.limit(0)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "d int")
    f1 = lambda g, p: {r.d: r.f1 for r in A.multiset_f1(g, p, docs, "d", "t").collect()}
    assert f1(gold, gold) == {1: 1.0, 2: 1.0, 3: 1.0} and f1(gold, none) == {1: 0.0, 2: 0.0, 3: 1.0}
    assert A.prf(spark.createDataFrame([(0, 0, 0)], "t int, p int, g int"), "t", "p", "g").first() == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="lengths differ"):
        A.sequence_accuracy(spark.createDataFrame([([1], [1, 2])], "g array<int>, p array<int>"), "g", "p").collect()


def test_gate_takes_the_first_rule(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    got = [r.reason for r in R.gate(df, [("small", F.col("v") < 3), ("any", F.col("v") > 0)]).collect()]
    assert got == ["small", "any", "ok"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/7.json").write_text('{"a": 1}')
    (tmp_path / "docs/8.json").write_text("{broken")
    assert {(r.id, r.reason) for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()} == {(7, "ok"), (8, "error")}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/x.json", "{}")
        z.writestr("photo.png", "p")
    (tmp_path / "z").mkdir()
    (tmp_path / "z/b.zip").write_bytes(data.getvalue())
    (tmp_path / "z/c.zip").write_bytes(b"no zip")
    assert {(r.bundle[-5:], r.name, r.text) for r in readers.read_bundle(spark, str(tmp_path / "z")).collect()} == {("b.zip", "a/x.json", "{}"), ("c.zip", None, None)}
    records = spark.createDataFrame([("b.zip",), ("none.zip",)], "photo string")
    assert {r.photo: r.blob is not None for r in readers.read_blobs(spark, records, str(tmp_path / "z"), "photo").collect()} == {"b.zip": True, "none.zip": False}
    assert readers.read_params({"a": {"b": [1, 2]}, "c": 3}) == {"a.b": (1.0, 2.0), "c": (3.0, 3.0)}
    stats = spark.createDataFrame([("n", 1.5), ("m", None)], "name string, value double")
    writers.write_stats(stats, str(tmp_path / "s"), "d", "test")
    assert spark.read.json(str(tmp_path / "s/d_test")).count() == 2
    assert writers.render_report(stats, "T", ["name"]) == "## T\n\n| name | value |\n|---|---|\n| m |  |\n| n | 1.500 |"


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def plain_linkage(p, least):
    """Clusters by mean affinity, each pair looked at anew."""
    clusters = [[k] for k in sorted({x for pair in p for x in pair})]
    mean = lambda a, b: sum(p.get((min(i, j), max(i, j)), 0.0) for i in a for j in b) / (len(a) * len(b))
    while len(clusters) > 1:
        v, a, b = max((mean(clusters[a], clusters[b]), -a, -b) for a in range(len(clusters)) for b in range(a + 1, len(clusters)))
        if v <= least:
            break
        clusters[-a] += clusters.pop(-b)
    return {k: min(c) for c in clusters for k in c}


def test_linkage_and_decoding_against_plain_loops(spark):
    import random

    rng = random.Random(5)
    pairs, strokes, kinds, want = [], [], [], set()
    for doc in range(12):
        n = rng.randint(2, 14)
        p = {(i, j): round(rng.random(), 6) for i in range(n) for j in range(i + 1, n)}
        pairs += [(doc, i, j, v) for (i, j), v in p.items()]
        boxes = {i: (float(rng.randint(0, 50)), float(rng.randint(0, 50)), float(rng.randint(1, 9)), float(rng.randint(1, 9))) for i in range(n)}
        strokes += [(doc, i, *b) for i, b in boxes.items()]
        probability = {(i, t): rng.random() for i in range(n) for t in ("btn", "none", "text")}
        kinds += [(doc, i, t, v) for (i, t), v in probability.items()]
        of = plain_linkage(p, 0.5)
        for c in set(of.values()):
            own = [i for i in of if of[i] == c]
            sums = {t: sum(probability[i, t] for i in own) for t in ("btn", "none", "text")}
            kind = max(sorted(sums), key=lambda t: sums[t])
            if kind != "none":
                x, y = min(boxes[i][0] for i in own), min(boxes[i][1] for i in own)
                want.add((doc, c, kind, round(sums[kind], 6), x, y, max(boxes[i][0] + boxes[i][2] for i in own) - x, max(boxes[i][1] + boxes[i][3] for i in own) - y))
    affinity = spark.createDataFrame(pairs, "doc int, i int, j int, p double")
    found = {(r.doc, r.i): r.cluster for r in trees.average_linkage(affinity, "doc").collect()}
    assert found == {(d, k): c for d in range(12) for k, c in plain_linkage({(i, j): v for e, i, j, v in pairs if e == d}, 0.5).items()}
    got = L.decode_elements(spark.createDataFrame(strokes, "doc int, i int, x double, y double, w double, h double"), affinity, spark.createDataFrame(kinds, "doc int, i int, type string, p double"), "doc")
    assert {(r.doc, r.cluster, r.type, round(r.score, 6), r.x, r.y, r.w, r.h) for r in got.collect()} == want


def test_hierarchies_of_any_depth(spark):
    deep = "null"
    for k in range(25, -1, -1):
        deep = f'{{"l":{k if k % 5 == 0 else "null"},"children":[{deep}]}}' if k < 25 else f'{{"l":{k}}}'
    nodes = trees.flatten(spark.createDataFrame([(1, deep), (2, '{"l":7}'), (3, None)], "doc int, text string"), "doc", "text").withColumn("l", F.try_variant_get("node", "$.l", "int"))
    assert {r.doc: r.n for r in nodes.groupBy("doc").agg(F.max("depth").alias("n")).collect()} == {1: 25, 2: 0}
    named = {(r.doc, r.l): r.parent for r in trees.splice_unlabelled(nodes, "doc", "l").collect()}
    path = lambda k: "/children/0" * k
    assert named == {(1, 0): None, (2, 7): None} | {(1, k): path(k - 5) for k in range(5, 26, 5)}
    sig = {r.path: r.sig for r in trees.signature(nodes.withColumn("t", F.lit("x")), "doc", "t").filter("doc = 1").collect()}
    assert sig[""] == "x(" * 25 + "x" + ")" * 25


def test_picking_goes_on_beyond_a_pool(spark):
    docs = spark.range(300).selectExpr("id", "array(concat('t', id % 3)) AS kinds")
    few = [r.id for r in L.greedy_diverse(docs, "id", "kinds", k=60, pool=7, seed="s", luck=0.3).orderBy("place").collect()]
    assert len(few) == 60 == len(set(few))
    assert few == [r.id for r in L.greedy_diverse(docs, "id", "kinds", k=60, pool=1000, seed="s", luck=0.3).orderBy("place").collect()]
    assert L.greedy_diverse(docs, "id", "kinds", k=400, pool=50, seed="s", luck=0.0).count() == 12


def test_slots(spark):
    rows = [(1, "/0", 1, "Toolbar", None, 0.0, 10.0, 100.0, 10.0), (1, "/0/0", 2, "Icon", "menu", 0.0, 10.0, 5.0, 5.0), (1, "/1", 3, "Toolbar", None, 0.0, 12.0, 9.0, 9.0), (1, "/2", 4, "Bottom Navigation", None, 0.0, 180.0, 100.0, 20.0), (1, "/2/0", 5, "Icon", "add", 80.0, 180.0, 10.0, 10.0), (1, "/3", 6, "Icon", "add", 80.0, 160.0, 10.0, 10.0), (1, "/4", 7, "Text", None, 0.0, 50.0, 9.0, 9.0)]
    found = L.extract_slots(spark.createDataFrame(rows, "d int, path string, place int, label string, icon string, x double, y double, w double, h double"), "d", 200.0, 100.0)
    assert [r.slot for r in found.orderBy("place").collect()] == ["appbar", "appbar", "body", "bottomnav", "fab", "body", "body"]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_ranks_against_sorted_lists(spark, n):
    rows = [(k % 3, float((k * k) % 7)) for k in range(n)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    want = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows[:-1]}}
    line = lambda v, q: v[int(q * (len(v) - 1))] + (q * (len(v) - 1) % 1) * (v[min(len(v) - 1, int(q * (len(v) - 1)) + 1)] - v[int(q * (len(v) - 1))])
    got = {r.g: r for r in A.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == set(want)
    assert all(abs(got[g][k] - line(v, q)) < 1e-9 for g, v in want.items() for k, q in (("a", 0.1), ("b", 0.5), ("c", 1.0)))
    assert {r.g: r["median"] for r in A.upper_median(df.filter("v IS NOT NULL"), ["g"], "v").collect()} == {g: v[len(v) // 2] for g, v in want.items()}
    placed = W.numbered(df.filter("v IS NOT NULL").withColumn("k", F.monotonically_increasing_id()), ["g"], ["v", "k"]).collect()
    assert {(r.g, r.place) for r in placed} == {(g, i) for g, v in want.items() for i in range(len(v))}
    assert all(want[r.g][r.place] == r.v for r in placed)


def test_farthest_pair_against_all_pairs(spark):
    import random

    rng, rows = random.Random(2), []
    for g in range(40):
        side = rng.choice([1, 3, 20])
        rows += [(g, k, float(rng.randint(0, side)), float(rng.randint(0, side if g % 4 else 0))) for k in range(rng.randint(1, 25))]
    want = {}
    for g in range(40):
        p = [r[1:] for r in rows if r[0] == g]
        best = max((((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, -a[0], -b[0]) for a in p for b in p if a[0] < b[0]), default=None)
        if best:
            want[g] = (-best[1], -best[2], best[0])
    found = {r.g: (r.i, r.j, r.d2) for r in A.farthest_pair(spark.createDataFrame(rows, "g int, k int, x double, y double"), ["g"], "k").collect()}
    assert found == want


def test_parameters_of_a_dataset():
    values = {"a": {"b": 1}, "c": [1, 2], "datasets": {"x": {"c": 5}, "y": {}}}
    assert readers.read_params(values, "x") == {"a.b": (1.0, 1.0), "c": (5.0, 5.0)}
    assert readers.read_params(values, "y") == readers.read_params(values) == {"a.b": (1.0, 1.0), "c": (1.0, 2.0)}
    with pytest.raises(ValueError, match="no parameters"):
        readers.read_params(values, "z")


def test_a_report_is_whole_or_an_error(spark):
    with pytest.raises(ValueError, match="at most 3"):
        writers.render_report(spark.range(4).toDF("n"), "T", ["n"], most=3)


def test_fallback_goes_on_with_what_failed(spark):
    def first(v):
        return str(10 // v)

    def second(v):
        return {0: "zero"}[v]

    rows = spark.createDataFrame([(2,), (0,), (None,)], "v int").withColumn("stage", F.lit("x"))
    got = {r.v: r for r in trees.with_fallback(rows, [("first", first), ("second", second)], "v").collect()}
    assert got[2].output == "5" and (got[2].engine, got[2].stage, got[2].fell_back, got[2].error) == ("first", 0, False, None)
    assert got[0].output == "zero" and (got[0].engine, got[0].stage, got[0].fell_back) == ("second", 1, True) and got[0].error.startswith("first:")
    assert got[None].output is None and (got[None].engine, got[None].stage, got[None].fell_back) == (None, None, True) and got[None].error.startswith("second:")
    assert all(r.elapsed_ms >= 0 for r in got.values())
