"""Drawing plans, training pairs, task sets and upserted streams on literal cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from annomill.operators import layouts as L
from annomill.operators.sampling import noisy_copy
from annomill.operators.task_plans import plan_documents
from annomill.streaming import ingest


def spec(*screens):
    return json.dumps({"v": 1, "screens": list(screens)})


def col(*nodes):
    return {"t": "col", "c": list(nodes)}


def test_plan_of_nested_documents(spark):
    first = {"id": "a", "title": "A", "appbar": {"t": "appbar", "title": "Top", "icons": [{"t": "icon", "name": "star", "go": "b"}]}, "fab": {"t": "fab", "icon": "add", "go": "a"}, "body": col(
        {"t": "list", "n": 3, "item": {"t": "card", "go": "b", "c": [{"t": "text", "v": "x", "s": "h2"}, {"t": "row", "c": [{"t": "avatar"}, {"t": "spacer"}]}]}},
        {"t": "grid", "cols": 2, "n": 2, "item": {"t": "img", "h": 9}}, {"t": "odd", "c": [{"t": "btn", "label": "lost"}]}, {"t": "radio", "options": ["one", "two"]})}
    second = {"id": "b", "title": "B", "body": {"t": "para", "lines": 1}, "bottomnav": {"t": "bottomnav", "items": [{"icon": "home", "label": "H", "go": "a"}, {"icon": "more", "label": "M", "go": "nowhere"}]}}
    docs = spark.createDataFrame([(1, spec(first, second)), (None, spec(second)), (2, None), (3, "{"), (4, "[]"), (5, spec())], "doc long, spec string")
    found = {}
    for r in plan_documents(docs, "doc", "spec").orderBy("step").collect():
        found.setdefault(r.doc, []).append(r)
    assert set(found) == {1, None}
    assert [r.step for r in found[1]] == list(range(len(found[1])))
    groups = {r.group: (r.type, r.screen, r.label, r.target) for r in found[1]}
    assert [groups[k] for k in sorted(groups)] == [
        ("appbar", 0, "Top", None), ("icon", 0, None, None), ("card", 0, None, None), ("heading", 0, "x", None), ("avatar", 0, None, None), ("listmark", 0, "x3", None), ("img", 0, None, None), ("img", 0, None, None), ("radio", 0, "one", None),
        ("radio", 0, "two", None), ("fab", 0, None, None), ("para", 1, None, None), ("bottomnav", 1, None, None), ("icon", 1, None, None), ("text", 1, "H", None), ("icon", 1, None, None), ("text", 1, "M", None), ("arrow", 0, None, 1), ("arrow", 0, None, 1), ("arrow", 1, None, 0),
    ]
    said = [r.instruction for r in found[1]]
    assert said[:2] == ["Screen 1 app bar: draw a band (or a line) across the top", 'Write the title "Top" in the band'] and "Paragraph: draw 1 wavy line" in said
    assert said[-3:] == ["Draw an arrow from the icon to screen 2", "Draw an arrow from the card to screen 2", 'Draw an arrow from the "H" tab to screen 1']
    assert [r.type for r in found[None]] == ["para", "bottomnav", "icon", "text", "icon", "text"]
    assert plan_documents(docs.limit(0), "doc", "spec").count() == 0


NOISE = {"miss_rate": {"text": 1.0}, "confusion": {"btn": {"card": 1}}, "box_offset_std": 0.02, "missing_text": 0.0, "cer": 1.0, "false_positives_per_sketch": 2.0, "false_positive_types": {"img": 1}}


def test_noisy_copies_follow_each_documents_strength(spark):
    rows = [(d, 1, 10 * d + k, t, 10.0, 20.0, 30.0, 40.0, s) for d in range(40) for k, (t, s) in enumerate([("text", "abc"), ("btn", "word"), ("check", None)])]
    elements = spark.createDataFrame(rows, "doc long, frame_id long, element_id long, type string, x double, y double, w double, h double, text string")
    frames = spark.createDataFrame([(d, 1, 0, 0.0, 0.0, 360.0, 760.0) for d in range(40)], "doc long, frame_id long, ord int, x double, y double, w double, h double")
    strengths = spark.createDataFrame([(d, float(d % 2)) for d in range(39)], "doc long, strength double")
    found = noisy_copy(elements, frames, strengths, NOISE, doc="doc", key="element_id", seed="s").collect()
    still = {tuple(r) for r in found if r.doc % 2 == 0 or r.doc == 39}
    assert still == {tuple(r) for r in rows if r[0] % 2 == 0 or r[0] == 39}
    moved = [r for r in found if r.doc % 2 == 1 and r.doc < 39]
    assert {r.type for r in moved} == {"card", "check", "img"} and all(r.text is None or r.type == "card" for r in moved)
    extra = [r for r in moved if r.type == "img"]
    assert 15 < len(extra) < 65 and all(r.element_id >= 10_000 and 0 <= r.x <= 360 for r in extra)


def test_training_pairs(spark):
    elements = spark.createDataFrame([(d, 1, 10 * d, "btn", 10.0, 20.0, 30.0, 40.0, "word") for d in range(60)], "doc long, frame_id long, element_id long, type string, x double, y double, w double, h double, text string")
    frames = spark.createDataFrame([(d, 1, 0, 0.0, 0.0, 360.0, 760.0) for d in range(60)], "doc long, frame_id long, ord int, x double, y double, w double, h double")
    arrows = spark.createDataFrame([], "doc long, arrow long, tx double, ty double, hx double, hy double")
    specs = spark.createDataFrame([(d, "train" if d < 40 else "val", '{"screens":[],"v":1.0}' if d else "no JSON") for d in range(60)], "doc long, split string, spec string")
    found = L.sft_pairs(elements, frames, arrows, specs, "doc", noise=NOISE, seed="s", most=2000, first={"val": 7})
    rows = found.collect()
    assert {r.doc for r in rows} == set(range(1, 47)) and {r.completion for r in rows} == {'{"v":1,"screens":[]}'}
    clean = [r for r in rows if r.status == "clean"]
    assert 1 <= len(clean) <= 20 and all(r.prompt == 'S1\n1 btn 3,3,8,5 "word"' and r.split == "train" for r in clean)
    report = {r.split: r for r in L.sft_report(found).collect()}
    assert report["val"].examples == 7 and report["val"].clean == 0 and report["train"].noisy + report["train"].clean == 39


def test_task_documents(spark):
    leaves = [{"t": "check", "label": "a long label of many words"}] * 4
    good = spec({"id": "old", "title": "t", "body": col({"t": "text", "v": "Main Page", "s": "h1"}, {"t": "icon", "name": "star"}, {"t": "list", "n": 50, "item": {"t": "img", "h": 5}}, *leaves)})
    linked = spec({"id": "old", "title": "t", "body": col({"t": "btn", "label": "b", "go": "old"}, *leaves)})
    few = spec({"id": "old", "title": "t", "body": col(*leaves[:2])})
    deep = "[" * 100_000
    docs = spark.createDataFrame([(1, good), (2, linked), (3, few), (4, None), (5, "{"), (6, deep), (7, "3")], "doc long, spec string")
    found = {(r.source, r.doc): r.spec for r in L.task_documents(docs, docs, "doc", "spec", k=5, seed="x").collect()}
    assert set(found) == {("example", 1), ("example", 2), ("example", 3), ("sampled", 1)}
    screen = json.loads(found["sampled", 1])["screens"][0]
    assert (screen["id"], screen["title"]) == ("main_page", "Main Page") and screen["body"]["c"][1:4] == [{"t": "icon", "name": "circle"}, {"t": "list", "n": 6, "item": {"t": "img", "h": 5}}, {"t": "check", "label": "a long label"}]
    assert json.loads(found["example", 2])["screens"][0]["id"] == "old"


@pytest.mark.parametrize("fan", [2, 3, 4])
def test_runs_that_hold_all_batches_are_few(fan):
    for n in range(150):
        runs = ingest._cover(n, fan)
        assert sorted(b for level, last in runs for b in range(last + 1 - fan**level, last + 1)) == list(range(n))
        assert len(runs) <= (fan - 1) * 8


def test_upserted_stream_merges_levels_and_survives_a_replay(spark, tmp_path):
    schema, table, log = "k long, at long, v string", f"{tmp_path}/table", f"{tmp_path}/log"
    data = [(b * 7 % 5 if b % 4 else None, b, f"v{b}") for b in range(9)]
    for b, row in enumerate(data):
        spark.createDataFrame([row, (100 + b, b, "once")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert ingest.read_upserted(spark, table, schema, "k", "at", 2).count() == 0
    run = lambda: ingest.ingest_upsert(ingest.event_stream(spark, f"{tmp_path}/in", schema), table, log, "k", "at", 2).awaitTermination()
    wanted = {**{k: (at, v) for k, at, v in data}, **{100 + b: (b, "once") for b in range(9)}}
    read = lambda: {r.k: (r["at"], r.v) for r in ingest.read_upserted(spark, table, schema, "k", "at", 2).collect()}
    run()
    assert read() == wanted
    assert sorted(os.listdir(f"{table}/level=3")) == ["run=7"] and not os.path.exists(f"{table}/level=0/run=6")
    everything = spark.read.schema(schema).parquet(table)
    assert everything.count() < 40  # not a copy a level of every batch
    os.remove(f"{log}/commits/8")
    if os.path.exists(f"{log}/commits/.8.crc"):
        os.remove(f"{log}/commits/.8.crc")
    run()
    assert read() == wanted
    spark.createDataFrame([(1, 99, "new")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert read() == wanted | {1: (99, "new")}
    os.remove(f"{table}/level=1/run=9/_SUCCESS")  # as if the merge had been cut off
    assert read() == wanted | {1: (99, "new")}
