"""Prompts: elements are shuffled once by document, and a document of very many frames gives the same lines as one of few."""

import re

from pyspark.sql import functions as F

from annomill.operators import layouts, sampling

ELEMENTS = "doc long, element_id long, type string, x double, y double, w double, h double, text string"
FRAMES = "doc long, frame_id long, ord long, x double, y double, w double, h double"
ARROWS = "doc long, arrow long, tx double, ty double, hx double, hy double"


def tables(spark):
    frames = [(d, 100 * d + k, k, 500.0 * k, 0.0, 360.0, 760.0) for d in range(4) for k in range(6)]
    frames += [(3, 399, 2, 1000.0, 0.0, 360.0, 760.0), (9, 900, 0, 0.0, 0.0, 360.0, 760.0), (None, 901, 0, 0.0, 0.0, 360.0, 760.0), (2, 299, 9, None, 0.0, 360.0, 760.0)]
    elements = [(d, 1000 * d + k, "btn", 37.0 * k * (d + 1), 90.0 * (k % 11), 50.0, 20.0, f"t{k}" if k % 3 else None) for d in range(5) for k in range(60)]
    elements += [(1, 1900, "text", None, 1.0, 1.0, 1.0, "x"), (None, 1, "btn", 1.0, 1.0, 1.0, 1.0, "y")]
    arrows = [(d, 1, 40.0, 40.0, 700.0, 20.0) for d in range(4)]
    return spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(frames, FRAMES), spark.createDataFrame(arrows, ARROWS)


def test_few_and_many_frames_give_the_same_prompts(spark, monkeypatch):
    elements, frames, arrows = tables(spark)
    for a in (arrows, arrows.filter(F.lit(False))):
        found = []
        for few in (64, 6, 0):  # all by document, some by cells, all by cells
            monkeypatch.setattr(sampling, "FEW_FRAMES", few)
            found.append({r.doc: r.prompt for r in layouts.format_elements(elements, frames, a, "doc").collect()})
        assert found[0] == found[1] == found[2]
        assert set(found[0]) == {0, 1, 2, 3, 9, None} and found[0][9] == "S1" and len(found[0][0].split("\n")) >= 66


def test_widths_of_frames_are_the_same_by_list_and_by_join(spark, monkeypatch):
    elements, frames, _ = tables(spark)
    elements = elements.withColumn("frame_id", F.col("doc") * 100 + F.col("element_id") % 8)
    frames = frames.filter("frame_id NOT IN (299, 399)").withColumn("w", F.col("w") + F.col("ord"))
    strengths = spark.createDataFrame([(d, 1.0) for d in range(3)], "doc long, strength double")
    noise = {"miss_rate": {}, "confusion": {}, "box_offset_std": 0.1, "missing_text": 0.0, "cer": 0.0, "false_positives_per_sketch": 0, "false_positive_types": {}}
    found = []
    for few in (64, 5, 0):
        monkeypatch.setattr(sampling, "FEW_FRAMES", few)
        found.append(sorted(map(str, sampling.noisy_copy(elements, frames, strengths, noise, doc="doc", key="element_id", seed="s").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == elements.count()


def test_elements_without_arrows_are_shuffled_once(spark):
    elements, frames, arrows = tables(spark)
    found = layouts.format_elements(elements, frames, arrows.filter(F.lit(False)), "doc")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[-1])) <= 3  # frames' lines, elements, lists of frames
