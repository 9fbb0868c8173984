"""Features of strokes: ordered points become columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import arc_length, lag_pause, resampled


def stroke_geometry(points: DataFrame, doc: str = "sketch_id", stroke: str = "stroke_id", order: str = "seq") -> DataFrame:
    """Centre, size, length, closure, straightness, number of points, duration, pause, minutes, ends and aspect of each stroke."""
    along = arc_length(points, [doc, stroke], order)
    g = along.groupBy(doc, stroke).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("length").alias("length"), F.count("*").alias("n"),
        F.min_by("x", order).alias("sx"), F.min_by("y", order).alias("sy"), F.max_by("x", order).alias("ex"), F.max_by("y", order).alias("ey"), F.min("t").alias("t0"), F.max("t").alias("t1"),
    )
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    gap, diagonal = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")), F.hypot(w, h)
    g = lag_pause(g, doc, stroke, "t0", "t1")
    return g.select(
        doc, stroke, "n", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), w.alias("w"), h.alias("h"), F.log1p("length").alias("log_length"),
        F.when(diagonal > 0, gap / diagonal).otherwise(0.0).alias("closure"), F.when(F.col("length") > 0, gap / F.col("length")).otherwise(1.0).alias("straightness"),
        (F.col("t1") - F.col("t0")).alias("duration"), "pause", "minutes", "sx", "sy", "ex", "ey", F.ln((w + 1) / (h + 1)).alias("aspect"),
    )


def scaled_geometry(geometry: DataFrame, units: DataFrame, doc: str = "sketch_id", stroke: str = "stroke_id") -> DataFrame:
    """(doc, stroke, geometry): 16 numbers of each stroke for a model, in the sketch's own origin and unit.

    geometry: stroke_geometry(); units: doc, ox, oy, unit (aggregates.sketch_unit). In order: centre, size, length, closure,
    straightness, points, duration, pause, minutes, first point, last point, aspect; long-tailed ones as logarithms.
    """
    on = geometry.join(units.select(doc, "ox", "oy", "unit").hint("merge"), doc)
    x, y = (lambda c: (F.col(c) - F.col("ox")) / F.col("unit")), (lambda c: (F.col(c) - F.col("oy")) / F.col("unit"))
    time = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0)) / 100)
    thin = lambda c: F.col(c) + 1e-3
    values = [
        x("cx"), y("cy"), F.col("w") / F.col("unit"), F.col("h") / F.col("unit"), F.log1p(10 * F.expm1("log_length") / F.col("unit")), F.col("closure"), F.col("straightness"), F.log1p("n") / 6,
        time("duration"), time("pause"), F.col("minutes"), x("sx"), y("sy"), x("ex"), y("ey"), F.ln(thin("w") / thin("h")) / 4,
    ]
    return on.select(doc, stroke, F.array(*(v.cast("double") for v in values)).alias("geometry"))


def stroke_shape(points: DataFrame, n: int = 32, doc: str = "sketch_id", stroke: str = "stroke_id", order: str = "seq") -> DataFrame:
    """(doc, stroke, shape): n times (x, y, dx, dy): places relative to the centre and unit directions."""
    even = resampled(points, [doc, stroke], order, n)
    mean = lambda c: F.aggregate(F.col("even")[c], F.lit(0.0), lambda a, v: a + v, lambda a: a / n)

    def item(s: Column, i: Column, mid: Column) -> Column:
        after = F.get("even", i + 1)
        dx, dy = F.coalesce(after["x"] - s["x"], F.lit(0.0)), F.coalesce(after["y"] - s["y"], F.lit(0.0))
        size = F.when(F.hypot(dx, dy) > 0, F.hypot(dx, dy)).otherwise(1.0)
        return F.array(s["x"] - mid["x"], s["y"] - mid["y"], dx / size, dy / size)

    middle = F.array(F.struct(mean("x").alias("x"), mean("y").alias("y")))  # of one, so that it is counted once for all items
    return even.select(doc, stroke, F.transform(middle, lambda mid: F.transform("even", lambda s, i: item(s, i, mid)))[0].alias("shape"))


def rule_features(points: DataFrame, doc: str = "sketch_id", stroke: str = "stroke_id", order: str = "seq") -> DataFrame:
    """Closure, straightness, corners (tolerance: 6 % of the diagonal), the share of its box that a stroke's polygon covers, and turns in y (swings of 40 % of the height, and half a unit)."""
    from annomill.functions.numeric import shoelace

    from .layouts import polyline_corners
    from .windows import direction_turns

    keys, whole = [doc, stroke], Window.partitionBy(doc, stroke)
    w, h = F.max("x").over(whole) - F.min("x").over(whole), F.max("y").over(whole) - F.min("y").over(whole)
    sized = points.withColumns({"__corner": 0.06 * F.greatest(F.hypot(w, h), F.lit(1e-6)), "__swing": F.greatest(0.4 * h, F.lit(0.5))})
    xy = F.array_sort(F.collect_list(F.struct(order, "x", "y")))
    area = points.groupBy(*keys).agg(xy.alias("p")).select(*keys, shoelace(F.transform("p", lambda s: s["x"]), F.transform("p", lambda s: s["y"])).alias("area"))
    g = stroke_geometry(points, doc, stroke, order)
    for more in (area, polyline_corners(sized.select(*keys, order, "x", "y", "__corner"), keys, order, "__corner"), direction_turns(sized, keys, order, F.col("__swing"))):
        g = g.join(more.hint("merge"), keys)
    return g.select(*keys, "closure", "straightness", "corners", (F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1e-6))).alias("area_ratio"), "turns")


def stroke_labels(strokes: DataFrame, groups: DataFrame, doc: str, group: str, types: list[str]) -> DataFrame:
    """Class, group and type index of each stroke; strokes outside any element get the index after the last type."""
    on = strokes.join(groups.select(doc, group, "kind", "type"), [doc, group], "left")
    index = F.array_position(F.array(*map(F.lit, types)), F.col("type")) - 1
    return on.withColumn("type_index", F.when(index >= 0, index).otherwise(len(types)).cast("int"))


def pair_targets(strokes: DataFrame, doc: str, key: str, group: str) -> DataFrame:
    """All ordered pairs of a sketch's strokes, and whether they are in one group. Quadratic in a sketch's strokes, as training needs it."""
    a, b = strokes.select(doc, F.col(key).alias("i"), F.col(group).alias("gi")), strokes.select(doc, F.col(key).alias("j"), F.col(group).alias("gj"))
    return a.join(b, doc).filter("i != j").select(doc, "i", "j", (F.col("gi") == F.col("gj")).alias("same"))


def pad_batches(df: DataFrame, batch: list[str], values: str, pad: float) -> DataFrame:
    """Sequences padded to the longest of their batch, with a mask."""
    n = F.max(F.size(values)).over(Window.partitionBy(*batch))
    missing = n - F.size(values)
    return df.withColumns({"padded": F.concat(values, F.array_repeat(F.lit(pad), missing)), "mask": F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), missing))})
