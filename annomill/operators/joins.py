"""Joins. Boxes of a document meet through grid cells (spatial.meeting), so that neither a pair of tables nor one document makes all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annomill.functions.numeric import Box, covered_by, dist_to_box, hash32, iou, overlap
from annomill.session import stored

from .spatial import extent, meeting, nearest, point


def lookup_left(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with the lookup's value, or the default. Spark broadcasts the lookup if its size allows."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def pair_inner(gold: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """Gold and predicted rows with the same key; columns of predictions get the prefix p_."""
    return gold.join(prefixed(pred, "p_", on), on, "inner")


def pair_left_zero(gold: DataFrame, pred: DataFrame, on: list[str], metric: str) -> DataFrame:
    """Every gold row with its metric, 0 where there is no prediction."""
    return gold.join(pred.select(*on, metric), on, "left").withColumn(metric, F.coalesce(F.col(metric), F.lit(0.0)))


def restrict_semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def new_keys_anti(keys: DataFrame, registry: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that the registry doesn't have."""
    return keys.select(*on).distinct().join(registry.select(*on), on, "left_anti")


def unmatched(gold: DataFrame, pred: DataFrame, matched: DataFrame, gold_key: str, pred_key: str) -> DataFrame:
    """(kind, key): misses among gold and false positives among predictions."""
    miss = gold.join(matched.hint("merge"), gold_key, "left_anti").select(F.lit("miss").alias("kind"), F.col(gold_key).alias("key"))
    extra = pred.join(matched.hint("merge"), pred_key, "left_anti").select(F.lit("false_positive").alias("kind"), F.col(pred_key).alias("key"))
    return miss.unionByName(extra)


def dangling(links: DataFrame, targets: DataFrame, link: str, target: str) -> DataFrame:
    """Links whose target isn't there."""
    return links.join(targets.select(F.col(target).alias(link)), link, "left_anti")


def same_group_peers(rows: DataFrame, key: str, group: str, *, seed: str, share: int, most: int = 2, pools: int = 64) -> DataFrame:
    """(key, rank, peer): for a share (in percent) of rows up to `most` (1 or 2) other rows of the group, chosen by hash.

    The pick is the next rows in hash order within the group, round its end, so a large group makes no pairs. A row that is
    alone in its group gets the next such row of its hash pool.
    """
    from pyspark.sql import Window

    mark = hash32(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)

    def following(df: DataFrame, by: list[str]) -> DataFrame:
        ring = Window.partitionBy(*by).orderBy("mark", key)
        first = [F.nth_value(key, k).over(ring.rowsBetween(*whole)) for k in (1, 2)]
        nexts = [F.coalesce(F.lead(key, 1).over(ring), first[0]), F.coalesce(F.lead(key, 2).over(ring), F.when(F.lead(key, 1).over(ring).isNull(), first[1]).otherwise(first[0]))]
        out = df.withColumns({"n": F.count("*").over(Window.partitionBy(*by)), "peers": F.array(*nexts[:most])})
        return out

    grouped = following(rows.select(key, group).withColumn("mark", mark), [group])
    alone = following(grouped.filter("n = 1").select(key, "mark").withColumn("pool", F.col("mark") % pools), ["pool"]).withColumn("peers", F.slice("peers", 1, 1))
    both = grouped.filter("n > 1").select(key, "mark", "n", "peers").unionByName(alone.select(key, "mark", "n", "peers")).filter(F.col("mark") % 100 < share)
    listed = both.select(key, F.posexplode("peers").alias("rank", "peer"), "n").filter((F.col("rank") < F.col("n") - 1) & F.col("peer").isNotNull())
    return listed.select(key, (F.col("rank") + 1).alias("rank"), "peer")


def index_deref(index: Column, values: Column) -> Column:
    """values[i] for each zero-based index; null where there is none."""
    return F.transform(index, lambda i: F.when((i >= 0) & (i < F.size(values)), F.get(values, i)))


def link_to_ordinal(links: DataFrame, screens: DataFrame, doc: str, go: str, screen: str, ordinal: str) -> DataFrame:
    """Links that resolve, with the ordinal of their screen."""
    return links.join(screens.select(doc, F.col(screen).alias(go), ordinal), [doc, go])


def rename_links(links: DataFrame, names: DataFrame, old: str, new: str) -> DataFrame:
    """Old names replaced by new ones, unchanged where there is none."""
    return links.join(names.select(old, new), old, "left").withColumn(old, F.coalesce(new, old)).drop(new)


def prefixed(df: DataFrame, prefix: str, but: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in but else F.col(c).alias(prefix + c) for c in df.columns))


def iou_pairs(gold: DataFrame, pred: DataFrame, doc: str, *, least: float = 0.5, pad: float = 2.0) -> DataFrame:
    """Gold and predicted boxes of a document with their padded IoU, from `least` on; predictions' columns get p_."""
    g, p = Box.of(), Box.of("p_")
    near = meeting(gold, prefixed(pred, "p_", [doc]), doc, extent(g, pad), extent(p, pad))
    return near.withColumn("iou", iou(g, p, pad)).filter(F.col("iou") >= least)


def greedy_match(pairs: DataFrame, doc: str, gold: str, pred: str, score: str, keep: list[str] = ()) -> DataFrame:
    """One-to-one matches per document, best score first (ties: larger pred, then larger gold), with further columns of the pairs.

    A pair whose sides are in no other pair is a match at once; only the others go through the fold.
    """
    from pyspark.sql import Window

    alone = [F.count("*").over(Window.partitionBy(doc, k)) == 1 for k in (gold, pred)]
    pairs = pairs.withColumn("__free", alone[0] & alone[1])
    pair = F.struct(F.col(score).alias("s"), F.col(pred).alias("p"), F.col(gold).alias("g"), *keep)
    ordered = F.reverse(F.array_sort(F.collect_list(F.when(~F.col("__free"), pair))))
    kind = dict(pairs.dtypes)
    more = "".join(f",{c}:{kind[c]}" for c in keep)
    empty = F.array().cast(f"array<struct<s:{kind[score]},p:{kind[pred]},g:{kind[gold]}{more}>>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda a: (a["p"] == x["p"]) | (a["g"] == x["g"])), acc).otherwise(F.concat(acc, F.array(x)))

    found = pairs.groupBy(doc).agg(ordered.alias("o"), F.collect_list(F.when(F.col("__free"), pair)).alias("f")).withColumn("m", F.concat("f", F.aggregate("o", empty, step)))
    return found.select(doc, F.explode("m").alias("m")).select(doc, F.col("m.g").alias(gold), F.col("m.p").alias(pred), F.col("m.s").alias(score), *(F.col("m")[c].alias(c) for c in keep))


def containing_first(points: DataFrame, boxes: DataFrame, doc: str, key: str, box: str, ordinal: str, *, else_nearest: bool = True) -> DataFrame:
    """(doc, key, box, inside): of the boxes that hold the point (px, py) the first in order, else the nearest one, or no row."""
    b, x, y, o = Box.of("b_"), F.col("px"), F.col("py"), F.col("b_" + ordinal)
    marked = prefixed(boxes, "b_", [doc])
    held = meeting(points.select(doc, key, "px", "py"), marked, doc, point(x, y), extent(b))
    first = held.groupBy(doc, key).agg(F.min_by("b_" + box, F.struct(o, F.col("b_" + box))).alias(box))
    if not else_nearest:
        return first.withColumn("inside", F.lit(True))
    first = stored(first, "inside")
    rest = points.select(doc, key, "px", "py").join(first.hint("merge"), [doc, key], "left_anti")
    near = nearest(rest, marked, doc, key, x, y, b, [o, F.col("b_" + box)], ["b_" + box])
    return first.withColumn("inside", F.lit(True)).unionByName(near.select(doc, key, F.col("b_" + box).alias(box), F.lit(False).alias("inside")))


def smallest_container(elements: DataFrame, cards: DataFrame, doc: str, key: str, card: str) -> DataFrame:
    """(doc, key, card): the tightest card that holds the element's centre and is larger than it."""
    e, c = Box.of(), Box.of("c_")
    on = meeting(elements, prefixed(cards, "c_", [doc]), doc, point(e.cx, e.cy), extent(c)).filter(c.contains(e.cx, e.cy) & (c.area > e.area))
    return on.groupBy(doc, key).agg(F.min_by("c_" + card, F.struct(c.area, F.col("c_" + card))).alias(card))


def arrow_source(arrows: DataFrame, elements: DataFrame, doc: str, arrow: str, key: str, unit: float) -> DataFrame:
    """(doc, arrow, key): the smallest element that holds the tail (tx, ty) padded by 0.04 units, else the nearest within 0.15 units."""
    e = Box.of()
    x, y = F.col("tx"), F.col("ty")
    inside, far = e.contains(x, y, 0.04 * unit), dist_to_box(x, y, e)
    on = meeting(arrows, elements, doc, point(x, y, 0.15 * unit), extent(e)).filter(inside | (far < 0.15 * unit))
    rank = F.struct((~inside).alias("out"), F.when(inside, e.area).otherwise(far).alias("by"), F.col(key).alias("id"))
    return on.groupBy(doc, arrow).agg(F.min_by(key, rank).alias(key))


def overlap_words(words: DataFrame, zones: DataFrame, doc: str, zone: str, *, least: float = 0.5) -> DataFrame:
    """Words with at least that share of their area inside the zone grown by a third of its height on all sides."""
    w, z = Box.of("w_"), Box.of()
    grow = z.h / 3
    grown = Box(z.x - grow, z.y - grow, z.w + 2 * grow, z.h + 2 * grow)
    return meeting(words, zones, doc, extent(w), extent(grown)).filter(overlap(w, grown) >= least * w.area)


def nearest_by_x(left: DataFrame, right: DataFrame, doc: str, key: str, most: float, value: str, ordinal: str, default: Column) -> DataFrame:
    """(doc, key, value): the first right row, in order, whose r_cx lies within `most` of cx; else the default."""
    zero = F.lit(0.0)
    across = lambda c, reach: (F.col(c) - reach, zero, F.col(c) + reach, zero)
    on = meeting(left.select(doc, key, "cx"), right, doc, across("cx", most), across("r_cx", 0.0)).filter(F.abs(F.col("cx") - F.col("r_cx")) < most)
    first = on.groupBy(doc, key).agg(F.min(F.struct(ordinal, value)).alias("m"))
    return left.select(doc, key, default.alias("d")).join(first.hint("merge"), [doc, key], "left").select(doc, key, F.coalesce(F.col("m")[value], F.col("d")).alias(value))


def band_members(elements: DataFrame, doc: str, key: str, low: float, high: float, most: int) -> DataFrame:
    """The first so many elements of a document, from left to right, whose centre lies in the band."""
    from pyspark.sql import Window

    b = Box.of()
    order = Window.partitionBy(doc).orderBy("x", key)
    return elements.filter(b.cy.between(low, high)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def covered_anti(small: DataFrame, large: DataFrame, doc: str, key: str, *, share: float = 0.8) -> DataFrame:
    """Small boxes that don't lie inside a large one of the document by that share."""
    s, b = Box.of(), Box.of("l_")
    hidden = meeting(small.select(doc, key, *"xywh"), prefixed(large.select(doc, *"xywh"), "l_", [doc]), doc, extent(s), extent(b)).filter(covered_by(s, b) >= share).select(doc, key).distinct()
    return small.join(hidden.hint("merge"), [doc, key], "left_anti")


def mark_to_row(marks: DataFrame, rows: DataFrame, doc: str, mark: str, row: str, slack: float) -> DataFrame:
    """(doc, mark, row): the first row, in order, whose y-band with slack holds the mark's centre cy."""
    zero = F.lit(0.0)
    on = meeting(marks.select(doc, mark, "cy"), rows.select(doc, row, "y0", "y1"), doc, (zero, F.col("cy"), zero, F.col("cy")), (zero, F.col("y0") - slack, zero, F.col("y1") + slack))
    return on.groupBy(doc, mark).agg(F.min(row).alias(row))


def neighbour_text(elements: DataFrame, texts: DataFrame, doc: str, key: str, text: str, gap: float) -> DataFrame:
    """(doc, key, text): the nearest text box above that overlaps in x, no further than the gap."""
    e, t = Box.of(), Box.of("t_")
    away = e.y - t.y - t.h
    near = meeting(elements, prefixed(texts, "t_", [doc]), doc, (e.x, e.y - gap, e.x + e.w, e.y), extent(t))
    on = near.filter((away >= 0) & (away <= gap) & (t.x < e.x + e.w) & (e.x < t.x + t.w))
    return on.groupBy(doc, key).agg(F.min_by("t_" + text, F.struct(away, F.col("t_" + text))).alias(text))


def method_grid(expected: DataFrame, results: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every expected row with its result, "pending" where there is none."""
    return expected.join(results.hint("merge"), on, "left").withColumn("status", F.when(F.col(value).isNull(), "pending").otherwise("done"))


def attach_text(pred: DataFrame, gold: DataFrame, matched: DataFrame, pred_key: str, gold_key: str) -> DataFrame:
    """Predictions with the text of the gold element they match, else their own."""
    found = matched.join(gold.select(gold_key, F.col("text").alias("gold_text")).hint("merge"), gold_key).select(pred_key, "gold_text")
    return pred.join(found.hint("merge"), pred_key, "left").withColumn("text", F.coalesce("gold_text", "text")).drop("gold_text")


def same_line_pairs(strokes: DataFrame, doc: str, key: str, gap: float) -> DataFrame:
    """Pairs a < b of boxes on one line: their y-ranges overlap by half the lower height, and the gap in x is small."""
    a, b = Box.of("a_"), Box.of("b_")
    wide = (a.x - gap, a.y, a.x + a.w + gap, a.y + a.h)
    on = meeting(prefixed(strokes, "a_", [doc]), prefixed(strokes, "b_", [doc]), doc, wide, extent(b)).filter(F.col("a_" + key) < F.col("b_" + key))
    common = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    apart = F.greatest(a.x, b.x) - F.least(a.x + a.w, b.x + b.w)
    return on.filter((common >= 0.5 * F.least(a.h, b.h)) & (apart < gap)).select(doc, F.col("a_" + key).alias("a"), F.col("b_" + key).alias("b"))


def step_to_stroke(steps: DataFrame, strokes: DataFrame, doc: str, key: str) -> DataFrame:
    """Strokes with the class and group of the drawing step that lists them; "shape" and -1 where none does."""
    listed = steps.select(doc, F.explode("strokes").alias(key), "cls", "grp")
    return strokes.join(listed.hint("merge"), [doc, key], "left").withColumns({"cls": F.coalesce("cls", F.lit("shape")), "grp": F.coalesce("grp", F.lit(-1))})
