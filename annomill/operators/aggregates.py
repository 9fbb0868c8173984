"""Aggregations: counts, quantiles, detection and bag metrics, error rates, votes. All combine before the shuffle where Spark can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomill.session import stored

from .folds import grouped


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts, the most frequent first (ties: by key)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def split_summary(df: DataFrame, split: str, entity: str, ok: Column) -> DataFrame:
    """Rows, distinct entities, good and failed rows of each split."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, first, n, total): each distinct value of a group, the place of its first row, its rows and the group's.

    Equal values are one row before the shuffle; distinct ones are cut into ranges, counted range by range, and the ranges
    before are added. So neither a group nor a frequent value is one task's work.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, value).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"))  # a row per group and range
    w = Window.partitionBy(*keys)
    base = sums.withColumns({"__base": F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("__n").over(w)}).drop("__n")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__in", inside).join(base.hint("shuffle_hash"), [*keys, "__range"]).select(*keys, value, (F.col("__base") + F.col("__in")).alias("first"), "n", "total")


def at_shares(ranked: DataFrame, keys: list[str], value: str, at: dict[str, float], **more: Column) -> DataFrame:
    """Exact quantiles of ranks() with linear interpolation, and further aggregates over the distinct values."""
    def of(q: float) -> Column:
        place = q * (F.col("total") - 1)
        pick = lambda p: F.max(F.when((F.col("first") <= p) & (p < F.col("first") + F.col("n")), F.col(value)))
        low, high = pick(F.floor(place)), pick(F.ceil(place))
        return low + (high - low) * (q * (F.max("total") - 1) - F.floor(q * (F.max("total") - 1)))

    return ranked.groupBy(*keys).agg(*(of(q).alias(name) for name, q in at.items()), *(c.alias(name) for name, c in more.items()))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, and the maximum; NaN values don't count."""
    return at_shares(ranks(df.filter(~F.isnan(value) & F.col(value).isNotNull()), keys, value), keys, value, at, most=F.max(value))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place n // 2 of the sorted ones, without interpolation."""
    place = F.floor(F.col("total") / 2)
    return ranks(df, keys, value).filter((F.col("first") <= place) & (place < F.col("first") + F.col("n"))).select(*keys, F.col(value).alias("median"))


def class_share(df: DataFrame, key: str) -> DataFrame:
    """Share of each class of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def label_pool(labels: DataFrame, text: str, *, words: int = 2, limit: int = 5000) -> DataFrame:
    """Frequent short labels of letters and spaces, by count, then alphabetically."""
    short = labels.filter(F.col(text).rlike("^[A-Za-z]+( [A-Za-z]+)*$") & (F.size(F.split(text, " ")) <= words))
    return count_by(short, text).limit(limit)


def prf(df: DataFrame, tp: str, pred: str, gold: str) -> DataFrame:
    """Precision, recall and F1 of summed counts; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = df.agg(*(F.sum(c).cast("double").alias(c) for c in (tp, pred, gold)))
    p, r = ratio(F.col(tp), F.col(pred)), ratio(F.col(tp), F.col(gold))
    return sums.select(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def confusion(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    return pairs.groupBy(gold, pred).agg(F.count("*").alias("n"))


def type_accuracy(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    return pairs.groupBy(gold).agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))


def sequence_accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Accuracy place by place over arrays; sequences of unequal lengths are an error."""
    checked = df.withColumn("__z", F.when(F.size(gold) == F.size(pred), F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p"))).otherwise(F.raise_error(F.lit("lengths differ"))))
    return checked.select(F.explode("__z").alias("z")).agg(F.count("*").alias("n"), F.avg((F.col("z.g") == F.col("z.p")).cast("double")).alias("accuracy"))


def bag_overlap(gold: DataFrame, pred: DataFrame, docs: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, common, n_gold, n_pred) of two bags for every document asked for."""
    counts = lambda df, n: df.groupBy(doc, item).agg(F.count("*").alias(n))
    both = counts(gold, "g").join(counts(pred, "p"), [doc, item], "full").na.fill(0, ["g", "p"])
    sums = both.groupBy(doc).agg(F.sum(F.least("g", "p")).alias("common"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    return docs.select(doc).distinct().join(sums, doc, "left").na.fill(0, ["common", "n_gold", "n_pred"])


def multiset_f1(gold: DataFrame, pred: DataFrame, docs: DataFrame, doc: str, item: str) -> DataFrame:
    """F1 of two bags per document; 1 if both are empty."""
    n = F.col("n_gold") + F.col("n_pred")
    return bag_overlap(gold, pred, docs, doc, item).select(doc, F.when(n == 0, 1.0).otherwise(2 * F.col("common") / n).alias("f1"))


def multiset_recall(gold: DataFrame, pred: DataFrame, docs: DataFrame, doc: str, item: str) -> DataFrame:
    """Share of the gold bag found; 1 if it is empty."""
    return bag_overlap(gold, pred, docs, doc, item).select(doc, F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("common") / F.col("n_gold")).alias("recall"))


def mean_defined(df: DataFrame, *metrics: str) -> DataFrame:
    """Mean of each metric over rows where it is defined, and how many these are."""
    return df.agg(*(x for m in metrics for x in (F.avg(m).alias(m), F.count(m).alias("n_" + m))))


def noise_offsets(pairs: DataFrame, unit: Column | float) -> DataFrame:
    """Population deviation of box offsets over matched pairs, relative to the unit (a number, or each pair's frame width)."""
    diff = [(F.col("p_" + k) - F.col(k)) / unit for k in "xywh"]
    values = F.explode(F.array(*diff)).alias("d")
    return pairs.select(values).agg(F.stddev_pop("d").alias("box_std"))


def miss_rates(gold: DataFrame, matched: DataFrame, key: str, kind: str) -> DataFrame:
    """Share of gold rows of each kind without a match."""
    hit = matched.select(key, F.lit(1).alias("__hit"))
    return gold.join(hit.hint("merge"), key, "left").groupBy(kind).agg(F.avg(F.col("__hit").isNull().cast("double")).alias("miss_rate"))


def false_positives(pred: DataFrame, matched: DataFrame, both: DataFrame, doc: str, key: str, kind: str) -> DataFrame:
    """(kind, n, share, per_sketch) of predictions without a match, in documents that have both sides (a table of their numbers).

    share is the kind's part of all false positives, per_sketch all of them over the number of such documents, so that the
    report has the same number in each row. No row where there are none.
    """
    here = both.select(doc).distinct()
    extra = pred.select(doc, key, kind).join(here.hint("merge"), doc, "left_semi").join(matched.select(key).hint("merge"), key, "left_anti")
    counts = extra.groupBy(kind).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row a kind by now
    sketches = here.agg(F.count("*").alias("__sketches"))
    return counts.withColumn("share", F.col("n") / total).join(F.broadcast(sketches)).select(kind, "n", "share", (total / F.col("__sketches")).alias("per_sketch"))


def row_shares(counts: DataFrame, row: str, n: str = "n") -> DataFrame:
    """Each count's share of its row's total."""
    return counts.withColumn("p", F.col(n) / F.sum(n).over(Window.partitionBy(row)))


def pool_argmax(probabilities: DataFrame, group: list[str], kind: str, p: str) -> DataFrame:
    """Class with the largest summed probability per group (ties: the first class)."""
    sums = probabilities.groupBy(*group, kind).agg(F.sum(p).alias("s"))
    return sums.groupBy(*group).agg(F.min_by(kind, F.struct(-F.col("s"), F.col(kind))).alias(kind), F.max("s").alias("score"))


def class_vote(hits: DataFrame, key: list[str], group: str, kind: str, at: str, *, least: float = 0.5, hit: str = "hit") -> DataFrame:
    """(key, vote, kind): the group by majority_vote, and the most common class of the hits within it (ties: the one seen first); null for noise."""
    groups = majority_vote(hits, key, group, at, least=least, hit=hit)
    counts = hits.filter(hit).groupBy(*key, F.col(group).cast("string").alias("vote"), kind).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    best = counts.groupBy(*key, "vote").agg(F.max_by(kind, F.struct(F.col("n"), -F.col("first"))).alias(kind))
    return groups.join(best.hint("merge"), [*key, "vote"], "left").select(*key, "vote", kind)


def majority_vote(hits: DataFrame, key: list[str], group: str, at: str, *, least: float = 0.5, hit: str = "hit") -> DataFrame:
    """Most common group among hits (ties: the one seen first); "noise" under that share of hits."""
    counts = hits.groupBy(*key, group).agg(F.count_if(F.col(hit)).alias("n"), F.min(F.when(F.col(hit), F.col(at))).alias("first"), F.count("*").alias("all"))
    best = F.max_by(group, F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy(*key).agg(F.when(F.sum("n") / F.sum("all") < least, F.lit("noise")).otherwise(best.cast("string")).alias("vote"))


def bbox_union(df: DataFrame, keys: list[str]) -> DataFrame:
    """The box around boxes x, y, w, h, rounded to a tenth, halves up. What binary sums and differences add beyond six places doesn't count."""
    low, tenth = {k: F.min(k) for k in "xy"}, lambda v: F.round(F.round(v, 6), 1)
    side = lambda at, size: tenth(F.max(F.col(at) + F.col(size)) - low[at]).alias(size)
    return df.groupBy(*keys).agg(tenth(low["x"]).alias("x"), tenth(low["y"]).alias("y"), side("x", "w"), side("y", "h"))


def stage_latency(df: DataFrame, stage: str, ms: str) -> DataFrame:
    return at_shares(ranks(df.select(stage, ms), [stage], ms), [stage], ms, {"median_ms": 0.5}, n=F.max("total"))


def stage_latency_map(df: DataFrame, times: str, stages: list[str]) -> DataFrame:
    """Median per stage of a map of microseconds, in milliseconds; a listed stage missing from a map counts 0."""
    dense = F.map_concat(F.map_from_arrays(F.array(*map(F.lit, stages)), F.array(*(F.coalesce(F.try_element_at(times, F.lit(s)), F.lit(0).cast("bigint")) for s in stages))))
    times_ms = df.select(F.explode(dense).alias("stage", "us")).select("stage", (F.col("us") / 1000).alias("ms"))
    return at_shares(ranks(times_ms, ["stage"], "ms"), ["stage"], "ms", {"median_ms": 0.5})


def fallback_counts(df: DataFrame, stage: str, fell_back: str) -> DataFrame:
    return df.groupBy(stage).agg(F.count_if(F.col(fell_back)).alias("fallbacks"), F.count("*").alias("n"))


def two_ratios(df: DataFrame, part: str, whole: str) -> DataFrame:
    """The ratio of sums and the mean of ratios."""
    return df.agg((F.sum(part) / F.sum(whole)).alias("ratio_of_sums"), F.avg(F.try_divide(F.col(part), F.col(whole))).alias("mean_of_ratios"))


def number_summary(df: DataFrame, value: str) -> DataFrame:
    weighted = F.sum(F.col(value) * F.col("n")) / F.max("total")
    ranked = ranks(df.filter(F.col(value).isNotNull()), [], value)
    return at_shares(ranked, [], value, {"median": 0.5}, n=F.coalesce(F.max("total"), F.lit(0)), mean=weighted, most=F.max(value), least=F.min(value))


def pipeline_rates(df: DataFrame, valid: Column, error: str, most: int = 10) -> DataFrame:
    """Share of valid inputs, and the first so many distinct errors in order."""
    return df.agg(F.avg(valid.cast("double")).alias("valid"), F.array_join(F.slice(F.array_sort(F.collect_set(error)), 1, most), ",").alias("errors"))


def leaf_count(nodes: DataFrame, doc: str, node: str, parent: str) -> DataFrame:
    """Nodes without children per document."""
    parents = nodes.select(doc, F.col(parent).alias(node)).filter(F.col(node).isNotNull()).distinct()
    return nodes.join(parents, [doc, node], "left_anti").groupBy(doc).agg(F.count("*").alias("leaves"))


def _hull(p: np.ndarray) -> np.ndarray:
    """Rows of the corners of the convex hull; p is sorted by its first two columns, x and y."""
    sides = []
    for side in (p, p[::-1]):
        kept: list[np.ndarray] = []
        for q in side:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (q[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (q[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(q)
        sides += kept[:-1]
    return np.array(sides)


def farthest(points: list[tuple[float, float]]) -> tuple[int, int, float] | None:
    """Places and squared distance of the two points that are farthest apart (ties: the first pair). Of many points only corners of the convex hull are compared, one with all at a time."""
    if len(points) < 2:
        return None
    if len(points) <= 24:
        best = (0, 1, -1.0)
        for i, (x, y) in enumerate(points):
            for j in range(i + 1, len(points)):
                u, v = points[j]
                d = (x - u) * (x - u) + (y - v) * (y - v)
                if d > best[2]:
                    best = (i, j, d)
        return best
    first: dict[tuple, int] = {}
    for k, at in enumerate(points):
        first.setdefault(at, k)
    if len(first) == 1:
        return 0, 1, 0.0
    p = np.column_stack([np.array(list(first), float), list(first.values())])
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = _hull(p) if len(p) > 3 else p
    most, pair = -1.0, (0, 1)
    for q in p:
        d2 = (p[:, 0] - q[0]) ** 2 + (p[:, 1] - q[1]) ** 2
        own = min((min(int(q[2]), int(k)), max(int(q[2]), int(k))) for k in p[d2 == d2.max(), 2])
        most, pair = max((most, pair), (float(d2.max()), own), key=lambda m: (m[0], (-m[1][0], -m[1][1])))
    return *pair, most


def farthest_pair(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, i, j, d2): the two points of a group that are farthest apart (ties: the first pair in order). Points without an x or y don't count."""
    kind = dict(points.dtypes)[order]

    def make(rows: list[tuple]) -> list[tuple]:
        far = farthest([r[1:] for r in rows])
        return [(rows[far[0]][0], rows[far[1]][0], far[2])] if far else []

    whole = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return grouped(whole, keys, [order], [order, "x", "y"], {"i": kind, "j": kind, "d2": "double"}, make)


def type_coverage(df: DataFrame, doc: str, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count_distinct(doc).alias("docs"))


def sketch_unit(frames: DataFrame, ink: DataFrame, doc: str) -> DataFrame:
    """Origin and scale of each sketch: from its frames, else from the box of its ink; the scale is at least 0.001."""
    f = frames.groupBy(doc).agg(F.min("x").alias("fx"), F.min("y").alias("fy"), (F.percentile("h", 0.5) / 2).alias("fu"))
    i = ink.groupBy(doc).agg(F.min("x").alias("ix"), F.min("y").alias("iy"), ((F.max("y") - F.min("y")) / 2).alias("iu"))
    both = i.join(f, doc, "full")
    return both.select(doc, F.coalesce("fx", "ix").alias("ox"), F.coalesce("fy", "iy").alias("oy"), F.greatest(F.coalesce("fu", "iu"), F.lit(1e-3)).alias("unit"))


def element_records(strokes: DataFrame, doc: str, group: str, stroke: str) -> DataFrame:
    """Box and sorted strokes of each labelled group."""
    ids = strokes.groupBy(doc, group).agg(F.array_join(F.array_sort(F.collect_list(stroke)), ",").alias("strokes"))
    return bbox_union(strokes, [doc, group]).join(ids, [doc, group])


def paired_subset(scores: DataFrame, other: DataFrame, key: str, *metrics: str) -> DataFrame:
    """Means over the rows that another method covered."""
    return mean_defined(scores.join(other.select(key).distinct(), key, "left_semi"), *metrics)
