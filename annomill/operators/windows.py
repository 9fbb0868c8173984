"""Window operators and order-dependent folds. Folds carry a small state over sorted rows (folds.carried), so no document is held whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomill.functions.text import slug
from annomill.session import stored

from .folds import carried, folded


def bands(df: DataFrame, doc: str, key: str, low: str, high: str, slack: Column, keep: list[str] = ()) -> DataFrame:
    """(doc, key, band, n_bands) and kept columns: sorted by low; a new band starts when the reach of the band before, less low, is within the slack.

    The reach is the running maximum of high within a band and starts again with it, so this is a fold, not a running window.
    A row without a low or a slack stays in the band before it (the first one at the start), one without a high doesn't move the reach.
    """
    rows = df.select(doc, key, *keep, F.col(low).cast("double").alias("__lo"), F.col(high).cast("double").alias("__hi"), slack.cast("double").alias("__slack"))

    def step(state, lo, hi, slack):
        band, reach = state
        high = float("-inf") if hi is None else hi
        if lo is None or slack is None:
            return (max(band, 0), max(reach, high)), (max(band, 0),)
        if reach - lo <= slack:
            return (band + 1, high), (band + 1,)
        return (band, max(reach, high)), (band,)

    found = carried(rows, [doc], ["__lo", key], ["__lo", "__hi", "__slack"], {"band": "int"}, lambda: (-1, float("-inf")), step)
    return found.withColumn("n_bands", F.max("band").over(Window.partitionBy(doc)) + 1).select(doc, key, *keep, "band", "n_bands")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with the number of the run of equal values they belong to."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def collapse_runs(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """One row per run: its value and its length, cut at most."""
    return islands(df, keys, order, value).groupBy(*keys, "island").agg(F.first(value).alias(value), F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))


def group_runs_capped(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """Runs cut into parts of at most so many rows."""
    runs = islands(df, keys, order, value)
    place = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)) - 1
    return runs.withColumn("part", F.floor(place / most).cast("int"))


def row_group(df: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, key, row): sorted by y; an element joins the last row if it overlaps it by half the lower height, and the row grows.

    Elements without a y come first; one without a y or a height is in row 0 or the row before it, and doesn't grow it.
    """
    def step(state, y, h):
        row, y0, y1 = state
        if y is None or h is None:
            return (max(row, 0), y0, y1), (max(row, 0),)
        if row >= 0 and min(y1, y + h) - max(y0, y) > 0.5 * min(h, y1 - y0):
            return (row, min(y0, y), max(y1, y + h)), (row,)
        return (row + 1, y, y + h), (row + 1,)

    return carried(df.select(doc, key, "x", "y", "h"), [doc], ["y", "x", key], ["y", "h"], {"row": "int"}, lambda: (-1, 0.0, 0.0), step).select(doc, key, "row")


def dedupe_names(df: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """(doc, order, name, title): slugs of titles, unique in the document by suffixes _2, _3 and so on.

    The k-th row of a slug gets suffix _k. Only where such a name is another title's own slug does the order of all rows
    matter; those documents alone are numbered row by row.
    """
    place = Window.partitionBy(doc).orderBy(order)
    named = df.select(doc, order, F.when(F.coalesce(title, F.lit("")) != "", F.col(title)).alias("__shown")).withColumn("__number", F.row_number().over(place))
    named = named.withColumn("__shown", F.coalesce("__shown", F.concat(F.lit("Screen "), F.col("__number").cast("string"))))
    base = F.left(F.coalesce(F.nullif(slug(F.col("__shown")), F.lit("")), F.concat(F.lit("screen"), F.col("__number").cast("string"))), F.lit(28))
    named = named.withColumn("__base", base).withColumn("__turn", F.row_number().over(Window.partitionBy(doc, "__base").orderBy(order)))
    named = stored(named.withColumn("__name", F.when(F.col("__turn") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.col("__turn").cast("string")))), "named")
    own = named.filter("__turn = 1").select(doc, F.col("__base").alias("__name"))
    twice = named.filter("__turn > 1").select(doc, "__name").join(own.hint("merge"), [doc, "__name"], "left_semi").select(doc).distinct()
    kinds, shown = dict(df.dtypes), F.left("__shown", F.lit(40)).alias("title")
    plain = named.join(twice.hint("merge"), doc, "left_anti").select(doc, order, F.col("__name").alias("name"), shown)
    rest = named.join(twice.hint("merge"), doc, "left_semi").select(doc, order, F.col("__base").alias("base"), shown)
    return plain.unionByName(rest.groupBy(doc).applyInPandas(lambda pdf: _numbered(pdf, doc, order), f"{doc} {kinds[doc]}, {order} {kinds[order]}, name string, title string"))


def _numbered(pdf, doc: str, order: str):
    """A document's rows in order, each with the first name that is free."""
    pdf, used, names = pdf.sort_values(order), set(), []
    for base in pdf["base"]:
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        names.append(name)
    return pdf.assign(name=names)[[doc, order, "name", "title"]]


def renumber(df: DataFrame, doc: str, order: list, name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def reading_order(df: DataFrame, doc: str, key: str) -> DataFrame:
    """Row by row, then by x."""
    rows = row_group(df, doc, key).join(df.select(doc, key, "x").hint("merge"), [doc, key])
    return renumber(rows, doc, ["row", "x", key], "place").select(doc, key, "row", "place")


def lag_pause(strokes: DataFrame, doc: str, order: str, start: str, end: str) -> DataFrame:
    """Pause before each stroke and minutes since the first."""
    w = Window.partitionBy(doc).orderBy(order)
    return strokes.withColumns({"pause": F.coalesce(F.col(start) - F.lag(end).over(w), F.lit(0)), "minutes": (F.col(start) - F.first(start).over(w)) / 60000.0})


def arc_length(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distance along the points so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("__step", step).withColumn("length", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def _even(points: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """(keys, even): of each point, those (i, x, y) of n equally spaced ones that lie on the way to it from the point before.

    Each is on one such way alone: where one ends at it, not where the next begins, but for the first. On a line of no
    length the first point has all. No point is copied for the n, so rows and bytes are those of the points and the result.
    """
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    ways = arc_length(points, keys, order)
    ways = ways.withColumns({"l0": F.lag("length").over(w), "x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "total": F.max("length").over(whole), "fx": F.min_by("x", order).over(whole), "fy": F.min_by("y", order).over(whole), "k": F.row_number().over(w)})
    last = F.lit(n - 1)
    near = lambda length, more: (F.floor(F.col(length) * last / F.col("total")) + more).cast("int")
    finite = F.col("total") < float("inf")
    some = F.when(finite, F.sequence(F.greatest(near("l0", -1), F.lit(0)), F.least(near("length", 2), last))).otherwise(F.sequence(F.lit(0), last))
    at = lambda i: F.least(F.col("total") * i / (n - 1), F.col("total"))
    on = F.filter(some, lambda i: (at(i) <= F.col("length")) & ((at(i) > F.col("l0")) | ((F.col("l0") == 0) & (at(i) == 0))))
    share = lambda i: (at(i) - F.col("l0")) / (F.col("length") - F.col("l0"))
    between = lambda i, a, b: F.coalesce(F.col(a) + share(i) * (F.col(b) - F.col(a)), F.col("f" + b)).cast("double")
    moved = F.transform(on, lambda i: F.struct(i.alias("i"), between(i, "x0", "x").alias("x"), between(i, "y0", "y").alias("y")))
    still = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.col("fx").cast("double").alias("x"), F.col("fy").cast("double").alias("y")))
    even = F.when(F.col("length") > F.col("l0"), moved).when((F.col("total") == 0) & (F.col("k") == 1), still)
    return ways.select(*keys, even.alias("even")).filter(F.size("even") > 0)


def resample(points: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """(keys, i, x, y): n equally spaced points along each line, by linear interpolation; a single point is repeated.

    Places are held within the line's length, so rounding can't lose the last one.
    """
    return _even(points, keys, order, n).select(*keys, F.inline("even"))


def resampled(points: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """(keys, even): resample()'s points of each line as one array of (i, x, y)."""
    return _even(points, keys, order, n).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("even"))).alias("even"))


def direction_turns(points: DataFrame, keys: list[str], order: str, least: Column) -> DataFrame:
    """Changes of direction in y, ignoring swings under `least`; the anchor moves with each counted swing. Points without a y don't count."""
    def step(state, y, least):
        anchor, sign, turns = state
        if y is None:
            return state
        if anchor is None:
            return y, 0, turns
        d = y - anchor
        way = (d > 0) - (d < 0)
        if least is not None and abs(d) >= least:
            return y, way, turns + (sign != 0 and way != sign)
        return (y if way == sign and sign else anchor), sign, turns

    rows = points.select(*keys, order, "y", least.alias("__least"))
    return folded(rows, keys, [order], ["y", "__least"], {"turns": "int"}, lambda: (None, 0, 0), step, lambda state: state[2:])


def gap_groups(df: DataFrame, doc: str, order: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Number of the group of rows with no larger gap between neighbours."""
    w = Window.partitionBy(doc).orderBy(*order)
    new = F.coalesce((F.col(low) - F.lag(high).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def line_count(df: DataFrame, doc: str, y: str, gap: float) -> DataFrame:
    """One more than the gaps between sorted values that exceed the limit."""
    w = Window.partitionBy(doc).orderBy(y)
    return df.withColumn("__gap", F.col(y) - F.lag(y).over(w)).groupBy(doc).agg((F.count_if(F.col("__gap") > gap) + 1).alias("lines"))


def triples(lines: DataFrame, doc: str, key: str, slack: float, most: float) -> DataFrame:
    """Three stacked lines with equal left ends, close together; a line is in one triple at most, from the top."""
    item = F.struct("y", "x", F.col(key).alias("id"))
    start = F.struct(F.array().cast(f"array<{dict(lines.dtypes)[key]}>").alias("out"), F.lit(-1).alias("used"))

    def fold(items: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            p, q, r = (F.get(items, i + k) for k in range(3))
            good = (i > a["used"]) & (F.abs(q["x"] - p["x"]) < slack) & (F.abs(r["x"] - p["x"]) < slack) & (r["y"] - p["y"] < most)
            return F.when(F.coalesce(good, F.lit(False)), F.struct(F.concat(a["out"], F.array(p["id"])).alias("out"), (i + 2).alias("used"))).otherwise(a)

        return F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), start, step)["out"]

    sets = lines.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return sets.select(doc, F.explode(fold(F.col("items"))).alias(key))


def synthetic_time(strokes: DataFrame, doc: str, key: str, band: float, speed: float, pause: float) -> DataFrame:
    """Start times of strokes drawn in reading order: the arcs and pauses of all strokes before."""
    w = Window.partitionBy(doc).orderBy(F.floor(F.col("y") / band), "x", key)
    before = F.coalesce(F.sum(F.col("arc") / speed + pause).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return strokes.select(doc, key, before.alias("start"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Places from 0 within each group (or in the whole table), however large: rows are cut into ranges of the order, a range's rows are numbered in one task, and the ranges before are added.

    The order's columns tell the rows of a group apart, else equal rows may swap places.
    """
    ranged = stored(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))  # a row per group and range
    base = before.withColumn("__base", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1
    return ranged.withColumn("__in", inside).join(base.hint("shuffle_hash"), [*by, "__range"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__range", "__base", "__in").select(*df.columns, name)


def shard_index(df: DataFrame, split: str, order: list[str], size: int) -> DataFrame:
    """Place within the split and number of its shard. order starts with what tells rows of a split apart."""
    placed = numbered(df, [split], order)
    return placed.withColumn("shard", F.floor(F.col("place") / size).cast("int"))


def length_buckets(df: DataFrame, key: str, length: str, *, seed: str, batch: int, chunk: int) -> DataFrame:
    """Batches of similar lengths: rows are dealt by hash into chunks of about `chunk` rows, sorted by length within a chunk, and cut into batches."""
    from annomill.functions.numeric import hash32

    chunks = max(1, -(-df.count() // chunk))
    of = lambda salt, k: hash32(F.concat_ws(":", F.lit(f"{seed}/{salt}"), k.cast("string")))
    dealt = df.withColumn("chunk", (of("row", F.col(key)) % chunks).cast("int"))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(length, key)) - 1
    out = dealt.withColumn("batch", F.floor(place / batch).cast("int"))
    return out.withColumn("turn", of("batch", F.concat_ws("/", F.col("chunk"), F.col("batch"))))


def unfinished_steps(log: DataFrame, device: str, ts: str, kind: str, step: str) -> DataFrame:
    """(device, step): the last step that was started since the last launch and has no end or failure."""
    w = Window.partitionBy(device).orderBy(ts)
    life = log.withColumn("life", F.sum((F.col(kind) == "launch").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    now = life.withColumn("last", F.max("life").over(Window.partitionBy(device))).filter("life = last")
    started, ended = F.col(kind) == "start", F.col(kind).isin("end", "fail")
    # an end closes one open start of its step; what is open at the end is starts after the lowest point of the balance
    s = Window.partitionBy(device, step).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    level = now.withColumn("level", F.sum(F.when(started, 1).when(ended, -1).otherwise(0)).over(s))
    lowest = level.withColumn("floor", F.least(F.lit(0), F.min("level").over(Window.partitionBy(device, step).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = lowest.groupBy(device, step).agg(F.max_by("level", ts).alias("level"), F.max("floor").alias("floor"), F.max(F.when(started, F.col(ts))).alias("at"))
    return ends.filter("level > floor").groupBy(device).agg(F.max_by(step, "at").alias(step))


def best_so_far(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Running best and rows since it last rose."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    best = df.withColumns({"best": F.max(value).over(run), "__k": F.row_number().over(w)})
    rose = F.when(F.col("best") > F.coalesce(F.lag("best").over(w), F.lit(float("-inf"))), F.col("__k"))
    return best.withColumn("__rose", rose).withColumn("waited", F.col("__k") - F.max("__rose").over(run)).drop("__rose", "__k")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each task's rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def shuffle_take(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in an order that depends on the seed and the keys alone."""
    from annomill.functions.numeric import hash32

    return df.orderBy(hash32(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def natural_sort(names: DataFrame, name: str) -> DataFrame:
    """Names with places from 1: by what stands before a number at the end, then by the number."""
    keyed = names.withColumns({"__stem": F.regexp_replace(name, r"[0-9]+$", ""), "__number": F.try_to_number(F.regexp_extract(name, r"([0-9]+)$", 1), F.lit("9" * 18))})
    return numbered(keyed, [], ["__stem", "__number", name]).select(*names.columns, (F.col("place") + 1).alias("place"))
