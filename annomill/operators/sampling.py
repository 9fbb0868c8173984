"""Splits, samples, augmentation and corruption. Every draw depends on a seed and the row's key alone (never on partitions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomill.functions.numeric import gauss, hash32, hash_bucket, poisson, poisson_of, uniform
from annomill.session import stored


def split_by_entity(df: DataFrame, entity: str, train: int = 80, val: int = 10) -> DataFrame:
    b = hash_bucket(F.col(entity).cast("string"))
    return df.withColumn("split", F.when(b < train, "train").when(b < train + val, "val").otherwise("test"))


def freeze_split(entities: DataFrame, registry: DataFrame, entity: str, held_out: int = 40) -> DataFrame:
    """The registry with new entities added; an entity keeps the split it got first."""
    new = entities.select(entity).distinct().join(registry.select(entity), entity, "left_anti")
    new = new.withColumn("split", F.when(hash_bucket(F.col(entity).cast("string")) < held_out, "test").otherwise("train"))
    return registry.select(entity, "split").unionByName(new)


def leakage_audit(df: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """Entities in more than one split."""
    return df.groupBy(entity).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def bernoulli(rate: float, seed: str, *key: Column) -> Column:
    return uniform(seed, *key) < rate


def choose_k(df: DataFrame, group: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group without replacement."""
    mark = hash32(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(mark, key))).filter(F.col("__r") <= k).drop("__r")


def weighted_choice(df: DataFrame, weights: DataFrame, row: str, kind: str, p: str, u: Column) -> DataFrame:
    """A class for each row by the shares of its row in `weights`: the first whose cumulated share exceeds the draw."""
    w = Window.partitionBy(row).orderBy(kind)
    ranges = weights.withColumn("__hi", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = ranges.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("__hi", F.col(kind).alias("c")))).alias("__w"))
    drawn = df.withColumn("__u", u).join(lists, row, "left")
    hit = F.filter("__w", lambda x: x["__hi"] > F.col("__u"))
    return drawn.withColumn("chosen", F.coalesce(F.get(hit, F.lit(0))["c"], F.element_at("__w", -1)["c"])).drop("__u", "__w")


def with_poisson(df: DataFrame, rate: float, seed: str, key: str) -> DataFrame:
    """One row per injected event, numbered from 0."""
    n = poisson(rate, uniform(seed, F.col(key)))
    return df.withColumn("__n", n).filter("__n > 0").withColumn("event", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def typo(text: Column, rate: float | Column, seed: str, key: Column) -> Column:
    """Each character deleted, replaced or followed by another, each at a third of the rate."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def change(c: Column, i: Column) -> Column:
        u = uniform(seed, key, i)
        other = F.substring(F.lit(letters), (F.floor(uniform(seed + "/c", key, i) * 26) + 1).cast("int"), F.lit(1))
        return F.when(u < rate / 3, "").when(u < 2 * rate / 3, other).when(u < rate, F.concat(c, other)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), change), "")


def corrupt_elements(elements: DataFrame, rates: DataFrame, confusions: DataFrame, *, key: str, seed: str, jitter: float, cer: float, strength: float = 1.0) -> DataFrame:
    """Misses and confusions by type, shifted boxes and changed texts; strength 0 changes nothing.

    rates: (type, miss_rate); confusions: (type, other, p), p the share of rows of the type that become the other.
    """
    kept = elements.join(rates, "type", "left").filter(uniform(seed + "/miss", F.col(key)) >= F.coalesce("miss_rate", F.lit(0.0)) * strength).drop("miss_rate")
    w = Window.partitionBy("type").orderBy("other")
    ranges = confusions.withColumn("hi", F.sum(F.col("p") * strength).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = ranges.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("hi", "other"))).alias("__c"))
    hit = F.get(F.filter("__c", lambda x: x["hi"] > uniform(seed + "/type", F.col(key))), F.lit(0))
    kept = kept.join(lists, "type", "left").withColumn("type", F.coalesce(hit["other"], "type")).drop("__c")
    if strength:
        kept = kept.withColumns({k: F.col(k) + jitter * strength * gauss(f"{seed}/{k}", F.col(key)) for k in "xywh"})
        kept = kept.withColumn("text", typo(F.col("text"), cer * strength, seed + "/text", F.col(key)))
    return kept.select(*elements.columns)


def missing_text(elements: DataFrame, *, key: str, seed: str, rate: float) -> DataFrame:
    """Texts go at the rate."""
    return elements.withColumn("text", F.when(uniform(seed + "/gone", F.col(key)) >= rate, F.col("text")))


def add_false_positives(elements: DataFrame, frames: DataFrame, mix: DataFrame | dict, *, doc: str, seed: str, per_sketch: float | Column, largest: float | None = None, first: int = 10_000) -> DataFrame:
    """elements and invented ones: of each sketch with frames a Poisson number, each in a frame and of a type drawn by hash.

    frames: doc, frame_id, ord (from 0), x, y, w, h; mix: (type, p), the shares of types, as a table or types with their weights;
    per_sketch: the mean, or of the sketch's frames' columns, at most `largest`. An invented element is 0.04 to 0.2 of the
    frame wide and four tenths as high, in the frame's first nine tenths across; its element_id counts from `first`. Without
    types nothing is added. Columns besides are null.
    """
    draw = lambda what: uniform(f"{seed}/fp/{what}", F.col(doc), F.col("event"))
    if isinstance(per_sketch, Column):
        counts = frames.groupBy(doc).agg(F.count("*").alias("__frames"), F.max(per_sketch).alias("__rate"))
        number = poisson_of(F.col("__rate"), uniform(seed + "/fp", F.col(doc)), largest)
        some = counts.withColumn("__n", number).filter("__n > 0").withColumn("event", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "__rate")
    else:
        counts = frames.groupBy(doc).agg(F.count("*").alias("__frames"))
        some = with_poisson(counts.filter("__frames > 0"), per_sketch, seed + "/fp", doc)
    if isinstance(mix, dict):
        typed = some.withColumn("chosen", _by_share(mix, draw("type")))
    else:
        typed = weighted_choice(some.withColumn("__any", F.lit(0)), mix.select(F.lit(0).alias("__any"), F.col("type").alias("kind"), F.col("p").alias("share")), "__any", "kind", "share", draw("type")).filter("chosen IS NOT NULL")
    placed = typed.withColumn("ord", F.floor(draw("frame") * F.col("__frames")).cast("long"))
    at = frames.select(doc, F.col("ord").cast("long").alias("ord"), "frame_id", *(F.col(c).alias("__" + c) for c in "xywh"))
    size = 0.04 + 0.16 * draw("size")
    made = placed.join(at.hint("merge"), [doc, "ord"]).select(
        doc, "frame_id", (F.lit(first) + F.col("event")).cast("long").alias("element_id"), F.col("chosen").alias("type"), (F.col("__x") + 0.9 * draw("x") * F.col("__w")).alias("x"), (F.col("__y") + 0.95 * draw("y") * F.col("__h")).alias("y"),
        (size * F.col("__w")).alias("w"), (size * F.col("__w") * 0.4).alias("h"),
    )
    return elements.unionByName(made.select(*(F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in elements.dtypes)))


#: Frames of a document up to which each of its elements looks at all of them.
FEW_FRAMES = 64


def by_frames(frames: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    """Frames of documents of up to FEW_FRAMES, and those of the others, or None where there are none."""
    many = stored(frames.groupBy(doc).agg(F.count("*").alias("n")).filter(F.col("n") > FEW_FRAMES).select(doc), "many")
    if many.isEmpty():
        return frames, None
    return frames.join(many.hint("merge"), doc, "left_anti"), frames.join(many.hint("merge"), doc, "left_semi")


def noisy_copy(elements: DataFrame, frames: DataFrame, strengths: DataFrame, noise: dict, *, doc: str, key: str, seed: str, strongest: float = 1.5) -> DataFrame:
    """elements as a recogniser with these errors would read them, each document at its own strength, which scales every rate (0: nothing changes).

    elements: doc, frame_id, key (a number), type, x, y, w, h, text; frames: doc, frame_id, ord (from 0), x, y, w, h; strengths: (doc, strength), of at most
    `strongest`; a document without one has strength 0. noise: miss_rate (type to rate), confusion (type to types and their weights),
    box_offset_std (share of the frame's width), missing_text, cer, false_positives_per_sketch, false_positive_types (types and their weights);
    it grows with the types alone. A text that typing errors leave nothing of stays as it was.
    """
    drawn = lambda what: uniform(f"{seed}/{what}", F.col(doc), F.col(key))
    few, large = by_frames(frames, doc)
    rows = elements.join(strengths.select(doc, F.col("strength").alias("__s")).hint("merge"), doc, "left").withColumn("__s", F.coalesce("__s", F.lit(0.0)))
    lists = few.groupBy(doc).agg(F.collect_list(F.struct("frame_id", "w")).alias("__f"))  # elements are shuffled by document alone
    rows = rows.join(lists.hint("merge"), doc, "left").withColumn("__wide", F.get(F.filter("__f", lambda f: f["frame_id"] == F.col("frame_id")), F.lit(0))["w"])
    if large is not None:
        wide = large.select(doc, "frame_id", F.col("w").alias("__large"))
        rows = rows.join(wide.hint("merge"), [doc, "frame_id"], "left").withColumn("__wide", F.coalesce("__wide", "__large"))
    missed = F.coalesce(*(F.when(F.col("type") == t, p) for t, p in noise["miss_rate"].items()), F.lit(0.0))
    rows = rows.filter(drawn("miss") >= F.col("__s") * missed)
    swaps = [F.when(F.col("type") == t, _by_share(w, drawn("type"))) for t, w in noise["confusion"].items() if w]
    swapped = F.when(drawn("swap") < F.col("__s"), F.coalesce(*swaps, F.lit(None).cast("string")))
    shift = F.col("__s") * noise["box_offset_std"] * F.coalesce("__wide", F.lit(360.0))
    moved = {c: F.col(c) + shift * gauss(f"{seed}/{c}", F.col(doc), F.col(key)) for c in "xywh"}
    typed = F.coalesce(F.nullif(F.trim(typo(F.col("text"), F.col("__s") * noise["cer"], seed + "/text", F.concat_ws(":", doc, key))), F.lit("")), F.col("text"))
    text = F.when(drawn("gone") >= F.col("__s") * noise["missing_text"], typed)
    rows = rows.withColumns({"type": F.coalesce(swapped, F.col("type")), "x": moved["x"], "y": moved["y"], "w": F.greatest(F.lit(1.0), moved["w"]), "h": F.greatest(F.lit(0.0), moved["h"]), "text": F.when(F.col("__s") == 0, F.col("text")).otherwise(text)})
    rows, rate = rows.select(*elements.columns), noise["false_positives_per_sketch"]
    if not rate or not noise["false_positive_types"]:
        return rows
    known = frames.join(strengths.select(doc, "strength").hint("merge"), doc)
    return add_false_positives(rows, known, noise["false_positive_types"], doc=doc, seed=seed, per_sketch=F.col("strength") * rate, largest=strongest * rate)


def _by_share(weights: dict[str, float], u: Column) -> Column:
    """A key of the weights by its share, for a draw."""
    whole, total, out = sum(weights.values()), 0.0, F
    for name, w in list(weights.items())[:-1]:
        total += w
        out = out.when(u < total / whole, name)
    last = F.lit(list(weights)[-1])
    return last if out is F else out.otherwise(last)


def clean_mix(df: DataFrame, key: str, split: str, seed: str) -> DataFrame:
    """Strength of each row: in training 0 for a fifth of rows and else 0.5 to 1.5; 1 in other splits."""
    u = uniform(seed, F.col(key))
    return df.withColumn("strength", F.when(F.col(split) != "train", 1.0).when(u < 0.2, 0.0).otherwise(0.5 + uniform(seed + "/s", F.col(key))))


def augment_children(nodes: DataFrame, extra: list[tuple[str, float]], *, doc: str, order: str, kind: str, seed: str, most: int = 40, swap: tuple[str, str, float] | None = None) -> DataFrame:
    """(doc, ord, kind): each extra kind is appended to a document at its rate, and with swap (old, new, rate) a document's nodes of
    one kind become another at its rate; then places are counted anew, up to `most`."""
    docs = nodes.select(doc).distinct()
    rows = nodes.select(doc, F.lit(0).alias("__late"), F.col(order).cast("long").alias("__o"), F.col(kind).alias(kind))
    if swap:
        old, new, rate = swap
        rows = rows.withColumn(kind, F.when((F.col(kind) == old) & (uniform(f"{seed}/{old}-{new}", F.col(doc)) < rate), new).otherwise(F.col(kind)))
    for k, (name, rate) in enumerate(extra):
        rows = rows.unionByName(docs.filter(uniform(f"{seed}/{name}", F.col(doc)) < rate).select(doc, F.lit(k + 1).alias("__late"), F.lit(0).cast("long").alias("__o"), F.lit(name).alias(kind)))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(doc).orderBy("__late", "__o", kind)) - 1).filter(F.col("ord") < most).drop("__o", "__late")


def add_links(nodes: DataFrame, screens: DataFrame, *, doc: str, key: str, screen: str, kinds: list[str], seed: str) -> DataFrame:
    """(doc, key, go): one or two navigable nodes of each screen link to another screen of the document.

    Screens stand in a ring in order; a node's link goes a hash-chosen number of places further, never back to its own.
    """
    ring = screens.select(doc, screen, (F.row_number().over(Window.partitionBy(doc).orderBy(screen)) - 1).alias("__k"))
    ring = ring.withColumn("__n", F.count("*").over(Window.partitionBy(doc)))
    picked = choose_k(nodes.filter(F.col("type").isin(kinds)), [doc, screen], key, 2, seed).join(ring.filter("__n > 1"), [doc, screen])
    second = F.row_number().over(Window.partitionBy(doc, screen).orderBy(hash32(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)) == 2
    picked = picked.withColumn("__second", second).filter(~F.col("__second") | (uniform(seed + "/two", F.col(doc), F.col(screen)) < 0.5))
    step = 1 + hash32(F.concat_ws(":", F.lit(seed + "/to"), F.col(key).cast("string"))) % (F.col("__n") - 1)
    to = ring.select(doc, F.col("__k").alias("__to"), F.col(screen).alias("go"))
    return picked.withColumn("__to", (F.col("__k") + step) % F.col("__n")).join(to, [doc, "__to"]).select(doc, key, "go")
