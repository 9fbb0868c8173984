"""Projections and gates over records: checks with a reason, vocabularies, budgets, shapes of strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of text that take one line.
LINE_CHARS = 45


def gate(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """The first rule that holds is the row's reason, else "ok"."""
    chain = None
    for reason, rule in rules:
        chain = (F if chain is None else chain).when(F.coalesce(rule, F.lit(False)), reason)
    return df.withColumn(name, chain.otherwise("ok") if chain is not None else F.lit("ok"))


def gate_documents(nodes: DataFrame, doc: str, *, least: int = 3, most: int = 30, foreign: float = 0.3) -> DataFrame:
    """(doc, leaves, reason) from a node table (label, width, height of the root, text, is_leaf)."""
    from annomill.functions.text import is_latin

    texts = F.coalesce(F.col("text"), F.lit("")) != ""
    counts = nodes.groupBy(doc).agg(
        F.max("root_w").alias("w"), F.max("root_h").alias("h"), F.count_if(F.col("label").isin("Drawer", "Modal")).alias("overlays"),
        F.count_if(texts).alias("texts"), F.count_if(texts & ~is_latin(F.col("text"))).alias("foreign"), F.count_if(F.col("is_leaf")).alias("leaves"),
    )
    rules = [
        ("not_portrait", (F.col("w") <= 0) | (F.col("h") <= F.col("w"))),
        ("overlay", F.col("overlays") > 0),
        ("non_latin", F.col("foreign") > foreign * F.col("texts")),
        ("empty_body", F.col("leaves") == 0),
        ("too_few", F.col("leaves") < least),
        ("too_many", F.col("leaves") > most),
    ]
    return gate(counts, rules).select(doc, "leaves", "reason")


def map_vocab(c: Column, words: dict[str, str], default: str) -> Column:
    """The word's code, or the default. The table is a literal, so no join is needed."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def type_leaves(label: Column, text: Column, cls: Column, w: Column, h: Column, full_h: Column) -> Column:
    """Node type of a leaf from its label, text, class and size; a button of a class that is none is a link (null and empty classes are not looked at)."""
    name, no_button = F.lower(label), F.coalesce((cls != "") & ~cls.contains("Button"), F.lit(False))
    return (
        F.when(name.contains("button") & no_button, F.when(F.char_length(text) > 40, "para").otherwise("link"))
        .when(name.contains("text") & (F.char_length(text) > 40), "para").when(name.contains("text") & ~name.contains("button") & ~name.contains("input"), "text")
        .when(name.contains("button"), "btn").when(name.contains("input"), "input").when(name.contains("image") & (w == h) & (h < 0.1 * full_h), "avatar")
        .when(name.contains("image"), "img").when(name.contains("icon"), "icon").when(name.contains("checkbox"), "check").when(name.contains("switch"), "switch")
    )


def input_kind(hint: Column, text: Column, h: Column, full_h: Column) -> Column:
    """secure for an input whose id or text speaks of a pass or pin, multiline for a tall one, else null; nulls say nothing."""
    said = F.lower(F.concat_ws(" ", hint, text))
    return F.when(said.contains("pass") | said.contains("pin"), "secure").when(h > 0.12 * full_h, "multiline")


def para_lines(text: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.ceil(F.char_length(text) / LINE_CHARS))).cast("int")


def bucket_by_ratio(df: DataFrame, doc: str, height: str, default: float) -> DataFrame:
    """Style of each text from its height over the document's median height."""
    from pyspark.sql import Window

    ratio = F.col(height) / F.coalesce(F.percentile(height, 0.5).over(Window.partitionBy(doc)), F.lit(default))
    return df.withColumn("style", F.when(ratio >= 1.8, "h1").when(ratio >= 1.35, "h2").when(ratio <= 0.75, "caption").otherwise("body"))


def check_records(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Column problems: the messages of all checks that hold, in order."""
    found = F.array(*(F.when(F.coalesce(rule, F.lit(False)), message) for message, rule in checks))
    return df.withColumn("problems", F.filter(found, lambda m: m.isNotNull()))


def issues(nodes: DataFrame, doc: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(doc, path, code) of every rule a node breaks."""
    found = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules)), lambda c: c.isNotNull())
    return nodes.select(doc, "path", F.explode(found).alias("code"))


def duplicate_ids(nodes: DataFrame, doc: str, name: str) -> DataFrame:
    """Issues dup_id: every node but the first of its name in the document."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(doc, name).orderBy("path"))
    return nodes.filter(F.col(name).isNotNull()).withColumn("__k", place).filter("__k > 1").select(doc, "path", F.lit("dup_id").alias("code"))


def validate_nodes(nodes: DataFrame, doc: str, structural: list[tuple[str, Column]], semantic: list[DataFrame]) -> DataFrame:
    """Structural issues, and semantic ones of documents whose structure is sound."""
    broken = issues(nodes, doc, structural)
    bad = broken.select(doc).distinct()
    for s in semantic:
        broken = broken.unionByName(s.join(bad, doc, "left_anti"))
    return broken


def structural_rules(values: DataFrame, domain: DataFrame) -> DataFrame:
    """Issues of exploded (doc, path, t, key, value) against a domain table (t, key, kind, least, most).

    Unknown keys, integers out of range, strings too long or with control characters. spec_rules.validate_specs has all rules.
    """
    on = values.join(domain.withColumn("__known", F.lit(True)).hint("merge"), ["t", "key"], "left")
    number = F.expr("try_cast(value AS bigint)")
    bad = {
        "unknown_key": F.col("__known").isNull(),
        "range": (F.col("kind") == "int") & (number.isNull() | ~number.between(F.col("least"), F.col("most"))),
        "length": (F.col("kind") == "str") & ~F.char_length("value").between(F.col("least"), F.col("most")),
        "control": (F.col("kind") == "str") & F.col("value").rlike(r"[\x00-\x1f]"),
    }
    return issues(on, "doc", list(bad.items()))


def missing_keys(nodes: DataFrame, values: DataFrame, domain: DataFrame) -> DataFrame:
    """(doc, path, key) of required keys that a node lacks."""
    required = domain.filter("required").select("t", "key")
    return nodes.join(required.hint("merge"), "t").join(values.select("doc", "path", "key").hint("merge"), ["doc", "path", "key"], "left_anti").select("doc", "path", "key")


def token_budget(df: DataFrame, prompt: str, completion: str, most: int) -> DataFrame:
    """Column status: "fits" or "too_long" by the tokens of both."""
    from annomill.functions.text import token_count

    return df.withColumn("n_tokens", token_count(F.col(prompt)) + token_count(F.col(completion))).withColumn("status", F.when(F.col("n_tokens") > most, "too_long").otherwise("fits"))


def length_filter(df: DataFrame, values: str, least: int = 1, most: int = 512) -> DataFrame:
    return df.filter(F.size(values).between(least, most))


def nan_filter(df: DataFrame, value: str) -> DataFrame:
    return df.filter(~F.isnan(value) & F.col(value).isNotNull())


def implied_class(strokes: DataFrame, sources: list[tuple[str, DataFrame]], keys: list[str], default: str) -> DataFrame:
    """Class of each stroke from lists of strokes; later lists win over earlier ones."""
    listed = None
    for k, (name, df) in enumerate(sources):
        part = df.select(*keys, F.lit(name).alias("cls"), F.lit(k).alias("prio"))
        listed = part if listed is None else listed.unionByName(part)
    best = listed.groupBy(*keys).agg(F.max_by("cls", "prio").alias("cls"))
    return strokes.select(*keys).distinct().join(best, keys, "left").withColumn("cls", F.coalesce("cls", F.lit(default)))


def drop_dead_links(links: DataFrame, targets: DataFrame, doc: str, go: str, target: str) -> DataFrame:
    """Links to nothing become null."""
    known = targets.select(doc, F.col(target).alias(go), F.lit(True).alias("__there")).distinct()
    return links.join(known, [doc, go], "left").withColumn(go, F.when(F.col("__there"), F.col(go))).drop("__there")


def drop_noise_groups(df: DataFrame, kind: str, none: str) -> DataFrame:
    return df.filter(F.col(kind) != none)


def simplify_nodes(nodes: DataFrame) -> DataFrame:
    """Drawable form: icons but the menu are circles, at most six repeats, labels of three words and 20 characters."""
    label = F.left(F.array_join(F.slice(F.split("label", " "), 1, 3), " "), F.lit(20))
    return nodes.withColumns({"icon": F.when(F.col("icon") == "menu", "menu").when(F.col("icon").isNotNull(), "circle"), "n": F.least("n", F.lit(6)), "label": label})


def leaf_bounds(docs: DataFrame, leaves: str, least: int = 4, most: int = 10) -> DataFrame:
    return docs.filter(F.col(leaves).between(least, most))


def format_metric(value: Column, known: Column, digits: int = 3) -> Column:
    """Fixed digits; "n/a" if undefined, "pending" if there is no result."""
    return F.when(~known, "pending").when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", value))


def primitive_class(closure: Column, length: Column, w: Column, h: Column, area: Column, turns: Column, straight: Column, angle: Column) -> Column:
    """Shape of a stroke from its geometry: closed ones by the share of their box, wavy ones, straight ones by angle."""
    closed = (closure < 0.25) & (length > 0.5 * (w + h))
    wavy = (w > 3 * h) & (h > 0.02 * w) & (turns >= 3) & (length < 2.5 * w)
    return (
        F.when(closed & (area > 0.88), "rect").when(closed & (area > 0.6), "ellipse").when(wavy, "wavy")
        .when((straight > 0.9) & (angle < 15), "hline").when((straight > 0.9) & (angle > 75), "vline").when(straight > 0.9, "diag").otherwise("scribble")
    )


def readable_elements(elements: DataFrame, types: list[str], *, pixels: bool = False) -> DataFrame:
    """Elements of text-bearing types that have text strokes (or any, if the reader sees pixels)."""
    kept = elements.filter(F.col("type").isin(types))
    return kept if pixels else kept.filter(F.size("text_strokes") > 0)
