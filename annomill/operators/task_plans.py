"""Drawing plans of documents: what a person draws for each node, step by step, and an arrow for each link.

Documents are taken apart as variants, a level of nesting at a time and each level written before the next, so no document
is parsed in Python. A node's place is an array of numbers, which sorts in document order: a card before what it holds, a
repeat's mark after its item. Null text, text that is no JSON and documents without screens have no steps; unknown kinds of
nodes are passed over with what they hold. A document is told by its number, a null one included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomill.session import stored

#: For each kind of node the group it makes, its parts with what the person is told, and what an arrow from it is said to start at.
#: {} is the quoted label, {k} the number of the screen.
STEPS = {
    "card": ("card", [("shape", "Card: draw a rectangle big enough for what goes inside it")], "the card"),
    "list": ("listmark", [("text", "List: write {} beside the item you just drew")], None),
    "grid": ("listmark", [("text", "Grid: write {} beside the row")], None),
    "heading": ("heading", [("text", "Heading: write {}"), ("shape", "Underline the heading")], "{}"),
    "text": ("text", [("text", "Text: write {}")], "{}"),
    "para": ("para", [("shape", "Paragraph: draw {}")], None),
    "btn": ("btn", [("shape", "Button: draw a rectangle"), ("text", "Write {} inside the button")], "the {} button"),
    "input": ("input", [("text", "Input: write the label {}"), ("shape", "Draw the input box (or a line) under the label")], None),
    "check": ("check", [("shape", "Checkbox: draw a small square"), ("text", "Write {} to its right")], None),
    "option": ("radio", [("shape", "Radio option: draw a small circle"), ("text", "Write {} to its right")], None),
    "switch": ("switch", [("text", "Switch: write the label {}"), ("shape", "Draw a pill with a small circle inside, to the right of the label")], None),
    "img": ("img", [("shape", "Image: draw a rectangle with an X inside")], None),
    "menu": ("menu", [("shape", "Menu: draw three short lines")], "the menu icon"),
    "icon": ("icon", [("shape", "Icon: draw a small doodle or circle")], "the icon"),
    "avatar": ("avatar", [("shape", "Avatar: draw a circle with a smaller circle inside")], "the avatar"),
    "divider": ("divider", [("shape", "Divider: draw a long horizontal line")], None),
    "appbar": ("appbar", [("shape", "Screen {k} app bar: draw a band (or a line) across the top"), ("text", "Write the title {} in the band")], None),
    "bottomnav": ("bottomnav", [("shape", "Bottom bar: draw a band (or a line) across the bottom")], None),
    "tab icon": ("icon", [("shape", "Draw an icon in the bottom bar")], None),
    "tab": ("text", [("text", "Write {} under that icon")], "the {} tab"),
    "fab": ("fab", [("shape", "Floating button: draw a circle with a + near the bottom-right")], "the + button"),
}
#: Most columns of a grid; the place of a mark after all that a node holds.
COLUMNS, LAST = 4, 1 << 30


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("node", path, kind)


def _nodes(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc, screen, id) of screens, and (doc, screen, at, kind, node) of everything in them."""
    parsed = docs.select(doc, F.try_parse_json(F.col(text)).alias("node"))
    screens = stored(parsed.select(doc, F.posexplode(_get("$.screens", "array<variant>")).alias("screen", "node")), "screens")
    slots = [F.struct(F.lit(k).alias("slot"), _get(f"$.{s}", "variant").alias("node")) for k, s in enumerate(("appbar", "body", "bottomnav", "fab"))]
    first = screens.select(doc, "screen", F.explode(F.array(*slots)).alias("s")).filter("s.node IS NOT NULL")
    first = first.select(doc, "screen", F.array("screen", "s.slot").alias("at"), F.col("s.node").alias("node"))
    level, found = stored(first.withColumn("kind", _get("$.t", "string")), "level"), None
    item = _get("$.item", "variant")
    columns = F.least(F.coalesce(_get("$.cols", "int"), F.lit(1)), F.lit(COLUMNS))
    held = (
        F.when(F.col("kind").isin("col", "row", "card"), _get("$.c", "array<variant>")).when(F.col("kind") == "appbar", _get("$.icons", "array<variant>")).when(F.col("kind") == "bottomnav", _get("$.items", "array<variant>"))
        .when(F.col("kind") == "radio", _get("$.options", "array<variant>")).when(item.isNotNull() & (F.col("kind") == "list"), F.array(item)).when(item.isNotNull() & (F.col("kind") == "grid"), F.array_repeat(item, columns))
    )
    own = F.when(F.col("up") == "bottomnav", "tab").when(F.col("up") == "radio", "option").otherwise(_get("$.t", "string"))
    while not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        below = level.select(doc, "screen", "at", F.col("kind").alias("up"), F.posexplode(held).alias("k", "node"))
        level = stored(below.select(doc, "screen", F.concat("at", F.array(F.col("k") + 1)).alias("at"), "node", own.alias("kind")), "level")
    return screens.select(doc, "screen", _get("$.id", "string").alias("id")), level if found is None else found


def plan_documents(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, step, group, type, screen, label, part, instruction, target): steps in the order of drawing, counted from 0 as groups and screens are.

    A group is what one element takes; each link to another screen of the document that exists is a group of type arrow after all
    elements, its target the screen. text: the column with a document's JSON.
    """
    screens, nodes = _nodes(docs, doc, text)
    kind = F.when((F.col("kind") == "text") & _get("$.s", "string").isin("h1", "h2"), "heading").when((F.col("kind") == "icon") & (_get("$.name", "string") == "menu"), "menu").otherwise(F.col("kind"))
    count = F.concat(F.lit("x"), _get("$.n", "string"))
    label = (
        F.when(F.col("key").isin("list", "grid"), count).when(F.col("key") == "option", _get("$", "string")).when(F.col("key").isin("text", "heading"), _get("$.v", "string"))
        .when(F.col("key") == "appbar", _get("$.title", "string")).when(F.col("key").isin("btn", "input", "check", "switch", "tab"), _get("$.label", "string"))
    )
    lines = _get("$.lines", "int")
    said = F.when(F.col("key") == "para", F.concat(lines.cast("string"), F.when(lines == 1, " wavy line").otherwise(" wavy lines"))).otherwise(F.concat(F.lit('"'), F.col("label"), F.lit('"')))
    quoted = lambda c, said: F.replace(F.replace(c, F.lit("{k}"), (F.col("screen") + 1).cast("string")), F.lit("{}"), F.coalesce(said, F.lit('""')))
    one = lambda k, place: F.struct(k.alias("key"), F.lit(place).alias("place"))
    marked = (F.col("kind") == "list") | (_get("$.n", "int") > _get("$.cols", "int"))
    made = F.when(F.col("kind") == "tab", F.array(one(F.lit("tab icon"), 0), one(F.lit("tab"), 1))).when(F.col("kind").isin("list", "grid"), F.when(marked, F.array(one(F.col("kind"), LAST)))).otherwise(F.array(one(kind, 0)))
    groups = nodes.select(doc, "screen", "at", "node", F.explode(made).alias("m")).select(doc, "screen", F.concat("at", F.array("m.place")).alias("at"), F.col("m.key").alias("key"), "node")
    of = lambda values: F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), F.col("key"))
    parts = of({k: F.array(*(F.struct(F.lit(p).alias("part"), F.lit(t).alias("said")) for p, t in v[1])) for k, v in STEPS.items()})
    groups = groups.withColumn("label", label).withColumns({"said": said, "type": of({k: F.lit(v[0]) for k, v in STEPS.items()}), "parts": parts, "start": of({k: F.lit(v[2]).cast("string") for k, v in STEPS.items()})}).filter("type IS NOT NULL")
    parts = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), quoted(p["said"], F.col("said")).alias("said")))
    go = F.when(F.col("start").isNotNull(), F.try_variant_get("node", "$.go", "string"))
    groups = stored(groups.select(doc, "screen", "at", "type", "label", parts.alias("parts"), quoted(F.col("start"), F.col("said")).alias("start"), go.alias("go")), "groups")
    to = screens.groupBy(F.col(doc).alias("__doc"), F.col("id").alias("__id")).agg(F.min("screen").alias("target"))
    led = groups.filter("go IS NOT NULL").join(to.hint("merge"), F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("go") == F.col("__id"))).filter("target != screen")
    told = F.concat(F.lit("Draw an arrow from "), "start", F.lit(" to screen "), (F.col("target") + 1).cast("string"))
    arrows = led.select(doc, "screen", F.lit(1).alias("late"), "at", F.lit("arrow").alias("type"), F.lit(None).cast("string").alias("label"), F.array(F.struct(F.lit("arrow").alias("part"), told.alias("said"))).alias("parts"), "target")
    both = groups.select(doc, "screen", F.lit(0).alias("late"), "at", "type", "label", "parts", F.lit(None).cast("int").alias("target")).unionByName(arrows)
    numbered = both.withColumn("group", F.row_number().over(Window.partitionBy(doc).orderBy("late", "at")) - 1)
    steps = numbered.select(doc, "group", "type", "screen", "label", "target", F.posexplode("parts").alias("no", "p"))
    step = F.row_number().over(Window.partitionBy(doc).orderBy("group", "no")) - 1
    return steps.select(doc, step.alias("step"), "group", "type", "screen", "label", F.col("p.part").alias("part"), F.col("p.said").alias("instruction"), "target")
