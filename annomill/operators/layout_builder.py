"""Documents from the elements of sketches, by geometry alone.

Frames in reading order, each element's frame, names, links and the card around each element are joins and windows of the
library. What is left is putting siblings in order: the elements of one card, or of a frame outside its cards, are grouped
(`_Siblings`), innermost cards first, so a level of nesting is one shuffle, and a group is what one box directly holds.

The result is valid whatever is drawn: sketches without a frame are one empty screen, an empty body or card holds a
spacer, children are cut at the format's limits, a list never holds a list. Keys come in the format's order and defaults
are left out. Equal places go by element number. Elements outside all frames, links to the own frame and links from
nothing go. Null text is no text. Elements without a box are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomill.functions.numeric import Box
from annomill.functions.text import clean_text
from annomill.session import stored

from .folds import grouped
from .joins import containing_first, smallest_container
from .spatial import extent, meeting, point
from .windows import dedupe_names, reading_order

#: Fixed values of the format: labels of tabs without one, and the most children, repeats, tabs, bar icons and radio options.
TABS = ("Home", "Search", "Profile", "Settings", "More")
MOST, REPEATS, TILES, ITEMS, ICONS, OPTIONS = 40, 50, 60, 5, 4, 6
MARK, SECRET = r"^\s*[xX×*]\s*([0-9]{1,2})\s*$", r"(?i)pass|pin|secret|otp"
SMALL = ("icon", "menu", "avatar")
BOX = ("x", "y", "w", "h")


def shown(text: Column) -> Column:
    """A label in one line of at most 80 characters, or null."""
    return F.left(F.nullif(clean_text(text), F.lit("")), F.lit(80))


def _leaf(fh: Column, u: Column) -> tuple[Column, Column]:
    """The JSON and the signature of an element that isn't a card; null for what is no node of a body."""
    kind, text, go = F.col("type"), shown(F.col("text")), F.col("go")
    words = {"btn": ("label", "Button"), "input": ("label", "Input"), "text": ("v", "Text"), "heading": ("v", "Heading"), "check": ("label", "Option"), "radio": ("label", "Option"), "switch": ("label", "Setting")}
    said = lambda key: F.coalesce(*(F.when(kind == k, F.coalesce(text, F.lit(d))) for k, (where, d) in words.items() if where == key))
    t = F.when(kind == "heading", "text").when(kind == "menu", "icon").when(kind == "radio", "check").otherwise(kind)
    style = F.when((kind == "text") & go.isNotNull(), "link").when((kind == "heading") & (F.col("h") > 0.1 * u), "h1").when(kind == "heading", "h2")
    secret = (kind == "input") & F.coalesce(text, F.lit("")).rlike(SECRET)
    tall = (kind == "input") & ~secret & (F.col("h") > 0.15 * u)
    linked = kind.isin("btn", "text", "heading", *SMALL)
    node = F.struct(
        t.alias("t"), said("v").alias("v"), said("label").alias("label"), style.alias("s"), F.when(kind == "para", F.greatest(F.lit(1), F.least(F.lit(12), F.col("n")))).cast("int").alias("lines"),
        F.when(kind == "img", F.greatest(F.lit(5), F.least(F.lit(100), F.round(100 * F.col("h") / fh)))).cast("int").alias("h"), F.when(kind == "icon", "circle").when(kind == "menu", "menu").alias("name"),
        F.when(secret, F.lit(True)).alias("secure"), F.when(tall, F.lit(True)).alias("multiline"), F.when(linked, go).alias("go"),
    )
    signature = F.when(t == "text", F.concat(F.lit("text:"), F.coalesce(style, F.lit("body")))).when(t == "btn", "btn:primary").when(t.isin("input", "check", "switch", "img"), t).otherwise(F.concat(t, F.lit("()")))
    none = kind.isin("appbar", "bottomnav", "fab", "listmark")
    return F.when(~none, F.to_json(node)), F.when(~none, signature)


class _Siblings:
    """What a card or a frame directly holds, in order of place: rows, marks beside them, radio groups, grids and repeats."""

    def __init__(self, rows: list[tuple]):
        #: (id, type, x, y, w, h, go, json, signature, holds a repeat, label, times, u)
        self.u = rows[0][-1]
        self.marks = sorted((r for r in rows if r[11] is not None), key=lambda r: r[0])
        self.go = next((r[6] for r in sorted(rows) if r[6] is not None), None)
        self.rows: list[list[tuple]] = []
        low = high = 0.0
        for r in rows:  # they come by y
            if r[11] is not None:
                continue
            top, foot = r[3], r[3] + r[5]
            if self.rows and min(high, foot) - max(low, top) > 0.5 * min(r[5], high - low):
                self.rows[-1].append(r)
                low, high = min(low, top), max(high, foot)
            else:
                self.rows.append([r])
                low, high = top, foot

    def times(self, row: list[tuple]) -> int | None:
        """The number on the first mark beside the row; a mark counts once."""
        low, high = min(r[3] for r in row) - 0.03 * self.u, max(r[3] + r[5] for r in row) + 0.03 * self.u
        for m in self.marks:
            if low <= m[3] + m[5] / 2 <= high:
                self.marks.remove(m)
                return m[11]
        return None

    def node(self, row: list[tuple]) -> tuple[str, str, str, bool, int] | None:
        """(type, json, signature, holds a repeat, tiles) of one row."""
        parts = [(r[1], r[7], r[8], r[9], 0) for r in sorted(row, key=lambda r: (r[2], r[0])) if r[7] is not None]
        if len(parts) < 2:
            return parts[0] if parts else None
        kind, item, sign, repeat, _ = parts[0]
        if len(parts) <= 4 and not repeat and all(p[0] == "card" and p[2] == sign for p in parts):
            return self.grid(len(parts), len(parts), item, sign)
        parts = parts[:MOST]
        return "row", f'{{"t":"row","c":[{",".join(p[1] for p in parts)}]}}', f"row({','.join(p[2] for p in parts)})", any(p[3] for p in parts), 0

    @staticmethod
    def grid(cols: int, n: int, item: str, sign: str) -> tuple[str, str, str, bool, int]:
        return "grid", f'{{"t":"grid","cols":{cols},"n":{min(n, TILES)},"item":{item}}}', f"grid({sign})", True, n

    @staticmethod
    def listed(n: int, node: tuple) -> tuple[str, str, str, bool, int]:
        return "list", f'{{"t":"list","n":{max(1, min(n, REPEATS))},"item":{node[1]}}}', f"list({node[2]})", True, 0

    def nodes(self) -> list[tuple[str, str, str, bool, int]]:
        out: list[tuple] = []
        k = 0
        while k < len(self.rows):
            run = k
            while run < len(self.rows) and len(self.rows[run]) == 1 and self.rows[run][0][1] == "radio":
                run += 1
            if run - k >= 2:
                options = [self.rows[i][0][10] or "Option" for i in range(k, run)][:OPTIONS]
                out.append(("radio", json.dumps({"t": "radio", "options": options}, ensure_ascii=False, separators=(",", ":")), "radio", False, 0))
                k = run
                continue
            node = self.node(self.rows[k])
            if node is not None:
                times = self.times(self.rows[k])
                out.append(self.listed(times, node) if times is not None and not node[3] else node)
            k += 1
        return self.repeats(out)

    def repeats(self, nodes: list[tuple]) -> list[tuple]:
        """Neighbours that look the same are a list, or one grid."""
        out: list[tuple] = []
        k = 0
        while k < len(nodes):
            kind, text, sign, repeat, tiles = nodes[k]
            run = k + 1
            while run < len(nodes) and nodes[run][2] == sign:
                run += 1
            if run - k > 1 and kind == "grid":
                cols = json.loads(text)["cols"]
                out.append(self.grid(cols, tiles * (run - k), text[text.index('"item":') + 7 : -1], sign[5:-1]))
            elif run - k > 1 and kind in ("card", "row") and not repeat:
                out.append(self.listed(run - k, nodes[k]))
            else:
                out += nodes[k:run]
            k = run
        return out


def _arranged(rows: list[tuple]) -> list[tuple]:
    group = _Siblings(rows)
    nodes = group.nodes()
    if not nodes:
        return [(None, None, False, None, group.go)]
    return [(f"[{','.join(n[1] for n in nodes[:MOST])}]", ",".join(n[2] for n in nodes[:MOST]), any(n[3] for n in nodes[:MOST]), nodes[0][0] if len(nodes) == 1 else None, group.go)]


def _with_frames(elements: DataFrame, frames: DataFrame, doc: str) -> DataFrame:
    """elements with their frame (their own, or the first in reading order that holds their centre), its box and its place."""
    b = Box.of()
    own = elements.filter(F.col("frame").isNotNull())
    rest = elements.filter(F.col("frame").isNull()).drop("frame")
    at = containing_first(rest.select(doc, "element_id", b.cx.alias("px"), b.cy.alias("py")), frames.select(doc, "frame", "ord", *BOX), doc, "element_id", "frame", "ord", else_nearest=False).drop("inside")
    both = own.unionByName(rest.join(at.hint("merge"), [doc, "element_id"]))
    return both.join(frames.select(doc, "frame", "ord", *(F.col(c).alias("f" + c) for c in BOX)).hint("merge"), [doc, "frame"])


def _links(arrows: DataFrame, elements: DataFrame, frames: DataFrame, names: DataFrame, doc: str) -> DataFrame:
    """(doc, element_id, go): the smallest element under an arrow's tail, or else that with the nearest centre, leads to the frame its head points into; the last arrow counts."""
    at = lambda x, y, name, near: containing_first(arrows.select(doc, "arrow", F.col(x).alias("px"), F.col(y).alias("py")), frames.select(doc, "frame", "ord", *BOX), doc, "arrow", "frame", "ord", else_nearest=near).select(doc, "arrow", F.col("frame").alias(name))
    both = arrows.join(at("tx", "ty", "__from", False).hint("merge"), [doc, "arrow"]).join(at("hx", "hy", "__to", True).hint("merge"), [doc, "arrow"]).filter("__from != __to")
    wide = frames.select(doc, F.col("frame").alias("__from"), F.col("w").alias("__u"))
    tails = both.join(wide.hint("merge"), [doc, "__from"]).withColumn("__in", F.concat_ws("/", F.col(doc).cast("string"), F.col("__from").cast("string")))
    here = elements.select(F.concat_ws("/", F.col(doc).cast("string"), F.col("frame").cast("string")).alias("__in"), "element_id", *BOX)
    b, x, y, u = Box.of(), F.col("tx"), F.col("ty"), F.col("__u")
    under, away = b.contains(x, y, 0.04 * u), F.hypot(b.cx - x, b.cy - y)
    near = meeting(tails.select("__in", "arrow", "tx", "ty", "__u"), here, "__in", point(x, y, 0.15 * u), extent(b)).filter(under | (away < 0.15 * u))
    source = near.groupBy("__in", "arrow").agg(F.min_by("element_id", F.struct((~under).alias("out"), F.when(under, b.area).otherwise(away).alias("by"), "element_id")).alias("element_id"))
    led = tails.select(doc, "__in", "arrow", F.col("__to").alias("frame")).join(source.hint("merge"), ["__in", "arrow"]).join(names.select(doc, "frame", F.col("name").alias("go")).hint("merge"), [doc, "frame"])
    return led.groupBy(doc, "element_id").agg(F.max_by("go", "arrow").alias("go"))


def _slots(elements: DataFrame, doc: str) -> DataFrame:
    """elements with slot: bar, bar_icon, nav, nav_icon, nav_label, fab or null, for each frame."""
    b, foot = Box.of(), F.col("fy") + F.col("fh")
    of = lambda kind: Window.partitionBy(doc, "frame", F.col("type") == kind)
    first = lambda kind, *order: (F.col("type") == kind) & (F.row_number().over(of(kind).orderBy(*order)) == 1)
    marked = elements.withColumn("slot", F.when(first("appbar", "y", "element_id"), "bar").when(first("bottomnav", "element_id"), "nav").when(F.col("type") == "fab", "fab"))
    whole = Window.partitionBy(doc, "frame")
    edge = lambda slot, value: F.max(F.when(F.col("slot") == slot, value)).over(whole)
    low, high = F.greatest(edge("bar", b.y + b.h), F.col("fy") + 0.06 * F.col("fh")), F.least(edge("nav", b.y), foot - 0.06 * F.col("fh"))
    marked = marked.withColumns({"__low": F.when(edge("bar", b.y).isNotNull(), low), "__high": F.when(edge("nav", b.y).isNotNull(), high)})
    across = b.cx.between(F.col("fx"), F.col("fx") + F.col("fw"))
    above, below = across & b.cy.between(F.col("fy"), F.col("__low")), across & b.cy.between(F.col("__high"), foot)
    slot = F.coalesce("slot", F.when(F.col("type").isin(*SMALL) & above, "bar_icon").when(F.col("type").isin(*SMALL) & below, "nav_icon").when((F.col("type") == "text") & below, "nav_label"))
    return marked.withColumn("slot", slot).drop("__low", "__high")


def _screens(placed: DataFrame, doc: str) -> DataFrame:
    """(doc, frame, bar, nav, fab): the slots' JSON, null where there is none."""
    icon = F.struct("element_id", F.struct(F.lit("icon").alias("t"), F.when(F.col("type") == "menu", "menu").otherwise("circle").alias("name"), "go").alias("n"))
    tab, label = F.struct("x", "element_id", (F.col("x") + F.col("w") / 2).alias("c"), "go"), F.struct("element_id", (F.col("x") + F.col("w") / 2).alias("c"), shown(F.col("text")).alias("l"))
    of = lambda slot, item: F.array_sort(F.collect_list(F.when(F.col("slot") == slot, item)))
    g = placed.filter("slot IS NOT NULL").groupBy(doc, "frame").agg(
        F.max(F.when(F.col("slot") == "bar", F.struct(F.lit(1), shown(F.col("text")).alias("l")))).alias("bar"), F.transform(of("bar_icon", icon), lambda i: i["n"]).alias("icons"), F.max(F.col("slot") == "nav").alias("has_nav"),
        of("nav_icon", tab).alias("tabs"), of("nav_label", label).alias("labels"), F.min(F.when(F.col("slot") == "fab", F.struct("element_id", "go"))).alias("fab"), F.first("fw").alias("u"), F.first("title").alias("title"),
    )
    near = lambda t: F.get(F.filter("labels", lambda n: F.abs(n["c"] - t["c"]) < 0.12 * F.col("u")), F.lit(0))["l"]
    tabs = F.transform(F.slice("tabs", 1, ITEMS), lambda t, k: F.struct(F.lit("circle").alias("icon"), F.coalesce(near(t), F.get(F.array(*map(F.lit, TABS)), k)).alias("label"), t["go"].alias("go")))
    icons = F.slice("icons", 1, ICONS)
    bar = F.when(F.col("bar").isNotNull(), F.to_json(F.struct(F.lit("appbar").alias("t"), F.coalesce(F.col("bar.l"), "title").alias("title"), F.when(F.size(icons) > 0, icons).alias("icons"))))
    nav = F.when(F.col("has_nav") & (F.size("tabs") > 1), F.to_json(F.struct(F.lit("bottomnav").alias("t"), tabs.alias("items"))))
    fab = F.when(F.col("fab").isNotNull(), F.to_json(F.struct(F.lit("fab").alias("t"), F.lit("add").alias("icon"), F.col("fab.go").alias("go"))))
    return g.select(doc, "frame", bar.alias("bar"), nav.alias("nav"), fab.alias("fab"))


def _bodies(body: DataFrame, doc: str) -> DataFrame:
    """(doc, frame, body): each frame's elements nested in their cards, innermost first."""
    region = F.concat_ws("/", F.col(doc).cast("string"), F.col("frame").cast("string"))
    keyed = stored(body.withColumn("__in", region), "body")
    up = smallest_container(keyed.select("__in", "element_id", *BOX), keyed.filter("type = 'card'").select("__in", F.col("element_id").alias("card"), *BOX), "__in", "element_id", "card")
    nested = stored(keyed.join(up.hint("merge"), ["__in", "element_id"], "left"), "nested")
    chain, deep = nested.select("__in", "element_id", F.col("card").alias("above"), F.lit(0).alias("level")), 0
    above = nested.filter("type = 'card'").select("__in", F.col("element_id").alias("above"), F.col("card").alias("further"))
    while True:
        chain = stored(chain.join(above.hint("merge"), ["__in", "above"], "left").select("__in", "element_id", F.col("further").alias("above"), (F.col("level") + F.col("above").isNotNull().cast("int")).alias("level")), "chain")
        if chain.filter("above IS NOT NULL").isEmpty():
            break
    levels = stored(nested.join(chain.select("__in", "element_id", "level").hint("merge"), ["__in", "element_id"]), "levels")
    deep = levels.agg(F.max("level")).first()[0]
    json_, sign = _leaf(F.col("fh"), F.col("fw"))
    number = F.regexp_extract(F.coalesce("text", F.lit("")), MARK, 1)
    times = F.when(number != "", F.greatest(F.lit(1), F.least(F.lit(REPEATS), number.cast("int")))).when(F.col("type") == "listmark", F.lit(3))
    outputs = {"c": "string", "sign": "string", "repeat": "boolean", "only": "string", "child_go": "string"}
    inputs = ["element_id", "type", *BOX, "go", "json", "signature", "repeat", "label", "times", "fw"]
    made = None
    for d in range(deep or 0, -1, -1):
        here = levels.filter(F.col("level") == d)
        leaves = here.filter("type != 'card'").select(doc, "frame", "card", "element_id", "type", *BOX, "go", json_.alias("json"), sign.alias("signature"), F.lit(False).alias("repeat"), shown(F.col("text")).alias("label"), times.cast("int").alias("times"), "fw")
        cards = here.filter("type = 'card'")
        if made is not None:
            cards = cards.join(made.select(doc, "frame", F.col("card").alias("element_id"), "c", "sign", "repeat", "child_go").hint("merge"), [doc, "frame", "element_id"], "left")
        else:
            cards = cards.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("c", "string"), ("sign", "string"), ("repeat", "boolean"), ("child_go", "string"))))
        go = F.coalesce("go", "child_go")
        link = F.coalesce(F.concat(F.lit('"go":"'), go, F.lit('",')), F.lit(""))
        card = F.concat(F.lit('{"t":"card",'), link, F.lit('"c":'), F.coalesce("c", F.lit('[{"t":"spacer"}]')), F.lit("}"))
        cards = cards.select(doc, "frame", "card", "element_id", "type", *BOX, "go", card.alias("json"), F.concat(F.lit("card("), F.coalesce("sign", F.lit("spacer()")), F.lit(")")).alias("signature"), F.coalesce("repeat", F.lit(False)).alias("repeat"), F.lit(None).cast("string").alias("label"), times.cast("int").alias("times"), "fw")
        made = stored(grouped(leaves.unionByName(cards), [doc, "frame", "card"], ["y", "x", "element_id"], inputs, outputs, _arranged), "arranged")
    whole = F.when(F.col("only").isin("col", "list", "grid"), F.substring(F.col("c"), 2, F.length("c") - 2)).when(F.col("c").isNotNull(), F.concat(F.lit('{"t":"col","c":'), "c", F.lit("}")))
    return made.select(doc, "frame", whole.alias("body"))


def build_spec(elements: DataFrame, frames: DataFrame, arrows: DataFrame, doc: str) -> DataFrame:
    """(doc, spec): a document for every sketch that has frames or elements.

    elements: doc, element_id, frame (may be null), type, x, y, w, h, text, n (strokes); frames: doc, frame, x, y, w, h;
    arrows: doc, arrow, tx, ty, hx, hy.
    """
    order = reading_order(frames.select(doc, "frame", *BOX), doc, "frame").select(doc, "frame", (F.col("place") - 1).alias("ord"))
    frames = stored(frames.select(doc, "frame", *BOX).join(order.hint("merge"), [doc, "frame"]), "frames")
    kept = elements.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull())
    placed = stored(_with_frames(kept.select(doc, "element_id", "frame", "type", *BOX, "text", "n"), frames, doc), "placed")
    head = lambda kind: F.min(F.when((F.col("type") == kind) & shown(F.col("text")).isNotNull(), F.struct("y", "element_id", shown(F.col("text")).alias("l"))))["l"]
    titles = placed.groupBy(doc, "frame").agg(F.coalesce(head("appbar"), head("heading")).alias("__title"))
    names = dedupe_names(frames.select(doc, "ord", "frame").join(titles.hint("merge"), [doc, "frame"], "left"), doc, "ord", "__title")
    names = stored(frames.select(doc, "ord", "frame").join(names.hint("merge"), [doc, "ord"]), "names")
    go = _links(arrows, placed, frames, names, doc)
    linked = placed.join(go.hint("merge"), [doc, "element_id"], "left").join(names.select(doc, "frame", "title").hint("merge"), [doc, "frame"])
    linked = stored(_slots(linked, doc), "linked")
    parts = names.join(_screens(linked, doc).hint("merge"), [doc, "frame"], "left").join(_bodies(linked.filter("slot IS NULL").drop("slot"), doc).hint("merge"), [doc, "frame"], "left")
    slot = lambda name, c: F.coalesce(F.concat(F.lit(f',"{name}":'), c), F.lit(""))
    ident = F.to_json(F.struct(F.col("name").alias("id"), "title"))
    screen = F.concat(F.substring(ident, F.lit(1), F.length(ident) - 1), slot("appbar", F.col("bar")), F.lit(',"body":'), F.coalesce("body", F.lit('{"t":"col","c":[{"t":"spacer"}]}')), slot("bottomnav", F.col("nav")), slot("fab", F.col("fab")), F.lit("}"))
    joined = parts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", screen.alias("s")))), lambda x: x["s"]), ",").alias("s"))
    every = frames.select(doc).unionByName(elements.select(doc)).distinct()
    empty = F.lit('{"id":"screen","title":"Screen","body":{"t":"col","c":[{"t":"spacer"}]}}')
    return every.join(joined.hint("merge"), doc, "left").select(doc, F.concat(F.lit('{"v":1,"screens":['), F.coalesce("s", empty), F.lit("]}")).alias("spec"))
