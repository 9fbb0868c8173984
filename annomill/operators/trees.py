"""Nested documents as node tables, and trees rebuilt from them."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomill.session import stored

from .folds import folded

#: The order of keys in a canonical document, by the node's type, and the values that are left out.
KEY_ORDER = {
    "spec": ["v", "screens"], "screen": ["id", "title", "appbar", "body", "bottomnav", "fab"], "appbar": ["t", "title", "icons"], "bottomnav": ["t", "items"],
    "navitem": ["icon", "label", "go"], "fab": ["t", "icon", "go"], "col": ["t", "c"], "row": ["t", "c"], "card": ["t", "go", "c"], "list": ["t", "n", "item"],
    "grid": ["t", "cols", "n", "item"], "text": ["t", "v", "s", "go"], "para": ["t", "lines"], "btn": ["t", "label", "variant", "go"], "input": ["t", "label", "secure", "multiline"],
    "check": ["t", "label"], "radio": ["t", "options"], "switch": ["t", "label"], "img": ["t", "h"], "icon": ["t", "name", "go"], "avatar": ["t", "go"], "divider": ["t"], "spacer": ["t"],
}
DEFAULTS = {"text": {"s": "body"}, "btn": {"variant": "primary"}, "input": {"secure": False, "multiline": False}}


def flatten(docs: DataFrame, doc: str, text: str, children: str = "children", depth: int | None = None) -> DataFrame:
    """(doc, path, parent, ord, depth, node) of JSON documents, one variant_explode per level, down to the last level that has nodes (or to `depth`).

    Text that is no JSON has no nodes. Each level is written and the next one made from it, so no level is parsed or exploded twice.
    """
    spark = docs.sparkSession
    level = stored(docs.select(doc, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.try_parse_json(F.col(text)).alias("node")).filter("node IS NOT NULL"), "level")
    found, d = level, 0
    while depth is None or d < depth:
        d += 1
        name = f"level_{uuid.uuid4().hex}"
        level.createOrReplaceTempView(name)
        below = spark.sql(f"SELECT l.{doc}, concat(l.path, '/{children}/', e.pos) AS path, l.path AS parent, CAST(e.pos AS INT) AS ord, {d} AS depth, e.value AS node FROM {name} l, LATERAL variant_explode(variant_get(l.node, '$.{children}', 'variant')) e")
        spark.catalog.dropTempView(name)
        level = stored(below, "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def splice_unlabelled(nodes: DataFrame, doc: str, label: str) -> DataFrame:
    """Labelled nodes whose parent is the nearest labelled ancestor; wrappers without a label go.

    A node looks for its own ancestors' paths, as many as it is deep, so no document's nodes are paired.
    """
    named = nodes.filter(F.col(label).isNotNull())
    steps = F.split("path", "/")
    above = named.select(doc, "path", F.explode(F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / 2).cast("int")), lambda k: F.array_join(F.slice(steps, F.lit(1), 2 * k + 1), "/"))).alias("up")).filter("up != path")
    known = named.select(doc, F.col("path").alias("up"))
    nearest = above.join(known.hint("merge"), [doc, "up"]).groupBy(doc, "path").agg(F.max_by("up", F.char_length("up")).alias("parent"))
    return named.drop("parent").join(nearest.hint("merge"), [doc, "path"], "left")


def first_heading(nodes: DataFrame, doc: str, kind: str, value: str, heads: list[str]) -> DataFrame:
    """The first heading of each document, breadth first."""
    return nodes.filter(F.col(kind).isin(heads)).groupBy(doc).agg(F.min_by(value, F.struct("depth", "path")).alias("title"))


def merge_label_control(nodes: DataFrame, doc: str, parent: str) -> DataFrame:
    """(doc, parent, control, label) of parents with just a text and a switch or check."""
    pair = nodes.groupBy(doc, parent).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "text").alias("texts"), F.max(F.when(F.col("type").isin("switch", "check"), F.col("type"))).alias("control"), F.max(F.when(F.col("type") == "text", F.col("text"))).alias("label"))
    return pair.filter((F.col("n") == 2) & (F.col("texts") == 1) & F.col("control").isNotNull()).select(doc, parent, "control", "label")


def detect_grid(nodes: DataFrame, doc: str, parent: str, signature: str, most: int = 4) -> DataFrame:
    """Parents whose two to four children all have one signature."""
    g = nodes.groupBy(doc, parent).agg(F.count("*").alias("n"), F.count_distinct(signature).alias("kinds"))
    return g.filter((F.col("n").between(2, most)) & (F.col("kinds") == 1)).select(doc, parent, "n")


def signature(nodes: DataFrame, doc: str, kind: str) -> DataFrame:
    """(doc, path, sig): the types of a subtree as a string, built from the lowest level up."""
    sig, out = None, None
    for d in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = nodes.filter(F.col("depth") == d).select(doc, "path", "parent", "ord", kind)
        if sig is not None:
            below = sig.groupBy(doc, F.col("parent").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sig"))), lambda x: x["sig"]), ",").alias("sub"))
            level = level.join(below.hint("merge"), [doc, "path"], "left")
        else:
            level = level.withColumn("sub", F.lit(None).cast("string"))
        sig = stored(level.select(doc, "path", "parent", "ord", F.when(F.col("sub").isNull(), F.col(kind)).otherwise(F.concat(F.col(kind), F.lit("("), F.col("sub"), F.lit(")"))).alias("sig")), "signatures")
        out = sig if out is None else out.unionByName(sig)
    return out.select(doc, "path", "sig")


def per_screen(docs: DataFrame, doc: str, screens: str) -> DataFrame:
    return docs.select(doc, F.posexplode(screens).alias("ord", "screen"))


def _kind(node: dict) -> str:
    return node.get("t") or ("spec" if "screens" in node else "screen" if "body" in node else "navitem")


def _canonical(node):
    if isinstance(node, dict):
        kind = _kind(node)
        order = KEY_ORDER.get(kind, ["t"])
        keys = [k for k in order if k in node] + sorted(k for k in node if k not in order)
        return {k: _canonical(node[k]) for k in keys if DEFAULTS.get(kind, {}).get(k, object()) != node[k]}
    if isinstance(node, list):
        return [_canonical(x) for x in node]
    return int(node) if isinstance(node, float) and node.is_integer() else node


def canonical_json(text: Column | str) -> Column:
    """Keys in order, defaults left out, whole floats as integers, no white space; null for text that is no JSON."""

    def one(s):
        try:
            return json.dumps(_canonical(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        return s.map(one)

    return work(text)


#: What a label has besides the type, and the value where it isn't stated.
STYLED = {"text": ("s", "body"), "btn": ("variant", "primary"), "icon": ("name", None)}


#: Mean length of rows from which arrays are faster than lists; most pairs of leaves that are compared as sequences at once.
LONG, SHORT = 48, 1 << 14


def _below(node: dict) -> tuple[str, list]:
    """A node's label and what lies below it; a whole document is app, screens, and each screen's slots."""
    if "screens" in node and "t" not in node:
        return "app", [{"t": "screen", "slots": x} for x in node["screens"]]
    kind = node["t"]
    if "slots" in node:
        screen = node["slots"]
        bar = [{"t": "appbar", "c": screen["appbar"].get("icons", [])}] if "appbar" in screen else []
        nav = [{"t": "bottomnav", "c": [{"t": "navitem"} for _ in screen["bottomnav"]["items"]]}] if "bottomnav" in screen else []
        return "screen", [*bar, {"t": "body", "c": [screen["body"]]}, *nav, *([{"t": "fab"}] if "fab" in screen else [])]
    name, usual = STYLED.get(kind, (None, None))
    return f"{kind}:{node.get(name, usual)}" if name else str(kind), node.get("c") or ([node["item"]] if "item" in node else [])


def _walked(root: dict, names: dict[str, int]) -> tuple[list[int], list[list[int]]]:
    """Each node's label and children, parents before children, the last child first."""
    label, kids = [], []
    todo = [(root, -1)]
    while todo:
        node, up = todo.pop()
        own, below = _below(node)
        label.append(names.setdefault(own, len(names)))
        kids.append([])
        if up >= 0:
            kids[up].append(len(label) - 1)
        todo.extend((x, len(label) - 1) for x in below)
    return label, kids


def _sequence_distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two sequences with unit costs."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    row = list(range(len(b) + 1))
    for p, x in enumerate(a):
        diagonal, row[0] = p, p + 1
        last = p + 1
        for q, y in enumerate(b, 1):
            up = row[q]
            last = min(diagonal + (x != y), up + 1, last + 1)
            diagonal, row[q] = up, last
    return row[-1]


def _one_way(one: tuple, other: tuple, most: int) -> int | None:
    """What one way of changing a tree into the other costs, if no more than `most`: children in their places, or as sequences where all are leaves."""
    (x, below_x), (y, below_y) = one, other
    cost, todo = 0, [(0, 0)]
    while todo and cost <= most:
        i, j = todo.pop()
        cost += x[i] != y[j]
        p, q = below_x[i], below_y[j]
        if len(p) * len(q) <= SHORT and not any(below_x[k] for k in p) and not any(below_y[k] for k in q):
            cost += _sequence_distance([x[k] for k in p], [y[k] for k in q])
        elif len(p) == len(q):
            todo.extend(zip(p, q, strict=True))
        else:
            return None
    return cost if cost <= most else None


class _Tree:
    """Labels in postorder and, for each node, the place of its first leaf; read the other way round where that is asked for."""

    def __init__(self, label: list[int], kids: list[list[int]]):
        n = len(label)
        self.size = n
        self.label, self.first = np.array(label[::-1]), np.zeros(n, np.int64)
        for k in range(n - 1, -1, -1):  # the walk above, reversed, is the postorder
            self.first[n - 1 - k] = self.first[n - 1 - kids[k][-1]] if kids[k] else n - 1 - k
        self.mirror = None
        if n:
            order, stack = [], [0]
            while stack:
                k = stack.pop()
                order.append(k)
                stack.extend(kids[k])
            place = {k: n - 1 - i for i, k in enumerate(order)}
            self.mirror = np.array([label[k] for k in reversed(order)]), np.zeros(n, np.int64)
            for k in reversed(range(n)):
                self.mirror[1][place[k]] = self.mirror[1][place[kids[k][0]]] if kids[k] else place[k]

    def way(self, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        return self.mirror if mirrored else (self.label, self.first)

    def roots(self, mirrored: bool) -> np.ndarray:
        """The last node on each path of first children."""
        first = self.way(mirrored)[1]
        return np.sort(len(first) - 1 - np.unique(first[::-1], return_index=True)[1])

    def work(self, mirrored: bool) -> int:
        first, r = self.way(mirrored)[1], self.roots(mirrored)
        return int((r - first[r] + 1).sum())


def tree_distance(a: dict, b: dict) -> tuple[int, int]:
    """Ordered tree edit distance with unit costs, and the larger tree's size.

    No way is shorter than the difference of sizes or of bags of labels, nor longer than children changed in their places:
    where these meet, that is all, and leaves below equal roots are sequences. Else the forests of each pair of paths' last nodes are compared row by row,
    along first or along last children, whichever is less work; on arrays where rows are long enough to gain by it.
    """
    names: dict[str, int] = {}
    walks = _walked(a, names), _walked(b, names)
    (x, below_x), (y, below_y) = walks
    n = max(len(x), len(y))
    if x[0] == y[0] and len(x) * len(y) <= SHORT and len(below_x[0]) == len(x) - 1 and len(below_y[0]) == len(y) - 1:
        return _sequence_distance(x[1:], y[1:]), n  # equal roots always stay, and all below are leaves
    least = n - (Counter(x) & Counter(y)).total()
    if _one_way(*walks, least) is not None:
        return least, n
    one, other = _Tree(*walks[0]), _Tree(*walks[1])
    if one.size == other.size and (one.first == other.first).all() and int((one.label != other.label).sum()) == least:
        return least, n
    mirrored = one.work(True) * other.work(True) < one.work(False) * other.work(False)
    (x, xf), (y, yf) = one.way(mirrored), other.way(mirrored)
    if other.work(mirrored) < LONG * len(other.roots(mirrored)):
        return _short_rows(*(v.tolist() for v in (x, xf, y, yf, one.roots(mirrored), other.roots(mirrored)))), n
    dist = np.zeros((len(x), len(y)), np.int64)
    for i in one.roots(mirrored):
        for j in other.roots(mirrored):
            lo, at = yf[j], np.arange(yf[j], j + 1)
            steps = np.arange(len(at) + 1)
            rows = np.zeros((i - xf[i] + 2, len(at) + 1), np.int64)
            rows[0] = steps
            spine, back = yf[at] == lo, yf[at] - lo
            for s in range(xf[i], i + 1):
                p = s - xf[i] + 1
                whole = rows[xf[s] - xf[i], back] + dist[s, lo : j + 1]
                if xf[s] == xf[i]:
                    whole = np.where(spine, rows[p - 1, :-1] + (y[at] != x[s]), whole)
                row = np.empty_like(steps)
                row[0] = p
                row[1:] = np.minimum(rows[p - 1, 1:] + 1, whole)
                rows[p] = np.minimum.accumulate(row - steps) + steps
                if xf[s] == xf[i]:
                    dist[s, at[spine]] = rows[p, 1:][spine]
    return int(dist[-1, -1]), n


def _short_rows(x: list[int], xf: list[int], y: list[int], yf: list[int], one: list[int], other: list[int]) -> int:
    """The same on lists."""
    dist = [[0] * len(y) for _ in x]
    for i in one:
        for j in other:
            lo, top = yf[j], xf[i]
            rows = [list(range(j - lo + 2))]
            for s in range(top, i + 1):
                before, from_s, row = rows[-1], dist[s], [len(rows)]
                jump, spine, label = rows[xf[s] - top], xf[s] == top, x[s]
                last = len(rows)
                for q in range(lo, j + 1):
                    k = q - lo
                    on_both = spine and yf[q] == lo
                    way = before[k] + (y[q] != label) if on_both else jump[yf[q] - lo] + from_s[q]
                    last = min(way, before[k + 1] + 1, last + 1)
                    if on_both:
                        from_s[q] = last
                    row.append(last)
                rows.append(row)
    return dist[-1][-1]


def tree_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the larger size, for whole documents or single nodes. Give it distinct pairs.

    0 where a side is missing, no JSON, nested deeper than the JSON reader goes, or no tree of nodes with a type t.
    """

    def one(s, t):
        try:
            d, n = tree_distance(json.loads(s), json.loads(t))
        except (TypeError, ValueError, AttributeError, KeyError, RecursionError):
            return 0.0
        return 1 - d / n

    @F.pandas_udf("double")
    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(s, t) for s, t in zip(a, b, strict=True)], dtype="float64")

    return work(a, b)


def nest(lines: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows as an ordered array of structs per key."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    return lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def connected(pairs: DataFrame, nodes: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, key, component) of links a, b inside documents: union-find per document, which holds a document's nodes and none of its links. Very many documents share a batch."""
    both = nodes.select(doc, F.col(key).alias("a"), F.col(key).alias("b")).unionByName(pairs.select(doc, "a", "b"))
    kind = dict(nodes.dtypes)[key]

    def find(root: dict, k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def step(root: dict, a, b) -> dict:
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
        return root

    found = folded(both, [doc], [], ["a", "b"], {"found": f"array<struct<k:{kind},c:{kind}>>"}, dict, step, lambda root: ([{"k": k, "c": find(root, k)} for k in root],))
    return found.select(doc, F.explode("found").alias("f")).select(doc, F.col("f.k").alias(key), F.col("f.c").alias("component"))


def average_linkage(affinity: DataFrame, doc: str, least: float = 0.5) -> DataFrame:
    """(doc, i, cluster) from pair affinities (doc, i, j, p): the two clusters with the largest mean affinity above the limit join, until none is left.

    Pairs that aren't there count 0, pairs given both ways are added. A cluster is named by its least member. No join brings
    clusters nearer to a third than both were, so each chain of nearest neighbours ends in two clusters that the full
    search would join as well: they join at once, and a cluster whose nearest is within the limit is done. Only neighbours
    are kept, so memory follows the pairs given. Of equally near clusters the last in the chain comes first, then the least.
    """
    kind = dict(affinity.dtypes)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["i"] != pdf["j"]].drop_duplicates(["i", "j"], keep="last")
        near: dict = {k: {} for k in sorted({*pdf["i"], *pdf["j"]})}
        for i, j, p in zip(pdf["i"], pdf["j"], pdf["p"], strict=True):
            near[i][j] = near[j][i] = near[i].get(j, 0.0) + p
        ids, size, root, chain = list(near), dict.fromkeys(near, 1), {k: k for k in near}, []
        while near:
            if not chain:
                chain.append(next(iter(near)))
            c, before = chain[-1], chain[-2] if len(chain) > 1 else None
            best = max(((t / (size[c] * size[n]), n == before) for n, t in near[c].items()), default=(least, False))
            if best[0] <= least:
                for n in near.pop(c):
                    del near[n][c]
                chain.pop()
            elif not best[1]:
                chain.append(min(n for n, t in near[c].items() if t / (size[c] * size[n]) == best[0]))
            else:
                a, b = min(c, before), max(c, before)
                for n, t in near.pop(b).items():
                    del near[n][b]
                    if n != a:
                        near[a][n] = near[n][a] = near[a].get(n, 0.0) + t
                size[a] += size[b]
                root[b] = a
                del chain[-2:]
        found = []
        for k in ids:  # a root is less than what it roots, so it is known by then
            root[k] = root[root[k]] if root[k] != k else k
            found.append(root[k])
        return pd.DataFrame({doc: [pdf[doc].iloc[0]] * len(ids), "i": ids, "cluster": found}) if ids else pd.DataFrame({doc: [], "i": [], "cluster": []})

    return affinity.groupBy(doc).applyInPandas(work, f"{doc} {kind[doc]}, i {kind['i']}, cluster {kind['i']}")


def repair_json(text: Column) -> Column:
    """From the first brace to the last, without trailing commas, with open brackets closed. Null if there is no brace."""
    start = F.nullif(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(""))
    cut = F.coalesce(F.nullif(F.regexp_extract(start, r"(?s)^\{.*[\]}]", 0), F.lit("")), start)
    fixed = F.regexp_replace(cut, r",\s*([\]}])", "$1")
    closing = F.aggregate(
        F.split(F.regexp_replace(fixed, r'"(\\.|[^"\\])*"|[^\[\]{}]', ""), ""),
        F.lit(""),
        lambda a, c: F.when(c == "{", F.concat(F.lit("}"), a)).when(c == "[", F.concat(F.lit("]"), a)).when(c.isin("}", "]"), F.substring(a, 2, 1 << 30)).otherwise(a),
    )
    return F.when(F.try_parse_json(fixed).isNotNull(), fixed).otherwise(F.concat(fixed, closing))


def score_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows through a user's batch function, made once per task: make() -> f(pandas) -> pandas."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for pdf in batches:
            yield f(pdf)

    return df.mapInPandas(work, schema)


def with_fallback(df: DataFrame, engines: list[tuple[str, object]], value: str) -> DataFrame:
    """Columns output, engine, stage, fell_back, error, elapsed_ms: each row by the first engine whose function doesn't fail.

    A batch goes through the first engine, and what fails through the next one, and so on. stage counts engines from 0 (null
    where all fail), error is the last failure before, elapsed_ms the time of all engines tried.
    """
    import time

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

    made = {"output": StringType(), "engine": StringType(), "stage": IntegerType(), "fell_back": BooleanType(), "error": StringType(), "elapsed_ms": DoubleType()}
    df = df.drop(*made)
    schema = StructType([*df.schema.fields, *(StructField(n, t) for n, t in made.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(value).to_pylist()
            rows = [[None, None, None, True, None, 0.0] for _ in values]
            left = range(len(values))
            for k, (name, f) in enumerate(engines):
                failed = []
                for i in left:
                    began = time.perf_counter()
                    try:
                        rows[i][:4] = f(values[i]), name, k, k > 0
                    except Exception as e:  # an engine's failure is a row's result
                        rows[i][4] = f"{name}: {e}"
                        failed.append(i)
                    rows[i][5] += 1000 * (time.perf_counter() - began)
                left = failed
            columns = zip(*rows, strict=True) if rows else ([] for _ in made)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, to_arrow_type(t)) for c, t in zip(columns, made.values(), strict=True))], names=[*b.schema.names, *made])

    return df.mapInArrow(work, schema)
