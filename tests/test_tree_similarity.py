"""Tree edit distance of whole documents against a plain recursion, and its bounds."""

import json
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from annomill.operators import trees as R

RNG = np.random.default_rng(3)
KINDS = ["text", "btn", "icon", "img", "divider"]


def leaf():
    n = {"t": KINDS[RNG.integers(len(KINDS))]}
    if n["t"] == "icon":
        n["name"] = ["menu", "add"][RNG.integers(2)]
    if n["t"] == "text" and RNG.random() < 0.5:
        n["s"] = ["body", "title"][RNG.integers(2)]
    if n["t"] == "btn" and RNG.random() < 0.5:
        n["variant"] = ["primary", "plain"][RNG.integers(2)]
    return n


def node(depth=0):
    if depth > 2 or RNG.random() < 0.5:
        return leaf()
    if RNG.random() < 0.2:
        return {"t": "list", "n": 3, "item": node(depth + 1)}
    return {"t": ["col", "row", "card"][RNG.integers(3)], "c": [node(depth + 1) for _ in range(RNG.integers(0, 4))]}


def screen():
    s = {"id": "a", "title": "A", "body": node()}
    if RNG.random() < 0.5:
        s["appbar"] = {"t": "appbar", "icons": [leaf() for _ in range(RNG.integers(0, 3))]} if RNG.random() < 0.7 else {"t": "appbar"}
    if RNG.random() < 0.4:
        s["bottomnav"] = {"t": "bottomnav", "items": [{"icon": "x"}] * int(RNG.integers(1, 4))}
    if RNG.random() < 0.4:
        s["fab"] = {"t": "fab", "icon": "add"}
    return s


def spec():
    return {"v": 1, "screens": [screen() for _ in range(RNG.integers(1, 4))]}


def tree(n):
    """Nested tuples (label, children)."""
    if "screens" in n:
        return "app", tuple(("screen", tuple([*([("appbar", tuple(tree(i) for i in s["appbar"].get("icons", [])))] if "appbar" in s else []), ("body", (tree(s["body"]),)), *([("bottomnav", (("navitem", ()),) * len(s["bottomnav"]["items"]))] if "bottomnav" in s else []), *([("fab", ())] if "fab" in s else [])])) for s in n["screens"])
    label = {"text": f"text:{n.get('s', 'body')}", "btn": f"btn:{n.get('variant', 'primary')}", "icon": f"icon:{n.get('name')}"}.get(n["t"], n["t"])
    return label, tuple(tree(k) for k in (n.get("c") or ([n["item"]] if "item" in n else [])))


@cache
def size(forest):
    return sum(1 + size(kids) for _, kids in forest)


@cache
def plain(a, b):
    """Forest distance by its definition, from the right."""
    if not a or not b:
        return size(a) + size(b)
    (x, xs), (y, ys) = a[-1], b[-1]
    return min(plain(a[:-1] + xs, b) + 1, plain(a, b[:-1] + ys) + 1, plain(a[:-1], b[:-1]) + plain(xs, ys) + (x != y))


def changed(s):
    s = json.loads(json.dumps(s))
    for x in s["screens"]:
        if RNG.random() < 0.5:
            x["body"] = {"t": "col", "c": [x["body"], leaf()]} if RNG.random() < 0.5 else node()
    return s


@pytest.mark.parametrize("long", [1, 48])
def test_whole_documents(monkeypatch, long):
    monkeypatch.setattr(R, "LONG", long)
    for k in range(200):
        a = spec()
        b = changed(a) if k % 2 else spec()
        d, n = R.tree_distance(a, b)
        x, y = (tree(a),), (tree(b),)
        assert (d, n) == (plain(x, y), max(size(x), size(y)))
        plain.cache_clear()


def test_screens_slots_and_defaults_count():
    one = {"v": 1, "screens": [{"body": {"t": "col", "c": [{"t": "btn"}, {"t": "img"}]}}]}
    two = {"v": 1, "screens": [{"body": {"t": "text"}}, {"body": {"t": "text"}}]}
    assert R.tree_distance(one, two) == (6, 7)  # a screen, body and text are new; col becomes a text, its two leaves go
    assert R.tree_distance({"t": "text"}, {"t": "text", "s": "body"})[0] == R.tree_distance({"t": "btn"}, {"t": "btn", "variant": "primary"})[0] == 0
    assert R.tree_distance({"t": "icon", "name": "a"}, {"t": "icon", "name": "b"})[0] == 1


def test_column(spark):
    deep = '{"t":"col","c":[' * 3000 + '{"t":"text"}' + "]}" * 3000
    too_deep = '{"t":"col","c":[' * 200_000
    rows = [(json.dumps(spec()), "{"), (None, "{}"), ("[]", "[]"), ('{"t":"text"}', '{"t":"text","s":"body"}'), (deep, deep), (too_deep, too_deep), ('{"screens":[]}', '{"screens":[]}'), ('{"screens":[{}]}', '{"screens":[{}]}')]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(R.tree_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:4] == [0.0, 0.0, 0.0, 1.0] and got[4] in (0.0, 1.0) and got[5:] == [0.0, 1.0, 0.0]


def test_large_documents_take_seconds():
    wide = {"v": 1, "screens": [{"body": {"t": "col", "c": [{"t": "card", "c": [leaf() for _ in range(9)]} for _ in range(40)]}}]}
    other = json.loads(json.dumps(wide))
    other["screens"][0]["body"]["c"][3:9] = [leaf() for _ in range(9)]
    d, n = R.tree_distance(wide, other)
    assert 0 < d <= 75 and n == 404


def test_leaves_and_children_in_their_places_need_no_full_search(monkeypatch):
    """Where bounds meet, or all below equal roots are leaves, the distance is known without comparing forests; it is the same as by the full search."""
    flat = lambda n: {"t": "col", "c": [leaf() for _ in range(n)]}
    less = lambda n: {"t": n["t"], "c": [x for k, x in enumerate(n["c"]) if k % 4]}
    bodies = [flat(int(n)) for n in RNG.integers(0, 14, 40)]
    pairs = [*zip(bodies, bodies[1:], strict=False), *(({"t": "row", "c": [a, b]}, {"t": "row", "c": [less(a), b]}) for a, b in zip(bodies, bodies[1:], strict=False))]
    monkeypatch.setattr(R, "_one_way", lambda *_: None)
    monkeypatch.setattr(R, "SHORT", -1)
    full = [R.tree_distance(a, b) for a, b in pairs]
    monkeypatch.undo()
    monkeypatch.setattr(R, "_Tree", None)  # the full search would fail
    assert [R.tree_distance(a, b) for a, b in pairs] == full
