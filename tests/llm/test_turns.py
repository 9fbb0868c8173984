"""Conversation repair against a plain search over whole conversations: faults, ties, nulls, long conversations cut into blocks."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from annomill.llm import turns
from annomill.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """rows: (conv_id, turn, role, text). By conversation: (turn, role, text) in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        own.extend([(turn, role, text)] * (2 if k == 3 else 1))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.strip(SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """(cost, letters, repaired) by a table over all rows and states of the best (cost, letters, rows)."""
    nxt = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}
    better = lambda a, b: b is None or a[:2] < b[:2]

    def insert(t):
        for _ in range(4):
            for q, (c, l, r) in list(t.items()):
                for role in ("user", "assistant"):
                    if role[0] in nxt[q]:
                        new = (c + 5, l + "I", (*r, (role, "")))
                        if better(new, t.get(nxt[q][role[0]])):
                            t[nxt[q][role[0]]] = new
        return t

    best = insert(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        then = {}

        def put(q, new):
            if better(new, then.get(q)):
                then[q] = new

        for q, (c, l, r) in best.items():
            put(q, (c + 2, l + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] in nxt[q]:
                put(nxt[q][role[:1]], (c + more, l + "K", (*r, (role, text))))
            for other in ("user", "assistant"):
                if other[0] in nxt[q]:
                    put(nxt[q][other[0]], (c + 1 + more, l + "R", (*r, (other, text))))
        best = insert(then)
    return min((v for q, v in best.items() if q in ("", "a")), key=lambda v: v[:2])


def plain_report(conv, rows):
    faults = plain_faults(rows)
    t = [r[0] for r in rows if r[0] is not None]
    first = [r[1][:1] for r in rows]
    cost, letters, kept = plain_repair(rows, faults)
    return (conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, letters, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())


RNG = np.random.default_rng(11)
ROLES = ["user", "assistant", "system", "tool", "user", "assistant", None, "ustad", "", "Ünï"]
TEXTS = ["Yes.", "No!", "cut off", "", " \t\n", None, "Same.", "x? \r\n", "nbsp\xa0", "日本。", "long. " * 500]


def conversation(conv, n, plainly=False):
    usual = ["user", "assistant"]
    return [(conv, int(RNG.integers(0, 2 * n)) if RNG.random() > 0.1 else None, (usual[k % 2] if plainly else ROLES[RNG.integers(len(ROLES))]), TEXTS[RNG.integers(len(TEXTS))] if RNG.random() < 0.4 else f"text {k}.") for k in range(n)]


ROWS = [r for c in range(120) for r in conversation(c, int(RNG.integers(1, 12)), c % 2 == 0)]
ROWS += conversation(None, 9) + conversation(1000, 150) + [(1001, 3, "user", "Same again.")] * 40 + [(1002, None, "user", None)] * 3
for r in [(2000 + i, 7, "user", "Gone.") for i in range(60)]:
    ROWS.append(r)


@pytest.mark.parametrize("rows, size", [(1024, 4_000_000), (7, 4_000_000), (50, 60)])
def test_report(spark, monkeypatch, rows, size):
    monkeypatch.setattr(turns, "ROWS", rows)
    monkeypatch.setattr(turns, "BYTES", size)
    table = spark.createDataFrame([(*r, "other", 5) for r in ROWS], "conv_id long, turn long, role string, text string, part string, block int").repartition(3)
    cut = turns.blocks(turns.judged(turns.damage(table)))
    got = sorted((tuple(r) for r in turns.report(cut).collect()), key=repr)
    damaged = plain_damage(ROWS)
    assert any(not v for v in damaged.values())
    assert got == sorted((plain_report(c, v) for c, v in damaged.items()), key=repr)
    assert turns.report(cut).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = defaultdict(list)
    for r in turns.repaired(turns.solve(cut)).orderBy("part", "block", "place").collect():
        whole[r.conv].append((r.role, r.text))
    for c, v in damaged.items():
        assert tuple(whole[c]) == plain_repair(v, plain_faults(v))[2]


def test_least_letters_among_all_ways():
    """All edit strings of short conversations, tried out."""
    for _ in range(150):
        rows = [(k, ["user", "assistant", "system", "tool"][RNG.integers(4)], ["Yes.", "cut", "", "Yes."][RNG.integers(4)]) for k in range(int(RNG.integers(0, 5)))]
        faults = plain_faults(rows)
        found = []
        for n in range(len(rows) + 4):
            for way in itertools.product("DIKR", repeat=n):
                if sum(x != "I" for x in way) != len(rows):
                    continue
                for picks in itertools.product("ua", repeat=sum(x in "IR" for x in way)):
                    pick, i, cost, out = iter(picks), 0, 0, ""
                    for x in way:
                        f = "" if x == "I" else faults[i]
                        if x != "D" and f in ("blank", "duplicate"):
                            break
                        out += "" if x == "D" else rows[i][1][0] if x == "K" else next(pick)
                        cost += {"D": 2, "I": 5, "K": 0, "R": 1}[x] + (5 if x in "KR" and f == "truncated" else 0)
                        i += x != "I"
                    else:
                        if re.fullmatch("(s?(ua)+)?", out):
                            found.append((cost, "".join(way)))
        faults_ = [["", "blank", "duplicate", "truncated"].index(f) for f in faults]
        letters, _ = turns.walk([r[1][:1] for r in rows], faults_, turns.inserted(turns.END), turns.START, True)
        assert (plain_repair(rows, faults)[0], letters) == min(found) == plain_repair(rows, faults)[:2]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.report(turns.blocks(turns.judged(turns.damage(none)))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_turn_repair"](spark, sf).collect()), key=repr)
    assert got == sorted((plain_report(c, v) for c, v in plain_damage(rows).items()), key=repr)
