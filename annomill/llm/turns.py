"""Repair of conversation structure: the cheapest edits that make the roles' initials (s?(ua)+)?, with all ties broken by letters.

A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text seen earlier in its
conversation), truncated (its last other character isn't one of .!?). Edits: K keep (0), R give it the role user or
assistant (1), D delete (2; blank and duplicate rows must go), I insert an empty text of user or assistant anywhere (5);
a truncated row that isn't deleted adds 5. Of the cheapest ways the one whose letters, in order, are ASCII-least is taken.

The programme runs backward over a conversation's rows; its state is what the roles so far end with (nothing, s, u or a).
State-cost vectors are kept only at checkpoints: at the ends of blocks of at most `ROWS` rows and, within a block of n
rows, at every sqrt(n)-th row; walking forward, each stretch's vectors are made again from the checkpoint behind it, and
the least letter among the tight edits is emitted.

So that no conversation is one task's work, rows are sorted by ranges of (conversation, turn, role) and cut into blocks,
each one row of a table. Most conversations are one block. Of the others, a block's costs from any state to any state are
a 4 by 4 matrix, and the checkpoints at the ends of blocks come from the matrices alone (one row of 150 bytes for `ROWS`
rows); each block is walked on its own from all four states, and the walks are put together. Duplicates are found
natively: equal rows are counted before any shuffle, and of each repeated (conversation, role, text) the first turn alone
is joined back. The digests of `report` are sequential by nature: they stream through a conversation's blocks in order,
one block in memory. `repaired` gives the same rows without that.

Order: by turn, nulls first, then by role and by the SHA-256 of role and text; rows equal in all follow one another, the
first of them the original. A null role or text is one space; a null conv_id is a conversation of its own. A conversation
whose rows are all gone (`times` 0) has zero counts, an empty audit and the hash of the empty string. Columns besides are
not used. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows and bytes of text of a block; costs.
ROWS, BYTES = 1024, 4_000_000
REROLE, DELETE, INSERT, TRUNCATED, INF = 1, 2, 5, 5, 1 << 60
#: States: nothing yet, after s, after u, after a. What each role's initial leads to.
START, S, U, A = range(4)
NEXT = {("s", START): S, ("u", START): U, ("u", S): U, ("a", U): A, ("u", A): U}
TO = [U, U, A, U]  # where an inserted or renamed row leads
OK, BLANK, DUPLICATE, CUT = range(4)
END = [0, INF, INF, 0]
SPACE = r"\x20\x09-\x0D"


def inserted(v: list[int]) -> list[int]:
    """The vector when rows may be inserted first."""
    u, a = min(v[U], v[A] + INSERT), min(v[A], v[U] + INSERT)
    return [min(v[START], u + INSERT), min(v[S], u + INSERT), u, a]


def back(v: list[int], initial: str, fault: int) -> list[int]:
    """The vector before a row, from that behind it."""
    if fault in (BLANK, DUPLICATE):
        return inserted([x + DELETE for x in v])
    more, out = (TRUNCATED if fault == CUT else 0), []
    for q in range(4):
        best = min(v[q] + DELETE, v[TO[q]] + REROLE + more)
        to = NEXT.get((initial, q))
        out.append(best if to is None else min(best, v[to] + more))
    return inserted(out)


def matrix(initials: list[str], faults: list[int]) -> list[int]:
    """Costs from each state before the block to each state behind its last row, row by row of 16 numbers."""
    columns = []
    for q in range(4):
        v = [INF] * 4
        v[q] = 0
        for c, f in zip(reversed(initials), reversed(faults), strict=True):
            v = back(v, c, f)
        columns.append(v)
    return [min(columns[j][i], INF) for i in range(4) for j in range(4)]


def walk(initials: list[str], faults: list[int], behind: list[int], state: int, last: bool) -> tuple[str, int]:
    """The letters from this state, and the state behind them; the last block's walk goes on until nothing is owed."""
    n = len(initials)
    step = max(1, math.isqrt(n))
    marks, v = {n: behind}, behind
    for i in range(n - 1, -1, -1):
        v = back(v, initials[i], faults[i])
        if i % step == 0:
            marks[i] = v
    if v[state] >= INF:
        return "", state
    out = []
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        stretch = [marks[hi]]
        for i in range(hi - 1, lo - 1, -1):
            stretch.append(back(stretch[-1], initials[i], faults[i]))
        for i in range(lo, hi):
            now, then, fault = stretch[hi - i], stretch[hi - i - 1], faults[i]
            while True:
                owed = now[state]
                if then[state] + DELETE == owed:
                    out.append("D")
                    break
                if now[TO[state]] + INSERT == owed:
                    out.append("I")
                    state = TO[state]
                    continue
                more = TRUNCATED if fault == CUT else 0
                to = NEXT.get((initials[i], state))
                if to is not None and then[to] + more == owed:
                    out.append("K")
                    state = to
                else:
                    out.append("R")
                    state = TO[state]
                break
    while last and behind[state]:
        out.append("I")
        state = TO[state]
    return "".join(out), state


def edited(letters: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The repaired rows of a block."""
    i = 0
    for x in letters:
        if x in "RI":
            state = TO[state]
            yield "assistant" if state == A else "user", "" if x == "I" else texts[i]
        elif x == "K":
            state = NEXT[roles[i][:1], state]
            yield roles[i], texts[i]
        i += x != "I"


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times): rows with faults by a hash of conversation and turn; times is 0 for a row that is dropped."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(k == 4, "user").otherwise(part("role"))
    return rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"))


def judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times, hash, fault): equal rows are one, `times` of them; fault is the first one's. Rows must have conv, turn, role and text; times is 1 where it is missing."""
    there = F.col("times") > 0 if "times" in rows.columns else F.lit(True)
    of = lambda c, null: F.when(there, F.coalesce(F.col(c), null))
    plain = rows.select("conv", F.when(there, F.col("turn")).alias("turn"), of("role", F.lit(" ")).alias("role"), of("text", F.lit(" ")).alias("text"), F.col("times") if "times" in rows.columns else F.lit(1).alias("times"))
    hashed = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    merged = stored(plain.groupBy("conv", "turn", "role", "text").agg(F.sum("times").cast("long").alias("times")).withColumn("hash", hashed), "turns")
    full, place = F.col("text").rlike(f"[^{SPACE}]"), F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = merged.filter(full).groupBy("conv", "hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.select(F.col("conv").alias("conv_"), F.col("hash").alias("hash_"), "first"), "firsts")
    joined = merged.join(first.hint("merge"), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("hash") == F.col("hash_")), "left")
    whole = F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    fault = F.when(~full, BLANK).when(F.col("first") < place, DUPLICATE).when(~whole, CUT).otherwise(OK)
    return joined.select("conv", "turn", "role", "text", "times", "hash", fault.alias("fault"))


BLOCK = "conv long, part int, block int, whole boolean, roles array<string>, texts array<string>, faults array<int>, matrix array<long>, least long, most long, turns long"
LONGS, INTS, STRINGS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
BLOCK_ARROW = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()), ("roles", STRINGS), ("texts", STRINGS), ("faults", INTS), ("matrix", LONGS), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64())])


class _Block:
    """Rows of one conversation, in order. Texts of rows that must go aren't kept."""

    def __init__(self, conv: int | None, part: int, number: int):
        self.conv, self.part, self.number, self.size = conv, part, number, 0
        self.roles, self.texts, self.faults, self.turns = [], [], [], []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        text = "" if fault in (BLANK, DUPLICATE) else text
        self.size += len(text) + len(role)
        for at, x in ((self.roles, role), (self.texts, text), (self.faults, fault)):
            at.append(x)
        if turn is not None:
            self.turns.append(turn)

    def full(self) -> bool:
        return len(self.roles) >= ROWS or self.size >= BYTES

    def row(self, whole: bool) -> dict:
        m = None if whole else matrix([r[:1] for r in self.roles], self.faults)
        ends = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return {"conv": self.conv, "part": self.part, "block": self.number, "whole": whole, "roles": self.roles, "texts": self.texts, "faults": self.faults, "matrix": m, "least": ends[0], "most": ends[1], "turns": len(set(self.turns))}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, bool]]:
    """Blocks of a sorted partition, and whether each is surely all of its conversation: the first and last ones may go on in other partitions."""
    now, first = None, True
    for b in batches:
        for conv, turn, role, text, times, fault, part in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "times", "fault", "part")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now, now.number == 0 and not first
                    first = False
                now = _Block(conv, part, 0)
            for k in range(times):
                if now.full():
                    yield now, False
                    now = _Block(conv, part, now.number + 1)
                now.add(turn, role, text, DUPLICATE if k and fault != BLANK else fault)
    if now is not None:
        yield now, False


def blocks(rows: DataFrame) -> DataFrame:
    """judged() rows as blocks, in order of (part, block) within a conversation."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.col("hash")]  # nulls come first
    ranged = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held = [], 0
        for block, whole in _cut(batches):
            ready.append(block.row(whole))
            held += len(block.roles) + block.size // 1000
            if held >= 8192:
                yield pa.RecordBatch.from_pylist(ready, BLOCK_ARROW)
                ready, held = [], 0
        yield pa.RecordBatch.from_pylist(ready, BLOCK_ARROW)

    return stored(ranged.mapInArrow(work, BLOCK), "blocks")


def _checkpoints(t: pa.Table) -> pa.Table:
    """A conversation's blocks: the vector behind each, from the matrices of those that follow."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["block"]))
    v = END
    for k, r in enumerate(reversed(rows)):
        m = r.pop("matrix")
        r["behind"], r["last"] = [min(x, INF) for x in (inserted(v) if k == 0 else v)], k == 0
        v = inserted([min(m[4 * i + j] + r["behind"][j] for j in range(4)) for i in range(4)])
    return pa.Table.from_pylist(rows, pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("behind", LONGS), ("last", pa.bool_())]))


def _entries(t: pa.Table) -> pa.Table:
    """A conversation's blocks: the state in which the walk meets each."""
    rows, state = sorted(t.to_pylist(), key=lambda r: (r["part"], r["block"])), START
    for r in rows:
        r["state"], state = state, r.pop("exits")[state]
    return pa.Table.from_pylist(rows, pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("state", pa.int32())]))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        letters, exits = [], []
        for roles, faults, behind, last in zip(*(b.column(c).to_pylist() for c in ("roles", "faults", "behind", "last")), strict=True):
            found = [walk([r[:1] for r in roles], faults, behind, q, last) for q in range(4)]
            letters.append([x for x, _ in found])
            exits.append([q for _, q in found])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "block")), pa.array(letters, STRINGS), pa.array(exits, INTS)], names=["conv", "part", "block", "letters", "exits"])


def _walk_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    behind = inserted(END)
    for b in batches:
        found = [walk([r[:1] for r in roles], faults, behind, START, True)[0] for roles, faults in zip(b.column("roles").to_pylist(), b.column("faults").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([START] * b.num_rows, pa.int32()), pa.array(found, pa.string())], names=[*b.schema.names, "state", "letters"])


KEPT = ["conv", "part", "block", "roles", "texts", "faults", "least", "most", "turns"]


def _solve_whole(cut: DataFrame) -> DataFrame:
    rows = cut.filter("whole").select(*KEPT)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_walk_whole, f"{types}, state int, letters string")


def _solve_split(cut: DataFrame) -> DataFrame:
    split, place = cut.filter(~F.col("whole")), "conv long, part int, block int"

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({c: f"{c}_" for c in ("conv", "part", "block")})
        on = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")) & (F.col("block") == F.col("block_"))
        return left.join(r.hint("merge"), on).drop("conv_", "part_", "block_")

    behind = stored(split.select("conv", "part", "block", "matrix").groupBy("conv").applyInArrow(_checkpoints, f"{place}, behind array<long>, last boolean"), "checkpoints")
    walks = stored(joined(split.select("conv", "part", "block", "roles", "faults"), behind).mapInArrow(_walks, f"{place}, letters array<string>, exits array<int>"), "walks")
    entries = stored(walks.select("conv", "part", "block", "exits").groupBy("conv").applyInArrow(_entries, f"{place}, state int"), "entries")
    taken = joined(walks, entries).select("conv", "part", "block", "state", F.col("letters")[F.col("state")].alias("letters"))
    return joined(split.select(*KEPT), taken)


def solve(cut: DataFrame) -> DataFrame:
    """blocks() with the state that each block's walk starts in, and its letters."""
    return _solve_whole(cut).unionByName(_solve_split(cut))


def repaired(solved: DataFrame) -> DataFrame:
    """(conv, part, block, place, role, text): the repaired rows, in order of (part, block, place); nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.select(["conv", "part", "block", "letters", "state", "roles", "texts"]).to_pylist():
                rows = [{"conv": r["conv"], "part": r["part"], "block": r["block"], "place": k, "role": role, "text": text} for k, (role, text) in enumerate(edited(r["letters"], r["state"], r["roles"], r["texts"]))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())]))

    return solved.mapInArrow(work, "conv long, part int, block int, place int, role string, text string")


class _Report:
    """Counts and digests of one conversation, block by block."""

    PAIRS = ("su", "ua", "au")

    def __init__(self, conv: int | None):
        self.conv, self.letters, self.hash, self.any = conv, [], hashlib.sha256(), False
        self.least = self.most = self.end = None
        self.turns = self.illegal = self.cost = 0
        self.faults = [0] * 4

    def add(self, r: dict) -> None:
        for role in r["roles"]:
            self.illegal += self.end is not None and self.end + role[:1] not in self.PAIRS
            self.end = role[:1]
        for f in r["faults"]:
            self.faults[f] += 1
        if r["least"] is not None:
            self.turns += r["turns"] - (self.most == r["least"])
            self.least, self.most = r["least"] if self.least is None else self.least, r["most"]
        self.letters.append(r["letters"])
        i = 0
        for x in r["letters"]:
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[x] + (TRUNCATED if x in "RK" and r["faults"][i] == CUT else 0)
            i += x != "I"
        for role, text in edited(r["letters"], r["state"], r["roles"], r["texts"]):
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.letters), "repaired_sha256": self.hash.hexdigest()}


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORT_ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPORT.split(", ")])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for b in batches:
        done = []
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            if now is None or now.conv != r["conv"]:
                if now is not None:
                    done.append(now.row())
                now = _Report(r["conv"])
            now.add(r)
        yield pa.RecordBatch.from_pylist(done, REPORT_ARROW)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], REPORT_ARROW)


def report(cut: DataFrame) -> DataFrame:
    """A row for each conversation of blocks(): gaps of turns, faults, pairs of roles out of order, cost, letters and a digest of the repaired rows."""
    split = _solve_split(cut).repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "part", "block")
    return _solve_whole(cut).mapInArrow(_reports, REPORT).unionByName(split.mapInArrow(_reports, REPORT))
