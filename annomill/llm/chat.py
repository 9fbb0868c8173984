r"""Chat formatting of reply trees.

Messages are rows (tree_id, node_id, parent_id, role, text, score). Root-to-leaf paths come from iterative self-joins
that double their reach: a table of jumps (node, its ancestor 2^k up) is joined with itself, and the path members found
so far (leaf, node) are joined with the jumps, so a tree of depth d takes log2(d) rounds, and the rows are the paths' own
nodes. Branches are ranked by their mean score (ties: by leaf), the best `keep` of each tree are taken (None: all), and
each is formatted as one conversation:

    <|turn|>role
    text<|end|>

In roles and texts a backslash is put before each backslash and between "<" and "|"; in roles a line feed is "\n". So no
control string can occur inside a turn, and the text is found again exactly. loss_spans has, for each assistant turn, the
code points [start, end) of its escaped text.

Rows with a null tree id are one tree, as joins compare it within a struct, which is never null; rows with a null node id
are on no path. A parent that isn't there makes its child a root; nodes on or below a cycle are on no path. Null role or text is empty,
null score 0. Of rows with one tree and node id, the least (parent, role, text) counts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, stored

#: Fixed values of the template.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the loss spans."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse_turns(text: str) -> list[tuple[str, str]]:
    """format_turns backwards."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def _keyed(df: DataFrame) -> DataFrame:
    """tree_id as a struct of itself, so that null ids meet in joins."""
    return df.withColumn("tree_id", F.struct("tree_id"))


def _plain(df: DataFrame) -> DataFrame:
    """_keyed backwards."""
    return df.withColumn("tree_id", F.col("tree_id.tree_id"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf, node_id, up): up is the number of steps from the leaf to the node."""
    nodes = stored(_keyed(messages).groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id")), "nodes")
    known = nodes.select("tree_id", F.col("node_id").alias("parent_id"))
    #: only parents that exist; null ids equal no other
    jumps = stored(nodes.join(known.hint("merge"), ["tree_id", "parent_id"]).select("tree_id", "node_id", F.col("parent_id").alias("ancestor")), "jumps")
    parents = jumps.select("tree_id", F.col("ancestor").alias("node_id")).distinct()
    members = nodes.join(parents.hint("merge"), ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up"))
    rounds, reach = nodes.count().bit_length() + 1, 1
    for _ in range(rounds):
        if jumps.isEmpty():
            break
        more = members.join(jumps.hint("merge"), ["tree_id", "node_id"]).select("tree_id", "leaf", F.col("ancestor").alias("node_id"), (F.col("up") + reach).alias("up"))
        members = stored(members.unionByName(more), "members")
        second = jumps.select("tree_id", F.col("node_id").alias("ancestor"), F.col("ancestor").alias("further"))
        jumps = stored(jumps.join(second.hint("merge"), ["tree_id", "ancestor"]).select("tree_id", "node_id", F.col("further").alias("ancestor")), "jumps")
        reach *= 2
    else:  # what still has ancestors this far up runs in a circle
        endless = jumps.select("tree_id", F.col("node_id").alias("leaf")).distinct()
        members = members.join(endless.hint("merge"), ["tree_id", "leaf"], "left_anti")
    return _plain(members)


def conversations(messages: DataFrame, *, keep: int | None = 1) -> DataFrame:
    """(tree_id, leaf, rank, n_turns, score, text, loss_spans): the chosen branches, formatted."""
    said = stored(_keyed(messages).groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("x")), "said")
    on_path = _keyed(stored(paths(messages), "paths"))
    #: ranked by scores alone; texts join the chosen branches
    scored = on_path.join(said.select("tree_id", "node_id", "x.score").hint("merge"), ["tree_id", "node_id"]).groupBy("tree_id", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n_turns"))
    if keep is not None:
        chosen = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf"))).filter(F.col("rank") <= keep)
    else:
        chosen = scored.withColumn("rank", F.lit(None).cast("int"))
    chosen = stored(chosen, "chosen")
    kept = on_path.join(chosen.select("tree_id", "leaf").hint("merge"), ["tree_id", "leaf"]).join(said.hint("merge"), ["tree_id", "node_id"])
    turns = kept.groupBy("tree_id", "leaf").agg(F.collect_list(F.struct((-F.col("up")).alias("at"), "x.role", "x.text")).alias("turns"))
    branches = _plain(chosen.join(turns.hint("merge"), ["tree_id", "leaf"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in sorted(turns, key=lambda t: t["at"])]) for turns in b.column("turns").to_pylist()]
            spans = pa.array([[{"start": i, "end": j} for i, j in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            kept = [b.column(k) for k in ("tree_id", "leaf", "rank", "n_turns", "score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t for t, _ in made], pa.string()), spans], names=["tree_id", "leaf", "rank", "n_turns", "score", "text", "loss_spans"])

    kinds = {f.name: f.dataType.simpleString() for f in branches.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("tree_id", "leaf", "rank", "n_turns", "score")) + ", text string, loss_spans array<struct<start: bigint, end: bigint>>"
    return branches.mapInArrow(work, schema)


def linear(rows: DataFrame) -> DataFrame:
    """Messages from rows (conv_id, turn, role, text): each conversation is one branch, in the order of turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from text and loss_spans alone."""
    schema = "tree_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column("text").to_pylist(), b.column("loss_spans").to_pylist()
            turns = [parse_turns(t) for t in texts]
            loss = ["".join(unescape(t[s["start"] : s["end"]]) for s in x) for t, x in zip(texts, spans, strict=True)]
            yield batch(schema, tree_id=b.column("tree_id"), n_turns=[len(x) for x in turns], turns_sha256=[sha("".join(f"{r}\n{t}\n" for r, t in x)) for x in turns], loss_chars=[len(x) for x in loss], loss_sha256=[sha(x) for x in loss], formatted_chars=[len(t) for t in texts])

    return formatted.select(F.col("tree_id").cast("long"), "text", "loss_spans").mapInArrow(work, schema)
