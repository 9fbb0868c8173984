"""Folds over rows in order: partitions are sorted by Spark, and one small state is carried from row to row of a group.

Of carried() and folded() only a group's state is held, never its rows, so a document of any length is read once, in
linear time; sorting spills to disk like any other sort. A group is one task's work, as each step needs the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def _kinds(df: DataFrame, outputs: dict[str, str]) -> list[StructField]:
    return StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in outputs.items())).fields


def _sorted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def carried(df: DataFrame, keys: list[str], order: list, inputs: list[str], outputs: dict[str, str], start: Callable[[], object], step: Callable) -> DataFrame:
    """df with further columns: step(state, *inputs) gives the next state and a row's outputs; start() is a group's first state."""
    fields = _kinds(df, outputs)
    types = [to_arrow_type(f.dataType) for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, first = None, None, True
        for b in batches:
            made: list[list] = [[] for _ in fields]
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), zip(*(b.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if first or key != group:
                    group, state, first = key, start(), False
                state, out = step(state, *row)
                for column, v in zip(made, out, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(made, types, strict=True))], names=[*b.schema.names, *outputs])

    return _sorted(df.drop(*outputs), keys, order).mapInArrow(work, StructType([*df.drop(*outputs).schema.fields, *fields]))


def folded(df: DataFrame, keys: list[str], order: list, inputs: list[str], outputs: dict[str, str], start: Callable[[], object], step: Callable, finish: Callable) -> DataFrame:
    """A row a group: step(state, *inputs) gives the next state, and finish(state) the outputs of the last one."""
    fields = [*(df.schema[k] for k in keys), *_kinds(df, outputs)]
    types = [to_arrow_type(f.dataType) for f in fields]
    kept = list(dict.fromkeys([*keys, *inputs, *(c for c in order if isinstance(c, str))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, first, done = None, None, True, []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)] if done else [pa.array([], t) for t in types], names=[f.name for f in fields])

        for b in batches:
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), zip(*(b.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if first or key != group:
                    if not first:
                        done.append((*group, *finish(state)))
                    group, state, first = key, start(), False
                state = step(state, *row)
            if len(done) > 10_000:
                yield sent()
                done = []
        if not first:
            done.append((*group, *finish(state)))
        yield sent()

    return _sorted(df.select(*kept), keys, order).mapInArrow(work, StructType(fields))


def grouped(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: dict[str, str], make: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Rows of keys and outputs: make(rows) of each group's inputs, in order. A group's inputs are held, so it is for small groups; very many of them share a batch."""
    fields = [*(df.schema[k] for k in keys), *_kinds(df, outputs)]
    types = [to_arrow_type(f.dataType) for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, done = None, [], []

        def sent() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ([] for _ in types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.name for f in fields])

        for b in batches:
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), zip(*(b.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if held and key != group:
                    done.extend((*group, *r) for r in make(held))
                    held = []
                    if len(done) > 10_000:
                        yield sent()
                        done = []
                group = key
                held.append(row)
        if held:
            done.extend((*group, *r) for r in make(held))
        yield sent()

    return _sorted(df.select(*dict.fromkeys([*keys, *inputs, *order])), keys, order).mapInArrow(work, StructType(fields))
