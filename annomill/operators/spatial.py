"""Joins of boxes, so that one document's boxes are many tasks' work and never all pairs.

Boxes of a document of up to FEW boxes meet by the document alone: each side is shuffled once, by document, and what is
grouped by it afterwards needs no shuffle. Boxes of a larger document meet through grid cells. A document's cells are twice its boxes' mean size, and no smaller than its extent over the root of its number of boxes, so
no box covers more cells than the document has boxes. A box is a row for each cell it touches (about two on average); boxes
meet in a cell, and a pair that shares several is reported in that cell alone which holds the lower corner of what the two
have in common. Extents are closed: boxes that touch meet. Boxes with an unknown or infinite bound or a negative size meet
nothing, nor do boxes of a null document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annomill.functions.numeric import Box, dist_to_box
from annomill.session import stored

#: x0, y0, x1, y1
Extent = tuple[Column, Column, Column, Column]
BOUNDS = ("x0", "y0", "x1", "y1")
#: Boxes of both sides up to which a document's pairs are all looked at.
FEW = 128


def extent(b: Box, pad: Column | float = 0.0) -> Extent:
    return b.x - pad, b.y - pad, b.x + b.w + pad, b.y + b.h + pad


def point(x: Column, y: Column, reach: Column | float = 0.0) -> Extent:
    return x - reach, y - reach, x + reach, y + reach


def bounded(df: DataFrame, e: Extent, side: str) -> DataFrame:
    """df with the bounds as columns; rows without a proper extent go."""
    out = df.withColumns({f"__{side}_{n}": c.cast("double") for n, c in zip(BOUNDS, e, strict=True)})
    x0, y0, x1, y1 = (F.col(f"__{side}_{n}") for n in BOUNDS)
    return out.filter((x0 <= x1) & (y0 <= y1) & (x0 > float("-inf")) & (y0 > float("-inf")) & (x1 < float("inf")) & (y1 < float("inf")))


def cells(left: DataFrame, right: DataFrame, doc: str, a: Extent, b: Extent) -> DataFrame:
    """(doc, __cw, __ch): the cell size of each document of more than FEW boxes."""
    sides = [bounded(df, e, "s").select(doc, *(f"__s_{n}" for n in BOUNDS)) for df, e in ((left, a), (right, b))]
    size = lambda lo, hi: F.greatest(2 * F.avg(F.col(hi) - F.col(lo)), (F.max(hi) - F.min(lo)) / F.sqrt(F.count("*")))
    found = sides[0].unionByName(sides[1]).groupBy(doc).agg(size("__s_x0", "__s_x1").alias("__cw"), size("__s_y0", "__s_y1").alias("__ch"), F.count("*").alias("__n")).filter(F.col("__n") > FEW)
    some = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0).alias(c)
    return stored(found.select(doc, some("__cw"), some("__ch")), "cells")


def _dealt(df: DataFrame, e: Extent, side: str, doc: str, grid: DataFrame) -> DataFrame:
    at = lambda n, c: F.floor(F.col(f"__{side}_{n}") / F.col(c))
    placed = bounded(df, e, side).join(grid, doc)
    placed = placed.withColumn("__cx", F.explode(F.sequence(at("x0", "__cw"), at("x1", "__cw"))))
    return placed.withColumn("__cy", F.explode(F.sequence(at("y0", "__ch"), at("y1", "__ch"))))


def meeting(left: DataFrame, right: DataFrame, doc: str, a: Extent, b: Extent, grid: DataFrame | None = None) -> DataFrame:
    """Rows of left with rows of right of the same document whose extents meet, each pair once. Apart from doc, no column has the same name on both sides."""
    c = {f"{s}_{n}": F.col(f"__{s}_{n}") for s in "ab" for n in BOUNDS}
    meets = (c["a_x0"] <= c["b_x1"]) & (c["b_x0"] <= c["a_x1"]) & (c["a_y0"] <= c["b_y1"]) & (c["b_y0"] <= c["a_y1"])
    columns = [doc, *(x for x in left.columns if x != doc), *(x for x in right.columns if x != doc)]
    few = None
    if grid is None:
        grid = cells(left, right, doc, a, b)
        some = grid.isEmpty()
        one, other = (_few(bounded(df, e, side), doc, None if some else grid) for df, e, side in ((left, a, "a"), (right, b, "b")))
        few = one.join(other.hint("merge"), doc).filter(meets).select(*columns)
        if some:
            return few
    one, other = _dealt(left, a, "a", doc, grid), _dealt(right, b, "b", doc, grid).drop("__cw", "__ch")
    both = one.join(other.hint("merge"), [doc, "__cx", "__cy"])
    here = (F.floor(F.greatest(c["a_x0"], c["b_x0"]) / F.col("__cw")) == F.col("__cx")) & (F.floor(F.greatest(c["a_y0"], c["b_y0"]) / F.col("__ch")) == F.col("__cy"))
    many = both.filter(meets & here).select(*columns)
    return many if few is None else few.unionByName(many)


def _few(df: DataFrame, doc: str, grid: DataFrame | None) -> DataFrame:
    """Rows of documents without cells."""
    return df if grid is None else df.join(grid.select(doc), doc, "left_anti")


def nearest(points: DataFrame, boxes: DataFrame, doc: str, key: str, x: Column, y: Column, b: Box, rank: list[Column], keep: list[str]) -> DataFrame:
    """(doc, key, keep): the nearest box of each point, ties by rank, in documents of many boxes in rounds of fourfold reach and cells; points of documents without a box get none.

    A round's answer is exact where its distance is within the reach, and only the other points go on.
    """
    grid = cells(points, boxes, doc, point(x, y), extent(b))
    far, some = dist_to_box(x, y, b), grid.isEmpty()
    bare = lambda df, e: bounded(df, e, "p").drop(*(f"__p_{n}" for n in BOUNDS))
    best_of = lambda df: df.groupBy(doc, key).agg(F.min_by(F.struct(*keep), F.struct("__far", *rank)).alias("__m")).select(doc, key, *(F.col("__m")[c].alias(c) for c in keep))
    one, other = bare(points, point(x, y)), bare(boxes, extent(b))
    found = best_of(_few(one, doc, None if some else grid).join(other.hint("merge"), doc).withColumn("__far", far))
    if some:
        return found
    rest = stored(one.join(other.select(doc).distinct().hint("merge"), doc, "left_semi").join(grid.select(doc, F.greatest("__cw", "__ch").alias("__reach")), doc), "rest")
    while not rest.isEmpty():
        square = grid.select(doc, F.greatest("__cw", "__ch").alias("__cw"), F.greatest("__cw", "__ch").alias("__ch"))
        near = meeting(rest, boxes, doc, point(x, y, F.col("__reach")), extent(b), square).withColumn("__far", far).filter(F.col("__far") <= F.col("__reach"))
        best = stored(best_of(near), "near")
        found = found.unionByName(best)
        rest = stored(rest.join(best.select(doc, key).hint("merge"), [doc, key], "left_anti").withColumn("__reach", 4 * F.col("__reach")), "rest")
        grid = grid.select(doc, *((4 * F.col(c)).alias(c) for c in ("__cw", "__ch")))
    return found
