"""Exact areas of overlays of boxes: unions by a sweep over borders, cell by cell.

What a layer covers of a box, of a group or of everything that ranks higher is the area of a union of rectangles. The
rectangles are cut at the borders of grid cells, equal ones of a cell are kept once, and each cell is settled on its own:
unions of groups by a sweep, what one layer covers or hides of boxes on the grid of the cell's borders. Cells that hold too
many rectangles are quartered first. Rows follow the borders of the layers, not their areas, and no group grows with a
layer, only with what is different inside one cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldloom.operators.grid import box_area, candidate_pairs, overlap_area
from fieldloom.session import cut

BOX = ("x0", "y0", "x1", "y1")


def swept_area(boxes: np.ndarray) -> float:
    """Area of the union of boxes (rows x0, y0, x1, y1): the covered length of the sweep line, slab by slab."""
    boxes = boxes[(boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])]
    if not len(boxes):
        return 0.0
    ys = np.unique(boxes[:, [1, 3]])
    low, high = np.searchsorted(ys, boxes[:, 1]), np.searchsorted(ys, boxes[:, 3])
    length, over = np.diff(ys), np.zeros(len(ys) - 1, np.int64)
    n = len(boxes)
    at = np.r_[boxes[:, 0], boxes[:, 2]]
    order = np.argsort(at, kind="stable")
    total, line, last = 0.0, 0.0, at[order[0]]
    for k in order.tolist():
        if at[k] > last:
            total += (at[k] - last) * line
            last = at[k]
        a, b = low[k % n], high[k % n]
        span = over[a:b]
        if k < n:
            line += float(length[a:b][span == 0].sum())
            span += 1
        else:
            span -= 1
            line -= float(length[a:b][span == 0].sum())
    return total


def union_area(boxes: Column) -> Column:
    """Area of the union of an array of boxes."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        axes = dict(zip([f.name for f in flat.type], flat.flatten()))
        values = np.stack([axes[c].to_numpy(zero_copy_only=False) for c in BOX], 1) if len(flat) else np.zeros((0, 4))
        return pa.array([swept_area(part) for part in np.split(values, np.cumsum(size)[:-1])] if len(size) else [], pa.float64())

    return run(boxes)


def _cut_to_cells(boxes: DataFrame, cell: Column) -> DataFrame:
    """Boxes cut at the borders of cells of their own size ``cell``; pieces without area go."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.greatest(F.floor(F.col(lo) / cell), F.ceil(F.col(hi) / cell) - 1).cast("long"))
    out = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    for axis, c in (("x", "cx"), ("y", "cy")):
        out = out.withColumns({f"{axis}0": F.greatest(F.col(f"{axis}0"), F.col(c) * cell), f"{axis}1": F.least(F.col(f"{axis}1"), (F.col(c) + 1) * cell)})
    return out.where("x1 > x0 and y1 > y0")


def _quartered(boxes: DataFrame, on: list[str], thin: Callable[[DataFrame], DataFrame], cell: float, limit: int, rounds: int, counted: str = "true") -> DataFrame:
    """Boxes cut to cells (size, cx, cy); ``thin`` leaves of a cell's pieces those that count.

    A cell in which more than ``limit`` ``counted`` pieces with equal ``on`` are left is quartered until none is, at most
    ``rounds`` times.
    """
    pieces, at, done = thin(_cut_to_cells(boxes.withColumn("size", F.lit(float(cell))), F.col("size"))), [*on, "size", "cx", "cy"], None
    for _ in range(rounds):
        pieces = cut(pieces)
        crowded = cut(pieces.where(counted).groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n"))
        if crowded.isEmpty():
            break
        calm = pieces.join(crowded, at, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        dense = pieces.join(crowded, at, "left_semi").drop("cx", "cy").withColumn("size", F.col("size") / 2)
        pieces = thin(_cut_to_cells(dense, F.col("size")))
    return pieces if done is None else done.unionByName(pieces)


def union_areas(boxes: DataFrame, key: list[str], cell: float, limit: int = 2048, rounds: int = 24) -> DataFrame:
    """(key, area): area of the union of each key's boxes, exact at any ``cell``.

    A cell that holds more than ``limit`` different pieces of a key is quartered until none does, at most ``rounds`` times.
    """
    slim = boxes.select(*key, *[F.col(c).cast("double").alias(c) for c in BOX]).where("x1 > x0 and y1 > y0")
    pieces = _quartered(slim, key, DataFrame.distinct, cell, limit, rounds)
    swept = pieces.groupBy(*key, "size", "cx", "cy").agg(F.collect_list(F.struct(*BOX)).alias("boxes"))
    return swept.withColumn("area", union_area(F.col("boxes"))).groupBy(*key).agg(F.sum("area").alias("area"))


def _columns(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in BOX], 1)


def _places(boxes: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """First and one past the last grid column and row that each box meets: rows i0, j0, i1, j1."""
    first = [np.maximum(np.searchsorted(g, boxes[:, c], "right") - 1, 0) for c, g in ((0, xs), (1, ys))]
    last = [np.minimum(np.searchsorted(g, boxes[:, c], "left"), len(g) - 1) for c, g in ((2, xs), (3, ys))]
    return np.stack([*first, *last], 1)


def covered_by_union(boxes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What the union of ``by`` covers of each box: on the grid of its borders, a box sums the cells that it meets."""
    if not len(by) or not len(boxes):
        return np.zeros(len(boxes))
    xs, ys = np.unique(by[:, [0, 2]]), np.unique(by[:, [1, 3]])
    at, steps = _places(by, xs, ys), np.zeros((len(xs), len(ys)), np.int32)
    for i, j, sign in ((0, 1, 1), (2, 3, 1), (0, 3, -1), (2, 1, -1)):
        np.add.at(steps, (at[:, i], at[:, j]), sign)
    held = (steps.cumsum(0).cumsum(1)[:-1, :-1] > 0).astype(float)
    out = np.zeros(len(boxes))
    for k, ((i0, j0, i1, j1), (x0, y0, x1, y1)) in enumerate(zip(_places(boxes, xs, ys).tolist(), boxes.tolist())):
        if i1 > i0 and j1 > j0:
            w = np.maximum(np.minimum(xs[i0 + 1 : i1 + 1], x1) - np.maximum(xs[i0:i1], x0), 0)
            h = np.maximum(np.minimum(ys[j0 + 1 : j1 + 1], y1) - np.maximum(ys[j0:j1], y0), 0)
            out[k] = w @ held[i0:i1, j0:j1] @ h
    return out


def kept_by_last(boxes: np.ndarray) -> np.ndarray:
    """What of each box no later one covers: the boxes painted in their order on the grid of their borders."""
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    owner = np.full((len(xs) - 1, len(ys) - 1), -1, np.int32)
    for k, (i0, j0, i1, j1) in enumerate(_places(boxes, xs, ys).tolist()):
        owner[i0:i1, j0:j1] = k
    seen = owner >= 0
    return np.bincount(owner[seen], (np.diff(xs)[:, None] * np.diff(ys))[seen], len(boxes))


def covered_areas(boxes: DataFrame, by: DataFrame, key: str, cell: float, limit: int = 1024, rounds: int = 24) -> DataFrame:
    """(key, area): what the union of ``by`` covers of each box (unique keys) that it covers some of.

    A cell's union is made once for all boxes that meet it, or for each share of them where they are many; pairs of boxes
    aren't listed.
    """
    slim = lambda df, held: df.select(held.alias(key), *[F.col(c).cast("double").alias(c) for c in BOX])
    kind = boxes.schema[key].dataType
    both = slim(boxes, F.col(key)).withColumn("target", F.lit(True)).unionByName(slim(by, F.lit(None).cast(kind)).withColumn("target", F.lit(False)))
    pieces, at = cut(_quartered(both.where("x1 > x0 and y1 > y0"), [], DataFrame.distinct, cell, limit, rounds, "not target")), ["size", "cx", "cy"]
    full = pieces.where("target").groupBy(*at).agg(F.ceil(F.count("*") / (8 * limit)).cast("int").alias("parts"))
    share = F.when(F.col("target"), F.array(F.pmod(F.xxhash64(key), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    shared = pieces.join(full, at).withColumn("share", F.explode(share)).drop("parts")

    def run(table: pa.Table) -> pa.Table:
        mine, others = (table.filter(pa.compute.equal(table["target"], t)) for t in (True, False))
        area = covered_by_union(_columns(mine), _columns(others))
        return pa.table({key: mine[key], "area": area}).filter(pa.array(area > 0))

    schema = StructType([StructField(key, kind), StructField("area", DoubleType())])
    return shared.groupBy(*at, "share").applyInArrow(run, schema).groupBy(key).agg(F.sum("area").alias("area"))


def _rest(boxes: DataFrame, by: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, area) of what ``by`` leaves of the boxes; boxes covered to a billionth have no row."""
    held = covered_areas(boxes, by, key, cell).select(key, F.col("area").alias("covered"))
    left = boxes.select(key, box_area().alias("whole")).join(held, key, "left").withColumn("area", F.col("whole") - F.coalesce("covered", F.lit(0.0)))
    return left.where(F.col("area") > F.col("whole") * 1e-9).select(key, "area")


def overlay_areas(left: DataFrame, right: DataFrame, a: str, b: str, cell: float, how: str) -> DataFrame:
    """Areas of the pieces of two layers of boxes with unique keys: how = inner (a_id, b_id), left_anti (a_id: what the
    union of ``right`` leaves), full (both, and what the union of ``left`` leaves of ``right``)."""
    if how == "left_anti":
        return _rest(left, right, a, cell).select(F.col(a).alias("a_id"), "area")
    pairs = candidate_pairs(left, right, cell).where(overlap_area() > 0)
    both = pairs.select(F.col(f"a_{a}").alias("a_id"), F.col(f"b_{b}").alias("b_id"), overlap_area().alias("area"))
    if how == "inner":
        return both
    no_a, no_b = F.lit(None).cast(left.schema[a].dataType).alias("a_id"), F.lit(None).cast(right.schema[b].dataType).alias("b_id")
    one = _rest(left, right, a, cell).select(F.col(a).alias("a_id"), no_b, "area")
    two = _rest(right, left, b, cell).select(no_a, F.col(b).alias("b_id"), "area")
    return both.unionByName(one).unionByName(two)


def dissolve_areas(boxes: DataFrame, by: str, key: str, cell: float, others: tuple[str, ...] = ()) -> DataFrame:
    """One row a key of ``by`` (null keys go): smallest ``key``, that row's ``others``, parts, exact merged area."""
    named = boxes.where(F.col(by).isNotNull())
    first = named.groupBy(by).agg(F.min(key).alias("first"), F.count("*").alias("parts"), *[F.min_by(c, key).alias(c) for c in others])
    return first.join(union_areas(named, [by], cell), by, "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def flatten_areas(boxes: DataFrame, key: str, cell: float, limit: int = 1024, rounds: int = 24) -> DataFrame:
    """Each point belongs to the largest box over it (smallest id on ties): former and kept area, whether nothing is left.

    Of equal pieces of a cell only that of the highest box is painted.
    """
    slim = boxes.select(F.struct((-box_area()).alias("r"), F.col(key).alias("id")).alias("rank"), *[F.col(c).cast("double").alias(c) for c in BOX])
    highest = lambda df: df.groupBy("size", "cx", "cy", *BOX).agg(F.min("rank").alias("rank"))
    pieces = _quartered(slim.where("x1 > x0 and y1 > y0"), [], highest, cell, limit, rounds).select("size", "cx", "cy", *BOX, "rank.r", F.col("rank.id").alias(key))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("r", "descending"), (key, "descending")])
        return pa.table({key: table[key], "kept": kept_by_last(_columns(table))})

    schema = StructType([StructField(key, boxes.schema[key].dataType), StructField("kept", DoubleType())])
    held = pieces.groupBy("size", "cx", "cy").applyInArrow(run, schema).groupBy(key).agg(F.sum("kept").alias("held"))
    out = boxes.select(key, box_area().alias("before")).join(held, key, "left")
    kept = F.when(F.col("before").isNotNull(), F.coalesce("held", F.lit(0.0)))
    covered = kept <= F.col("before") * 1e-9
    return out.select(key, "before", F.when(covered, 0.0).otherwise(kept).alias("kept"), covered.alias("covered"))
