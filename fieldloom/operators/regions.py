"""Connected regions of pixel tables: labelled inside tiles with numpy, joined over tile borders with Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import cut

TILE = 256


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component: roots are hooked to smaller ones and paths halved by turns."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return root


def _label_tile(diagonal: bool):
    """Labels of a tile by union-find on runs: cells of a row that touch and are equal are one node."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["row", "col"])
        row, col, v = (tile[c].to_numpy(np.int64) for c in ("row", "col", "v"))
        begins = np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (v[1:] != v[:-1])]
        number = np.cumsum(begins) - 1
        r, c = row - row.min(), col - col.min()
        runs = np.full((r.max() + 2, c.max() + 3), -1)  # a margin below, and on both sides
        runs[r, c + 1] = number
        value = np.zeros(runs.shape, np.int64)
        value[r, c + 1] = v
        found = []
        for step in (-1, 0, 1) if diagonal else (0,):
            below = runs[r + 1, c + 1 + step]
            meet = (below >= 0) & (value[r + 1, c + 1 + step] == v)
            found.append(number[meet] * len(row) + below[meet])
        a, b = np.divmod(np.unique(np.concatenate(found)), len(row))
        first = np.flatnonzero(begins)  # runs come by their first cells: the smallest run has the smallest label
        label = ((row[first] << 31) + col[first])[_roots(len(first), a, b)]
        return pd.DataFrame({"row": row, "col": col, "v": v, "label": label[number]})

    return run


def label_regions(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """row, col, v, label: cells of equal v that touch share the label of their first cell (row-major).

    Tiles hold at most ``tile`` x ``tile`` cells. Pairs of labels that meet over a border are merged by rounds of the
    smallest neighbour, each cut by a checkpoint; only border labels take part in the rounds.
    """
    cells = mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("long").alias("v"))
    tiles = cells.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    local = cut(tiles.groupBy("tr", "tc").applyInPandas(_label_tile(diagonal), "row long, col long, v long, label long"))
    edge = (F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    border = local.where(edge)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    moved = border.select(F.col("label").alias("b"), "v", F.explode(moves).alias("m"), "row", "col").select(
        "b", "v", (F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col")
    )
    pairs = cut(border.select("row", "col", "v", F.col("label").alias("a")).join(moved, ["row", "col", "v"]).where("a <> b").select("a", "b").distinct())
    both = cut(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct())
    names = cut(both.select(F.col("a").alias("label")).distinct().withColumn("root", F.col("label")))
    while True:
        near = both.join(names.select(F.col("label").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("label")).agg(F.min("r").alias("r"))
        step = names.join(near, "label").select("label", "root", F.least("root", "r").alias("next"))
        jump = names.select(F.col("label").alias("next"), F.col("root").alias("up"))
        after = cut(step.join(jump, "next").select("label", "root", F.least("next", "up").alias("new")))
        changed = after.where("new <> root").limit(1).count()
        names = after.select("label", F.col("new").alias("root"))
        if not changed:
            break
    return local.join(names, "label", "left").select("row", "col", "v", F.coalesce("root", "label").alias("label"))


def region_table(labels: DataFrame) -> DataFrame:
    """label, v, n and the box of each region."""
    return labels.groupBy("label", "v").agg(
        F.count("*").alias("n"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    )


def filter_regions(mask: DataFrame, least: int = 0, most: int | None = None, diagonal: bool = True) -> DataFrame:
    """Set regions of fewer than ``least`` or more than ``most`` cells are cleared."""
    labels = label_regions(mask, diagonal)
    sizes = labels.where("v = 1").groupBy("label").agg(F.count("*").alias("n"))
    bad = sizes.where((F.col("n") < least) | (F.lit(False) if most is None else F.col("n") > most)).select("label", F.lit(True).alias("bad"))
    return labels.join(bad, "label", "left").select("row", "col", F.when(F.col("bad"), 0).otherwise(F.col("v")).alias("v"))


def keep_largest(mask: DataFrame) -> DataFrame:
    """Only the largest set region stays, the first in row-major order on ties."""
    labels = label_regions(mask)
    best = labels.where("v = 1").groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
    joined = labels.join(F.broadcast(best))  # one row
    return joined.select("row", "col", F.when(F.col("label") == F.col("best"), F.col("v")).otherwise(F.lit(0)).alias("v"))


def fill_mask_holes(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Clear regions (4-connected) that don't touch the raster's border become set."""
    labels = label_regions(mask)
    outside = labels.where(F.col("row").isin(0, height - 1) | F.col("col").isin(0, width - 1)).select("label").distinct().withColumn("out", F.lit(True))
    return labels.join(outside, "label", "left").select("row", "col", F.when(F.col("v") == 1, 1).when(F.col("out"), 0).otherwise(1).alias("v"))


def object_stats(mask: DataFrame) -> DataFrame:
    """One row: regions, smallest, largest and mean size, covered share."""
    labels = label_regions(mask)
    sizes = labels.where("v = 1").groupBy("label").agg(F.count("*").alias("n"))
    got = sizes.agg(F.count("*").alias("regions"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))
    return got.join(mask.agg(F.avg("v").alias("coverage")))  # single rows


def mask_pipeline(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Open (2), drop regions under 200 cells, fill holes, close (3), smooth (1.5)."""
    from fieldloom.operators.raster import close_mask, gaussian_smooth, open_mask

    opened = cut(open_mask(mask, 2))
    filled = cut(fill_mask_holes(filter_regions(opened, 200), height, width))
    return gaussian_smooth(close_mask(filled, 3), 1.5, 0.5, height, width)
