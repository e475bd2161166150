"""Cells and candidate pairs: every join on space is an equi-join on grid cells, refined and free of duplicates.

Boxes are columns x0, y0, x1, y1 (points have x0 = x1 and y0 = y1). A box is listed in each cell that it touches; a pair
of boxes is kept only in the cell of the larger of their lower-left corners, so that no pair comes twice and no distinct
is needed. Pick a cell of about twice the median extent; a box far larger than that is listed in many cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import shuffle_partitions


def cell_of(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(cell)).cast("long")


def cells(df: DataFrame, cell: float, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """``df`` with one row for each cell (cx, cy) that its boxes touch."""
    return df.withColumn("cx", F.explode(F.sequence(cell_of(F.col(x0), cell), cell_of(F.col(x1), cell)))).withColumn(
        "cy", F.explode(F.sequence(cell_of(F.col(y0), cell), cell_of(F.col(y1), cell)))
    )


def candidate_pairs(left: DataFrame, right: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """Pairs whose boxes meet, or come within ``margin`` on both axes; columns become a_<name> and b_<name>."""
    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns])
    a = a.withColumns({"lx0": F.col("a_x0") - margin, "ly0": F.col("a_y0") - margin, "lx1": F.col("a_x1") + margin, "ly1": F.col("a_y1") + margin})
    joined = cells(a, cell, "lx0", "ly0", "lx1", "ly1").join(cells(b, cell, "b_x0", "b_y0", "b_x1", "b_y1"), ["cx", "cy"])
    meet = (
        (F.col("lx0") <= F.col("b_x1"))
        & (F.col("b_x0") <= F.col("lx1"))
        & (F.col("ly0") <= F.col("b_y1"))
        & (F.col("b_y0") <= F.col("ly1"))
    )
    own = (F.col("cx") == cell_of(F.greatest("lx0", "b_x0"), cell)) & (F.col("cy") == cell_of(F.greatest("ly0", "b_y0"), cell))
    return joined.where(meet & own).drop("cx", "cy", "lx0", "ly0", "lx1", "ly1")


def mixed_pairs(left: DataFrame, right: DataFrame, cell: float, limit: int = 20_000) -> DataFrame:
    """``candidate_pairs`` of layers whose boxes differ much in size.

    A box belongs to the level at which a cell (``cell`` times a power of two) is at least as long as the box, and so to four
    cells at most. A pair meets at the coarser of its two levels: the box of that level is listed there only, the other one
    also at the coarser levels that the other side has, so that small boxes don't meet each other in large cells. Cells that
    hold more than ``limit`` boxes of the side listed at several levels are split by salt, and their boxes of the other side
    repeated for each.
    """
    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns])
    n = shuffle_partitions(left.sparkSession)

    def level(p: str) -> Column:
        extent = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"))
        return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell)), F.lit(0)).cast("int")

    a, b = a.withColumn("own", level("a_")), b.withColumn("own", level("b_"))
    used = {side: sorted(r.own for r in df.select("own").distinct().collect() if r.own is not None) for side, df in (("a", a), ("b", b))}  # a few powers of two

    def placed(df: DataFrame, p: str, at: Column) -> DataFrame:
        df = df.withColumn("level", F.explode(at)).drop("own").withColumn("size", F.lit(cell) * F.pow(F.lit(2.0), "level"))
        for c, (lo, hi) in {"cx": (f"{p}x0", f"{p}x1"), "cy": (f"{p}y0", f"{p}y1")}.items():
            df = df.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / F.col("size")).cast("long"), F.floor(F.col(hi) / F.col("size")).cast("long"))))
        return df

    on = ["level", "cx", "cy"]
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    here = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / F.col("size"))) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / F.col("size")))

    def met(small: DataFrame, p: str, large: DataFrame, q: str, levels: list[int], equal: bool) -> DataFrame:
        coarser = F.filter(F.lit(levels).cast("array<int>"), lambda m: (m >= F.col("own")) if equal else (m > F.col("own")))
        fine, coarse = placed(small, p, coarser), placed(large, q, F.array("own")).drop("size")
        crowded = fine.groupBy(*on).agg(F.ceil(F.count("*") / limit).cast("int").alias("parts")).where("parts > 1")
        fine = fine.join(crowded, on, "left").withColumn("salt", F.pmod(F.xxhash64(*[c for c in small.columns if c != "own"]), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        coarse = coarse.join(crowded, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        by = [*on, "salt"]
        joined = fine.repartition(n, *by).join(coarse.repartition(n, *by), by)  # few bytes can be many pairs
        return joined.where(meet & here).select(*[c for x in (a, b) for c in x.columns if c != "own"])

    pairs = met(b, "b_", a, "a_", used["a"], True)
    return pairs.unionByName(met(a, "a_", b, "b_", used["b"], False)) if used["a"] and used["b"] and used["b"][-1] > used["a"][0] else pairs


def as_box(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as boxes without extent; x and y stay."""
    return points.withColumns({"x0": F.col(x), "y0": F.col(y), "x1": F.col(x), "y1": F.col(y)})


def overlap_area(a: str = "a_", b: str = "b_") -> Column:
    w = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    h = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))
