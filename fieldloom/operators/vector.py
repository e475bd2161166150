"""Filters, joins and overlays of vector layers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.operators.grid import as_box, box_area, candidate_pairs, cell_of, cells, overlap_area
from fieldloom.operators.overlay import covered_areas
from fieldloom.session import cut

EARTH = 6371008.8


# Filters.


def select_by_attribute(df: DataFrame, field: str, op: str, value) -> DataFrame:
    """Rows with ``field op value``, compared as numbers if ``value`` and every value of the column are some, else as text.

    Nulls never match.
    """
    if op not in ("==", "!=", ">", ">=", "<", "<="):
        raise ValueError(f"unknown operator {op}")
    number = F.expr(f"try_cast(`{field}` as double)")
    try:
        asked = float(value)
    except (TypeError, ValueError):
        asked = None
    numeric = asked is not None and df.where(F.col(field).isNotNull()).agg(F.bool_and(number.isNotNull()).alias("x")).first()["x"]
    left = number if numeric else F.col(field).cast("string")
    right = F.lit(asked) if numeric else F.lit(str(value))
    tests = {"==": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}
    return df.where(tests[op])


def attribute_report(df: DataFrame, field: str, op: str, value) -> DataFrame:
    """One row: rows in all, kept by ``select_by_attribute`` and filtered out."""
    kept = select_by_attribute(df, field, op, value).agg(F.count("*").alias("kept"))
    return df.agg(F.count("*").alias("total")).crossJoin(kept).select("total", "kept", (F.col("total") - F.col("kept")).alias("filtered"))  # single rows


RELATIONS = ("intersects", "contains", "within", "touches", "overlaps", "crosses")


def select_by_location(target: DataFrame, by: DataFrame, relation: str, key: str, cell: float) -> DataFrame:
    """Boxes in a relation to the union of ``by``, which may overlap itself.

    ``intersects`` (also for unknown relations): they meet; ``within``: the union covers the box; ``touches``: they meet
    at borders only; ``overlaps``: they share an area, and neither holds the other; ``contains``: the box holds all of
    ``by``; ``crosses``: never so between areas. No rows in ``by``: nothing is selected.
    """
    pairs = candidate_pairs(target, by, cell)
    if relation == "crosses":
        return target.where("false")
    if relation not in RELATIONS or relation == "intersects":
        return target.join(pairs.select(F.col(f"a_{key}").alias(key)).distinct(), key, "left_semi")
    held = covered_areas(target, by, key, cell).withColumnRenamed("area", "covered")
    if relation == "touches":
        return target.join(pairs.select(F.col(f"a_{key}").alias(key)).distinct().join(held, key, "left_anti"), key, "left_semi")
    met = target.select(key, box_area().alias("a")).join(held, key)
    inside = F.col("covered") >= F.col("a") * (1 - 1e-9)
    if relation == "within":
        return target.join(met.where(inside).select(key), key, "left_semi")
    bounds = by.agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    holds = (F.col("x0") <= F.col("bx0")) & (F.col("y0") <= F.col("by0")) & (F.col("bx1") <= F.col("x1")) & (F.col("by1") <= F.col("y1"))
    around = target.join(F.broadcast(bounds), how="cross")  # one row
    if relation == "contains":
        return around.where(holds).select(*target.columns)
    shared = met.where(~inside).select(key)
    return around.where(~holds).select(*target.columns).join(shared, key, "left_semi")


def extent_rule(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """``inside`` (every corner lies in the extent) and ``share``: percent of the box inside, one decimal."""
    w = F.greatest(F.least("x1", F.lit(x1)) - F.greatest("x0", F.lit(x0)), F.lit(0.0))
    h = F.greatest(F.least("y1", F.lit(y1)) - F.greatest("y0", F.lit(y0)), F.lit(0.0))
    inside = (F.col("x0") >= x0) & (F.col("x1") <= x1) & (F.col("y0") >= y0) & (F.col("y1") <= y1)
    return df.withColumn("inside", inside).withColumn("share", F.round(100 * w * h / box_area(), 1))


def valid_lonlat(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def area_range(df: DataFrame, least: float, most: float | None = None) -> DataFrame:
    kept = df.where(box_area() >= least)
    return kept if most is None else kept.where(box_area() <= most)


def shape_filter(df: DataFrame, area: Column, min_area: float, fill: float = 0.25, aspect: float = 8.0) -> DataFrame:
    """Shapes that are large enough, fill their box and aren't too long; a zero divisor counts as 1."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    whole = F.when(w * h == 0, 1.0).otherwise(w * h)
    short = F.when(F.least(w, h) == 0, 1.0).otherwise(F.least(w, h))
    return df.where((area >= min_area) & (area / whole >= fill) & (F.greatest(w, h) / short <= aspect))


# Joins.


def spatial_join(areas: DataFrame, points: DataFrame, cell: float, half_open: bool = False) -> DataFrame:
    """Boxes with the points that they contain: one row a pair, attributes of both as a_ and b_ columns.

    ``half_open``: upper borders belong to the next box, for layers that tile the plane.
    """
    pairs = candidate_pairs(areas, as_box(points), cell)
    if half_open:
        pairs = pairs.where((F.col("b_x") < F.col("a_x1")) & (F.col("b_y") < F.col("a_y1")))
    return pairs.drop("b_x0", "b_y0", "b_x1", "b_y1")


def box_join(left: DataFrame, right: DataFrame, cell: float, predicate: str = "intersects") -> DataFrame:
    """Pairs of boxes that meet, of which the left one ``contains`` or is ``within`` the right one; others: intersects."""
    pairs = candidate_pairs(left, right, cell)

    def holds(outer: str, inner: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{outer}x0") <= F.col(f"{inner}x0"), F.col(f"{inner}x1") <= F.col(f"{outer}x1"), F.col(f"{outer}y0") <= F.col(f"{inner}y0"), F.col(f"{inner}y1") <= F.col(f"{outer}y1")])

    return pairs.where({"contains": holds("a_", "b_"), "within": holds("b_", "a_")}.get(predicate, F.lit(True)))


def count_points_per_area(areas: DataFrame, points: DataFrame, key: str, cell: float, half_open: bool = False) -> DataFrame:
    """Areas with ``n_points``, 0 where none lies inside."""
    counts = spatial_join(areas, points, cell, half_open).groupBy(F.col(f"a_{key}").alias(key)).agg(F.count("*").alias("n"))
    return areas.join(counts, key, "left").withColumn("n_points", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def within_distance_join(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """Pairs of points at most ``distance`` apart, with ``distance``."""
    pairs = candidate_pairs(as_box(left), as_box(right), distance, distance)
    d = F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2)
    return pairs.withColumn("distance", d).where(F.col("distance") <= distance)


def containing_areas(areas: DataFrame, points: DataFrame, key: str, cell: float) -> DataFrame:
    held = spatial_join(areas, points, cell).select(F.col(f"a_{key}").alias(key))
    return areas.join(held, key, "left_semi")


def _pyramid(points: DataFrame, cell: float, levels: int) -> list[DataFrame]:
    """Occupied cells by level, each twice as long as the level's before: (cx, cy), the bounds of its points and one of them."""
    some = [F.min("ox").alias("lox"), F.max("ox").alias("hix"), F.min("oy").alias("loy"), F.max("oy").alias("hiy"), F.min(F.struct("ox", "oy")).alias("one")]
    out = [cut(points.groupBy("cx", "cy").agg(*some))]
    for _ in range(levels):
        up = out[-1].groupBy(F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy"))
        out.append(cut(up.agg(F.min("lox").alias("lox"), F.max("hix").alias("hix"), F.min("loy").alias("loy"), F.max("hiy").alias("hiy"), F.min("one").alias("one"))))
    return out


def _descend(rest: DataFrame, points: DataFrame, key: str, cell: float, levels: int) -> DataFrame:
    """(key, distance) of rows far from all points: from the coarsest cells down, only cells that may hold the nearest stay.

    A cell stays while its bounds are no farther than the nearest known point of the row's other cells.
    """
    pyramid = _pyramid(points, cell, levels)
    w = W.partitionBy(key)
    gap = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    near = F.sqrt(gap("x", "lox", "hix") ** 2 + gap("y", "loy", "hiy") ** 2)
    known = F.sqrt((F.col("x") - F.col("one.ox")) ** 2 + (F.col("y") - F.col("one.oy")) ** 2)
    kept = None
    for depth, cells_ in enumerate(reversed(pyramid)):
        inner = cells_.withColumns({"px": F.floor(F.col("cx") / 2), "py": F.floor(F.col("cy") / 2)})
        small = depth < 6  # at most four cells at the top, and four times as many at each level
        inner = F.broadcast(inner) if small else inner
        joined = rest.join(inner, how="cross") if kept is None else kept.join(inner, ["px", "py"])
        scored = joined.withColumn("best", F.min(known).over(w)).where(near <= F.col("best") * (1 + 1e-12))
        kept = scored.select(key, "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"))
        kept = cut(kept) if depth % 6 == 5 else kept
    found = kept.join(points.withColumnsRenamed({"cx": "px", "cy": "py"}), ["px", "py"])
    return found.groupBy(key).agg(F.min(F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)).alias("distance"))


def nearest_distance(left: DataFrame, right: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, distance) to the nearest point of ``right``; null for rows of ``left`` without coordinates, and if there is none.

    Rows with a point in their own or a neighbouring cell that is no farther than a cell are settled by one join; the others
    go down a pyramid of occupied cells, whose height follows the extent of the data in cells.
    """
    other = right.select(F.col("x").alias("ox"), F.col("y").alias("oy")).where("ox is not null and oy is not null").distinct()
    other = cut(other.withColumns({"cx": cell_of(F.col("ox"), cell), "cy": cell_of(F.col("oy"), cell)}))
    if other.isEmpty():
        return left.select(key, F.lit(None).cast("double").alias("distance"))
    lost = left.where("x is null or y is null").select(key, F.lit(None).cast("double").alias("distance"))
    placed = left.where("x is not null and y is not null").select(key, "x", "y")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = placed.withColumn("o", F.explode(around)).select(key, "x", "y", (cell_of(F.col("x"), cell) + F.col("o.i")).alias("cx"), (cell_of(F.col("y"), cell) + F.col("o.j")).alias("cy"))
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    hits = cut(near.join(other, ["cx", "cy"]).groupBy(key).agg(F.min(d).alias("distance")).where(F.col("distance") <= cell))
    rest = cut(placed.join(hits, key, "left_anti"))
    if not rest.isEmpty():
        span = other.agg(F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"))).first()[0]
        hits = hits.unionByName(_descend(rest, other, key, cell, int(span + 1).bit_length()))
    return lost.unionByName(hits)


def overlap_pairs(boxes: DataFrame, key: str, cell: float, more_than: float) -> DataFrame:
    """Unordered pairs whose overlap exceeds a share of the smaller area (strictly); the ratio has 4 decimals."""
    pairs = candidate_pairs(boxes, boxes, cell).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    ratio = overlap_area() / F.least(box_area("a_"), box_area("b_"))
    return pairs.withColumn("ratio", ratio).where((F.col("ratio") > more_than) & (overlap_area() > 0)).select(
        F.col(f"a_{key}").alias(f"{key}_1"), F.col(f"b_{key}").alias(f"{key}_2"), F.round("ratio", 4).alias("overlap_ratio")
    )


def topology_pairs(boxes: DataFrame, key: str, cell: float, least: float = 1e-4) -> DataFrame:
    """Rule rows of box pairs: ``overlap`` (area above ``least``) and ``contains`` with the share of the container."""
    pairs = candidate_pairs(boxes, boxes, cell).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    inside = (
        (F.col("a_x0") <= F.col("b_x0")) & (F.col("b_x1") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y0")) & (F.col("b_y1") <= F.col("a_y1"))
    )
    one, two = F.col(f"a_{key}").alias("id_1"), F.col(f"b_{key}").alias("id_2")
    over = pairs.where((F.col(f"a_{key}") < F.col(f"b_{key}")) & (overlap_area() > least)).select(F.lit("overlap").alias("rule"), one, two, F.round(overlap_area(), 4).alias("measure"))
    held = pairs.where(inside).select(F.lit("contains").alias("rule"), one, two, F.round(box_area("b_") / box_area("a_"), 4).alias("measure"))
    return over.unionByName(held)


def line_crossings(lines: DataFrame, key: str, cell: float) -> DataFrame:
    """Unordered pairs of segments (x0, y0) to (x1, y1) that cross inside both: (id_1, id_2)."""
    ends = {"ax": "x0", "ay": "y0", "bx": "x1", "by": "y1"}
    slim = lines.select(key, *[F.col(c).alias(n) for n, c in ends.items()])
    boxes = slim.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    pairs = candidate_pairs(boxes, boxes, cell).where(F.col(f"a_{key}") < F.col(f"b_{key}"))

    def side(line: str, other: str, end: str) -> Column:
        c = F.col
        along = (c(f"{line}_bx") - c(f"{line}_ax")) * (c(f"{other}_{end}y") - c(f"{line}_ay"))
        return along - (c(f"{line}_by") - c(f"{line}_ay")) * (c(f"{other}_{end}x") - c(f"{line}_ax"))

    apart = [side(m, n, "a") * side(m, n, "b") < 0 for m, n in (("a", "b"), ("b", "a"))]
    return pairs.where(apart[0] & apart[1]).select(F.col(f"a_{key}").alias("id_1"), F.col(f"b_{key}").alias("id_2"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def near_duplicate_points(points: DataFrame, key: str, metres: float) -> DataFrame:
    """Unordered pairs of lon/lat points closer than ``metres``. Cells follow the widest degree of the layer's latitudes."""
    top = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    cell = metres / (EARTH * math.pi / 180 * max(math.cos(math.radians(min(top, 89.9))), 1e-3))
    pairs = candidate_pairs(as_box(points, "lon", "lat"), as_box(points, "lon", "lat"), cell, cell)
    d = haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    return pairs.where(F.col(f"a_{key}") < F.col(f"b_{key}")).withColumn("metres", d).where(F.col("metres") < metres).select(
        F.col(f"a_{key}").alias("id_1"), F.col(f"b_{key}").alias("id_2"), F.round("metres", 3).alias("metres")
    )


def clip_layer(boxes: DataFrame, clip: DataFrame, key: str, clip_key: str, cell: float) -> DataFrame:
    """Boxes cut to the boxes of the clip layer: one row for each piece with an area."""
    pairs = candidate_pairs(boxes, clip, cell)
    piece = {
        "x0": F.greatest("a_x0", "b_x0"), "y0": F.greatest("a_y0", "b_y0"), "x1": F.least("a_x1", "b_x1"), "y1": F.least("a_y1", "b_y1")
    }
    return pairs.where(overlap_area() > 0).select(F.col(f"a_{key}").alias(key), F.col(f"b_{clip_key}").alias(clip_key), *[e.alias(n) for n, e in piece.items()])


# Overlay on a cell grid: exact for boxes that follow the grid, otherwise to one cell.


def rasterize(boxes: DataFrame, res: float, all_touched: bool = False) -> DataFrame:
    """One row for each cell (row, col) of a box: centres inside, or with ``all_touched`` any cell that it meets."""
    if all_touched:
        lo = lambda c: F.floor(F.col(c) / res)
        hi = lambda c: F.ceil(F.col(c) / res) - 1
    else:
        lo = lambda c: F.ceil(F.col(c) / res - 0.5)
        hi = lambda c: F.ceil(F.col(c) / res - 0.5) - 1
    span = lambda a, b: F.when(hi(b) >= lo(a), F.sequence(lo(a).cast("long"), hi(b).cast("long")))
    return boxes.withColumn("col", F.explode(span("x0", "x1"))).withColumn("row", F.explode(span("y0", "y1")))


def overlay_cells(left: DataFrame, right: DataFrame, a: str, b: str, res: float, how: str) -> DataFrame:
    """Areas of the pieces of two layers: how = inner (intersection), full (union), left_anti (difference)."""
    one = rasterize(left, res).select(F.col(a).alias("a_id"), "row", "col")
    two = rasterize(right, res).select(F.col(b).alias("b_id"), "row", "col")
    joined = one.join(two, ["row", "col"], how)
    keys = ["a_id"] if how == "left_anti" else ["a_id", "b_id"]
    return joined.groupBy(*keys).agg((F.count("*") * (res * res)).alias("area"))


def dissolve(boxes: DataFrame, by: str, key: str, res: float, others: tuple[str, ...] = ()) -> DataFrame:
    """One row a key (null keys go): smallest ``key``, that row's ``others``, parts, merged area on cells."""
    named = boxes.where(F.col(by).isNotNull())
    area = rasterize(named, res).select(by, "row", "col").distinct().groupBy(by).agg((F.count("*") * (res * res)).alias("area"))
    first = named.groupBy(by).agg(F.min(key).alias("first"), F.count("*").alias("parts"), *[F.min_by(c, key).alias(c) for c in others])
    return first.join(area, by, "left")


def flatten_overlaps(boxes: DataFrame, key: str, res: float) -> DataFrame:
    """Each cell belongs to the largest box (smallest id on ties): kept and former area, and whether nothing is left."""
    held = rasterize(boxes.withColumn("a", box_area()), res).select(key, "a", "row", "col")
    best = held.groupBy("row", "col").agg(F.max_by(key, F.struct("a", -F.col(key))).alias(key))
    kept = best.groupBy(key).agg((F.count("*") * (res * res)).alias("kept"))
    before = held.groupBy(key).agg((F.count("*") * (res * res)).alias("before"))
    return before.join(kept, key, "left").select(key, "before", F.coalesce("kept", F.lit(0.0)).alias("kept"), F.col("kept").isNull().alias("covered"))


def concat_layers(*layers: DataFrame, crs: list[int] | None = None, ring: str = "ring") -> DataFrame:
    """The rows of all layers, missing columns null. With ``crs`` (a code for each layer) rings are brought to the first
    layer's coordinates; 4326 and 3857 are known."""
    if crs:
        layers = tuple(x if c == crs[0] else x.withColumn(ring, g.reproject(F.col(ring), c, crs[0])) for x, c in zip(layers, crs, strict=True))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def drop_duplicate_geometry(df: DataFrame, key: str, geometry: list[str]) -> DataFrame:
    """Of equal geometries the row with the smallest key stays."""
    first = df.groupBy(*geometry).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def greedy_suppress(boxes: DataFrame, key: str, cell: float, above: float, inclusive: bool = False) -> DataFrame:
    """Boxes by falling area (smallest key first on ties); a kept box drops later ones with IoU > (or >=) ``above``.

    Rounds: a box stays once all higher-ranked neighbours are dropped, and goes once one of them stays. Of equal boxes the
    one with the smallest key stands for all: either it stays, or what drops it drops the others too.
    """
    alike = above < 1 or (inclusive and above == 1)
    solid = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    slim = boxes.where(solid).select(key, "x0", "y0", "x1", "y1")
    firsts = cut(slim.groupBy("x0", "y0", "x1", "y1").agg(F.min(key).alias(key)) if alike else slim)
    pairs = candidate_pairs(firsts, firsts, cell).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    iou = overlap_area() / (box_area("a_") + box_area("b_") - overlap_area())
    higher = (box_area("a_") > box_area("b_")) | ((box_area("a_") == box_area("b_")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    hit = (iou >= above) if inclusive else (iou > above)
    edges = cut(pairs.where(hit & higher & (overlap_area() > 0)).select(F.col(f"a_{key}").alias("hi"), F.col(f"b_{key}").alias("lo")))
    dropped = None
    while True:
        open_edges = edges
        waiting = open_edges.select(F.col("lo").alias("n")).distinct()
        kept = open_edges.select(F.col("hi").alias("n")).distinct().join(waiting, "n", "left_anti")
        gone = cut(open_edges.join(kept.withColumnRenamed("n", "hi"), "hi", "left_semi").select(F.col("lo").alias("n")).distinct())
        if gone.isEmpty():
            break
        dropped = gone if dropped is None else cut(dropped.union(gone))
        edges = cut(edges.join(gone.withColumnRenamed("n", "hi"), "hi", "left_anti").join(gone.withColumnRenamed("n", "lo"), "lo", "left_anti"))
    stay = firsts.select(key) if dropped is None else firsts.select(key).join(dropped.withColumnRenamed("n", key), key, "left_anti")
    return boxes.where(solid).join(stay, key, "left_semi").select(*boxes.columns).unionByName(boxes.where(~solid))


def requested_count(text: Column, default: int = 30) -> Column:
    """How many sites a request asks for: its first number before a counting word, 1 to 500; ``default`` without one."""
    #: The counting words.
    number = F.regexp_extract(text, r"(\d+)\s*(?:个|处|座|点)", 1)
    asked = F.coalesce(number.try_cast("decimal(38,0)"), F.when(number != "", F.lit(500)))
    return F.when(asked.isNull(), default).otherwise(F.greatest(F.least(asked, F.lit(500)), F.lit(1))).cast("int")


def grid_sites(xmin: float, ymin: float, xmax: float, ymax: float, step: float, areas: DataFrame, n: int, score: Column) -> DataFrame:
    """Grid points inside any area, scored; the best ``n`` with their rank (ties: row, then column)."""
    spark = areas.sparkSession
    grid = spark.range(1).select(
        F.explode(F.sequence(F.lit(0), F.lit(int((xmax - xmin) / step)))).alias("i"), F.lit(0).alias("z")
    ).select("i", F.explode(F.sequence(F.lit(0), F.lit(int((ymax - ymin) / step)))).alias("j"))
    points = grid.select("i", "j", (F.lit(xmin) + F.col("i") * step).alias("x"), (F.lit(ymin) + F.col("j") * step).alias("y"))
    inside = spatial_join(areas, points, 4 * step).select(F.col("b_i").alias("i"), F.col("b_j").alias("j"), F.col("b_x").alias("x"), F.col("b_y").alias("y")).distinct()
    best = inside.withColumn("score", score).orderBy(F.desc("score"), "j", "i").limit(max(1, min(n, 500)))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "j", "i")).cast("long"))  # at most 500 rows
