"""Joins of general polygons: candidates by the boxes' grid join, then exact areas and pieces.

A layer has a key, ``parts`` (array<struct<shell, holes>>) and box columns; ``with_bounds`` adds these. Rings mustn't cross
themselves: ``valid_parts`` tells, and the pair reports leave such features out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.functions.polygons import PARTS, bounds, clipped, cut_away, intersection_area, valid_parts
from fieldloom.functions.shapes import RING
from fieldloom.operators.grid import candidate_pairs, mixed_pairs, overlap_area
from fieldloom.operators.vector import line_crossings
from fieldloom.session import cut, shuffle_partitions


def with_bounds(layer: DataFrame, parts: str = "parts") -> DataFrame:
    return layer.withColumns(bounds(F.col(parts)))


def as_parts(ring: Column) -> Column:
    """A ring as a polygon of one part without holes."""
    return F.array(F.struct(ring.cast(RING).alias("shell"), F.array().cast(f"array<{RING}>").alias("holes"))).cast(PARTS)


def parts_area(parts: Column) -> Column:
    """Shells less their holes."""
    one = lambda p: g.area(p["shell"]) - F.aggregate(p["holes"], F.lit(0.0), lambda s, h: s + g.area(h))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + one(p))


def reproject_parts(parts: Column, source: int, target: int) -> Column:
    if source == target:
        return parts
    move = lambda ring: g.reproject(ring, source, target)
    return F.transform(parts, lambda p: F.struct(move(p["shell"]).alias("shell"), F.transform(p["holes"], move).alias("holes")))


def _by_kind(layer: DataFrame, key: str) -> tuple[DataFrame, set[str]]:
    """One row for each part that has to meet others by itself: key, box, parts, area (of the polygon), kind.

    ``box``: a single ring that fills its box; ``one``: another single part; ``many``: one of several parts.
    """
    n = F.size("parts")
    split = F.when(n > 1, F.transform("parts", lambda p: F.array(p))).otherwise(F.array("parts"))
    rows = layer.select(key, parts_area(F.col("parts")).alias("area"), (n > 1).alias("several"), split.alias("parts"))
    rows = rows.withColumn("parts", F.explode("parts"))
    rows = with_bounds(rows)
    full = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    boxed = (F.size(F.col("parts")[0]["holes"]) == 0) & (F.abs(F.col("area") - full) <= full * 1e-14)
    kind = F.when(F.col("several"), "many").when(boxed, "box").otherwise("one")
    rows = cut(rows.select(key, "area", "x0", "y0", "x1", "y1", "parts", kind.alias("kind")))
    return rows, {r.kind for r in rows.select("kind").distinct().collect()}  # three at most


def polygon_pairs(left: DataFrame, right: DataFrame, key: str, other: str, cell: float) -> DataFrame:
    """a_<key>, b_<other>, shared (area that the two share), a_area, b_area of pairs whose boxes meet (or those of two of
    their parts).

    Boxes share what their borders tell. Polygons of several parts meet part by part, and their shares are added.
    """
    a, a_kinds = _by_kind(left, key)
    b, b_kinds = (a, a_kinds) if left is right and key == other else _by_kind(right, other)
    keys = [f"a_{key}", f"b_{other}"]

    def shares(one: list[str], two: list[str], shared: Column) -> DataFrame | None:
        one, two = sorted(a_kinds.intersection(one)), sorted(b_kinds.intersection(two))
        if not one or not two:
            return None
        slim = lambda df, kinds: df.where(F.col("kind").isin(kinds)).drop("kind", *(["parts"] if kinds == ["box"] == [*{*one, *two}] else []))
        return mixed_pairs(slim(a, one), slim(b, two), cell).select(*keys, shared.alias("shared"), "a_area", "b_area")

    exact = intersection_area(F.col("a_parts"), F.col("b_parts"))
    alone = [shares(["box"], ["box"], overlap_area()), shares(["one"], ["box", "one"], exact), shares(["box"], ["one"], exact)]
    split = [shares(["many"], ["box", "one", "many"], exact), shares(["box", "one"], ["many"], exact)]
    out = [x for x in alone if x is not None]
    if added := [x for x in split if x is not None]:
        out.append(reduce(DataFrame.unionByName, added).groupBy(*keys, "a_area", "b_area").agg(F.sum("shared").alias("shared")).select(*keys, "shared", "a_area", "b_area"))
    if not out:
        return a.select(F.col(key).alias(keys[0]), F.lit(0.0).alias("shared"), F.col("area").alias("a_area")).join(b.select(F.col(other).alias(keys[1]), F.col("area").alias("b_area")), F.lit(False)).select(*keys, "shared", "a_area", "b_area")
    return reduce(DataFrame.unionByName, out)


def _valid(layer: DataFrame) -> DataFrame:
    return layer.repartition(shuffle_partitions(layer.sparkSession)).where(valid_parts(F.col("parts")))  # few bytes are much work


def overlap_pairs_exact(layer: DataFrame, key: str, cell: float, more_than: float) -> DataFrame:
    """Unordered pairs of valid polygons whose shared area exceeds a share of the smaller one (strictly); 4 decimals."""
    valid = _valid(layer)
    pairs = polygon_pairs(valid, valid, key, key, cell).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    ratio = F.col("shared") / F.least("a_area", "b_area")
    return pairs.where((F.col("shared") > F.least("a_area", "b_area") * 1e-12) & (ratio > more_than)).select(
        F.col(f"a_{key}").alias(f"{key}_1"), F.col(f"b_{key}").alias(f"{key}_2"), F.round(ratio, 4).alias("overlap_ratio")
    )


def topology_rules(layer: DataFrame, key: str, cell: float, least: float = 1e-4, lines: DataFrame | None = None) -> DataFrame:
    """(rule, id_1, id_2, measure) of pairs: ``overlap`` (shared area above ``least``), ``contains`` (id_1 holds id_2; share
    of the container's area), and of ``lines`` (segments x0, y0 to x1, y1) ``cross`` with no measure."""
    valid = _valid(layer)
    pairs = polygon_pairs(valid, valid, key, key, cell).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    one, two = F.col(f"a_{key}").alias("id_1"), F.col(f"b_{key}").alias("id_2")
    rule = F.array(
        F.when((F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col("shared") > least), F.struct(F.lit("overlap").alias("rule"), F.round("shared", 4).alias("measure"))),
        F.when(F.col("shared") >= F.col("b_area") * (1 - 1e-9), F.struct(F.lit("contains").alias("rule"), F.round(F.col("b_area") / F.col("a_area"), 4).alias("measure"))),
    )
    rows = pairs.select(one, two, F.explode(F.filter(rule, lambda r: r.isNotNull())).alias("r")).select("r.rule", "id_1", "id_2", "r.measure")
    if lines is None:
        return rows
    return rows.unionByName(line_crossings(lines, key, cell).select(F.lit("cross").alias("rule"), "id_1", "id_2", F.lit(None).cast("double").alias("measure")))


def clip_polygons(layer: DataFrame, clip: DataFrame, key: str, clip_key: str, cell: float, crs: int = 3857, clip_crs: int = 3857) -> DataFrame:
    """(key, clip_key, parts, area): features cut to the polygons of a clip layer, in the clip layer's coordinates.

    A layer in other coordinates is brought to those of the clip layer first. One row for each pair that shares an area.
    """
    if crs != clip_crs:
        layer = with_bounds(layer.withColumn("parts", reproject_parts(F.col("parts"), crs, clip_crs)))
    slim = lambda df, k: df.select(k, "x0", "y0", "x1", "y1", "parts")
    pairs = candidate_pairs(slim(layer, key), slim(clip, clip_key), cell)
    held = pairs.select(F.col(f"a_{key}").alias(key), F.col(f"b_{clip_key}").alias(clip_key), clipped(F.col("a_parts"), F.col("b_parts")).alias("parts"))
    return held.where(F.size("parts") > 0).withColumn("area", parts_area(F.col("parts")))


def flatten_polygons(layer: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, parts, area, covered): of overlapping polygons the larger (smaller key on ties) keeps what they share.

    The others are cut to what is left of them, as convex parts. A polygon of which nothing would be left stays as it is,
    with ``covered``. The polygons that cut one other meet in one row.
    """
    pairs = polygon_pairs(layer, layer, key, key, cell)
    higher = (F.col("b_area") > F.col("a_area")) | ((F.col("b_area") == F.col("a_area")) & (F.col(f"b_{key}") < F.col(f"a_{key}")))
    cutters = pairs.where((F.col(f"a_{key}") != F.col(f"b_{key}")) & higher & (F.col("shared") > F.least("a_area", "b_area") * 1e-12))
    shapes = layer.select(F.col(key).alias(f"b_{key}"), F.col("parts").alias("cutter"))
    taken = cutters.select(F.col(f"a_{key}").alias(key), f"b_{key}").join(shapes, f"b_{key}").groupBy(key).agg(F.collect_list("cutter").alias("cutters"))
    rest = layer.select(key, "parts").join(taken, key).select(key, "parts", cut_away(F.col("parts"), F.col("cutters")).alias("left"))
    whole = layer.select(key, "parts").join(taken.select(key), key, "left_anti").select(key, "parts", F.lit(False).alias("covered"))
    gone = parts_area(F.col("left")) <= parts_area(F.col("parts")) * 1e-9
    done = rest.select(key, F.when(gone, F.col("parts")).otherwise(F.col("left")).alias("parts"), gone.alias("covered"))
    return whole.unionByName(done).withColumn("area", parts_area(F.col("parts"))).select(key, "parts", "area", "covered")


def select_polygons(target: DataFrame, by: DataFrame, relation: str, key: str, other: str, cell: float) -> DataFrame:
    """Polygons of ``target`` that share an area with a polygon of ``by`` (``overlaps``: and neither holds the other), hold
    one (``contains``) or lie in one (``within``)."""
    pairs = polygon_pairs(target, by, key, other, cell)
    holds, held = F.col("shared") >= F.col("b_area") * (1 - 1e-9), F.col("shared") >= F.col("a_area") * (1 - 1e-9)
    some = F.col("shared") > F.least("a_area", "b_area") * 1e-12
    test = {"contains": holds, "within": held, "overlaps": some & ~holds & ~held}.get(relation, some)
    return target.join(pairs.where(test).select(F.col(f"a_{key}").alias(key)).distinct(), key, "left_semi")
