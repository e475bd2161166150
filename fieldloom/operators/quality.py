"""Quality checks, repair and regularisation of polygon layers: fid, parts array<struct<shell, holes>> and box columns.

Overlaps are exact for polygons of any form; box columns (x0, y0, x1, y1) serve the suppression of overlapping features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.functions.shapes import RING, from_utm, into_utm, rectangle_direction, simplify, snap_edges, square_corners
from fieldloom.operators.grid import box_area
from fieldloom.operators.polygons import flatten_polygons, overlap_pairs_exact, topology_rules, with_bounds
from fieldloom.operators.vector import greedy_suppress, near_duplicate_points
from fieldloom.session import cut, shuffle_partitions

ISSUE = ["fid", "fid_2", "error_type", "severity", "auto_fixable", "overlap_ratio"]


def polygon_layer(boxes: DataFrame) -> DataFrame:
    """Boxes as polygon parts with planted errors by fid % 97: bow-tie, open ring, repeated vertex, hole, two parts, copy."""
    c, k = F.col, F.col("fid") % 97
    before = {n: c(n) for n in ("x0", "y0", "x1", "y1")}
    p = lambda x, y: g.point(before[x], before[y])
    plain = [p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")]
    shell = (
        F.when(k == 1, F.array(plain[0], plain[2], plain[1], plain[3], plain[0]))
        .when(k == 2, F.array(*plain))
        .when(k == 3, F.array(plain[0], plain[1], plain[1], plain[2], plain[3], plain[0]))
        .otherwise(F.array(*plain, plain[0]))
    )
    mid = lambda a, b, s: before[a] + (before[b] - before[a]) * s
    hole = F.array(*[g.point(mid("x0", "x1", s), mid("y0", "y1", t)) for s, t in ((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4))])
    part = F.struct(shell.alias("shell"), F.when(k == 4, F.array(hole)).otherwise(F.array().cast(f"array<{RING}>")).alias("holes"))
    far = F.struct(F.transform(shell, lambda q: g.point(q["x"] + 2000, q["y"])).alias("shell"), F.array().cast(f"array<{RING}>").alias("holes"))
    return boxes.select("fid", "x0", "y0", "x1", "y1", F.when(k == 5, F.array(part, far)).otherwise(F.array(part)).alias("parts"))


def polygon_area(parts: Column) -> Column:
    """Shells less their holes."""
    one = lambda p: g.area(p["shell"]) - F.aggregate(p["holes"], F.lit(0.0), lambda s, h: s + g.area(h))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + one(p))


def check_layer(layer: DataFrame, cell: float, overlap: float = 0.05, sliver: float = 5.0) -> DataFrame:
    """Issue rows: Invalid, Self-Intersection (both for a crossing ring), Hole (one a part with holes), Overlap, Sliver,
    MultiPart, Duplicate (fid_2 is the first of the equal geometries)."""
    layer = layer.withColumn("crossing", F.exists("parts", lambda p: g.self_intersects(p["shell"])))
    checks = g.ring_checks
    broken = F.exists("parts", lambda p: checks(p["shell"])["few_vertices"] | checks(p["shell"])["unclosed"])

    def rows(df: DataFrame, kind: str, severity: str, fixable: bool) -> DataFrame:
        return df.select(
            "fid", F.lit(None).cast("long").alias("fid_2"), F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"),
            F.lit(fixable).alias("auto_fixable"), F.lit(None).cast("double").alias("overlap_ratio"),
        )

    pairs = overlap_pairs_exact(with_bounds(layer.select("fid", "parts")), "fid", cell, overlap)  # of valid features
    over = pairs.select(
        F.col("fid_1").alias("fid"), F.col("fid_2"), F.lit("Overlap").alias("error_type"), F.lit("HIGH").alias("severity"),
        F.lit(True).alias("auto_fixable"), "overlap_ratio",
    )
    first = layer.groupBy("parts").agg(F.min("fid").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = layer.join(first, "parts").where("fid > first").select(
        "fid", F.col("first").alias("fid_2"), F.lit("Duplicate").alias("error_type"), F.lit("MEDIUM").alias("severity"),
        F.lit(True).alias("auto_fixable"), F.lit(None).cast("double").alias("overlap_ratio"),
    )
    holes = layer.select("fid", F.explode("parts").alias("p")).where(F.size("p.holes") > 0)
    out = rows(layer.where(F.col("crossing") | broken), "Invalid", "HIGH", True)
    for more in (
        rows(layer.where("crossing"), "Self-Intersection", "HIGH", True), rows(holes, "Hole", "MEDIUM", True), over,
        rows(layer.where(polygon_area(F.col("parts")) < sliver), "Sliver", "LOW", True), rows(layer.where(F.size("parts") > 1), "MultiPart", "LOW", True), copies,
    ):
        out = out.unionByName(more)
    return out.select(*ISSUE)


def _closed(ring: Column) -> Column:
    """Closed and without repeated vertices."""
    single = F.filter(ring, lambda p, i: (i == 0) | (p != F.coalesce(F.get(ring, i - 1), p)) | (i != 0) & F.get(ring, i - 1).isNull())
    ends = F.element_at(single, 1) == F.element_at(single, -1)
    return F.when(ends, single).otherwise(F.concat(single, F.slice(single, 1, 1)))


def _untied(ring: Column) -> Column:
    """A four-cornered bow-tie with its middle corners in order; other crossing rings are left for quarantine."""
    swapped = F.array(ring[0], ring[2], ring[1], ring[3], ring[0])
    return F.when(g.self_intersects(ring) & (F.size(ring) == 5) & ~g.self_intersects(swapped), swapped).otherwise(ring)


def repair_layer(layer: DataFrame, cell: float, above: float = 0.4, sliver: float = 10.0, tolerance: float | None = None, overlaps: str = "area") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired, log, quarantine) by fixed steps: invalid, holes, overlaps, slivers, multiparts, copies, simplify, empty.

    ``overlaps``: with ``area`` smaller features whose boxes overlap by more than ``above`` go; with ``clip`` smaller ones are
    cut to what larger ones leave of them, as convex parts (a feature of which nothing would be left stays as it is).

    ``log`` counts the features after each step. Rings that still cross themselves go to ``quarantine``.
    """
    spark, log = layer.sparkSession, []

    def step(name: str, df: DataFrame) -> DataFrame:
        df = cut(df)
        log.append((len(log) + 1, name, df.count()))
        return df

    changed = lambda df, change: df.withColumn("parts", F.transform("parts", lambda p: F.struct(change(p["shell"]).alias("shell"), p["holes"].alias("holes"))))
    df = changed(layer.repartition(shuffle_partitions(spark)), _closed)  # few bytes are much work
    df = cut(changed(df, _untied).withColumn("crossing", F.exists("parts", lambda p: g.self_intersects(p["shell"]))))
    quarantine = df.where("crossing").drop("crossing")
    df = step("invalid", df.where("not crossing").drop("crossing"))
    df = step("holes", df.withColumn("parts", F.transform("parts", lambda p: F.struct(p["shell"].alias("shell"), g.fill_holes(p["holes"], None).alias("holes")))))
    if overlaps not in ("area", "clip"):
        raise ValueError(f"unknown way {overlaps}")
    df = step("overlaps", greedy_suppress(df, "fid", cell, above) if overlaps == "area" else flatten_polygons(with_bounds(df.select("fid", "parts")), "fid", cell))
    df = step("slivers", df.where(polygon_area(F.col("parts")) >= sliver))
    df = step("multiparts", df.select("fid", F.explode("parts").alias("part")).select("fid", F.col("part.shell").alias("ring")))
    first = df.groupBy("ring").agg(F.min("fid").alias("fid"))
    df = step("copies", first.select("fid", "ring"))
    if tolerance is not None:
        df = step("simplify", df.withColumn("ring", simplify(F.col("ring"), tolerance)))
    df = step("empty", df.where(F.col("ring").isNotNull() & (g.area(F.col("ring")) > 0)))
    return df, spark.createDataFrame(log, "step int, name string, features long"), quarantine


def check_topology(layer: DataFrame) -> DataFrame:
    """(fid, rule) of each ring rule that a part breaks."""
    parts = layer.select("fid", F.explode("parts").alias("p"))
    rules = g.ring_checks(F.col("p.shell")) | {"crosses_itself": g.self_intersects(F.col("p.shell"))}
    hits = F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    return parts.select("fid", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule"))


def topology_report(layer: DataFrame, cell: float, lines: DataFrame | None = None, points: DataFrame | None = None, metres: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows, flagged): every broken rule as (rule, id_1, id_2, measure), and the features (layer, id) that break one.

    Ring rules of ``layer`` (id_2 null), overlaps and containments of its valid features, crossings of ``lines`` (fid, segment
    x0, y0 to x1, y1) and ``points`` (fid, lon, lat) nearer than ``metres``.
    """
    empty = [F.lit(None).cast("long").alias("id_2"), F.lit(None).cast("double").alias("measure")]
    rows = check_topology(layer).select("rule", F.col("fid").alias("id_1"), *empty).withColumn("layer", F.lit("areas"))
    pairs = topology_rules(with_bounds(layer.select("fid", "parts")), "fid", cell, lines=lines)
    rows = rows.unionByName(pairs.withColumn("layer", F.when(F.col("rule") == "cross", "lines").otherwise("areas")))
    if points is not None:
        near = near_duplicate_points(points, "fid", metres)
        rows = rows.unionByName(near.select(F.lit("near").alias("rule"), "id_1", "id_2", F.col("metres").alias("measure"), F.lit("points").alias("layer")))
    rows = cut(rows)
    flagged = rows.select("layer", F.explode(F.array("id_1", "id_2")).alias("id")).where("id is not null").distinct()
    return rows.select("rule", "id_1", "id_2", "measure"), flagged


def regularize_layer(rings: DataFrame, tolerance: float = 0.5, min_area: float = 20.0, within: float = 10.0, smooth: int = 0) -> DataFrame:
    """fid, ring: large enough rings simplified, their edges snapped to the main directions, optionally smoothed."""
    df = rings.where(g.area(F.col("ring")) >= min_area).withColumn("ring", simplify(F.col("ring"), tolerance))
    df = df.withColumn("ring", snap_edges(F.col("ring"), within))
    return df.withColumn("ring", g.chaikin(F.col("ring"), smooth)) if smooth else df


def regularize_lonlat(
    rings: DataFrame, tolerance: float = 0.5, min_area: float = 20.0, within: float = 10.0, smooth: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(result, record) of building outlines (fid, ring) in longitude and latitude, worked on in metres.

    The layer goes to the UTM zone of its mean position; rings are closed and untied, those below ``min_area`` go, the rest
    are simplified, their edges snapped, optionally smoothed, and brought back. ``result`` has fid, ring, area in square
    metres and direction (degrees of the simplified outline). ``record`` has the outlines after each step, in longitude and
    latitude: step, name, fid, ring. Rings that cross themselves and can't be untied are left out.
    """
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c]) / F.size("ring")
    middle = rings.where("size(ring) > 0").agg(F.avg(mean("x")).alias("lon"), F.avg(mean("y")).alias("lat")).first()  # one row
    lon, lat = middle["lon"] or 0.0, middle["lat"] or 0.0
    zone, south = int((lon + 180) // 6 % 60) + 1, lat < 0
    steps = []

    def record(name: str, df: DataFrame) -> DataFrame:
        df = cut(df)
        steps.append(df.select(F.lit(len(steps)).alias("step"), F.lit(name).alias("name"), "fid", from_utm(F.col("ring"), zone, south).alias("ring")))
        return df

    df = cut(rings.where("size(ring) > 2").select("fid", into_utm(F.col("ring"), zone, south).alias("ring")))
    df = cut(df.withColumn("ring", _closed(F.col("ring")))).withColumn("ring", _untied(F.col("ring")))
    df = record("fixed", df.where(~g.self_intersects(F.col("ring")) & (g.area(F.col("ring")) > 0)))
    df = record("area", df.where(g.area(F.col("ring")) >= min_area))
    df = record("simplified", df.withColumn("ring", simplify(F.col("ring"), tolerance)))
    turned = df.select("fid", rectangle_direction(F.col("ring")).alias("direction"))
    df = record("snapped", df.withColumn("ring", snap_edges(F.col("ring"), within)))
    if smooth:
        df = record("smoothed", df.withColumn("ring", g.chaikin(F.col("ring"), smooth)))
    df = record("final", df.withColumn("ring", _closed(F.col("ring"))).where(g.area(F.col("ring")) > 0))
    result = df.select("fid", g.area(F.col("ring")).alias("area"), from_utm(F.col("ring"), zone, south).alias("ring")).join(turned, "fid").select("fid", "ring", "area", "direction")
    whole = steps[0]
    for more in steps[1:]:
        whole = whole.unionByName(more)
    return result, whole


def postprocess_layer(rings: DataFrame, tolerance: float = 0.5, smooth: int = 1, min_area: float = 10.0, kind: str | None = None) -> DataFrame:
    """Simplify, smooth, square, drop small ones, and measure: area, perimeter, compactness.

    With ``kind``, a column of class names, only rows of class ``building`` are squared.
    """
    spread = rings.repartition(shuffle_partitions(rings.sparkSession))  # few bytes are much work
    df = spread.withColumn("ring", simplify(F.col("ring"), tolerance)).withColumn("ring", g.chaikin(F.col("ring"), smooth))
    squared = square_corners(F.col("ring"))
    squared = squared if kind is None else F.when(F.col(kind) == "building", squared).otherwise(F.col("ring"))
    df = cut(df.withColumn("ring", squared)).where(g.area(F.col("ring")) >= min_area)  # what uses the ring doesn't make it anew
    ring = F.col("ring")
    return df.select("fid", *([kind] if kind else []), "ring", g.area(ring).alias("area"), g.perimeter(ring).alias("perimeter"), g.compactness(ring).alias("compactness"))


def merge_tile_features(tiles: list[DataFrame], key: str, cell: float, min_area: float, above: float = 0.6) -> DataFrame:
    """Features of several tiles: large enough, and each later one with IoU >= ``above`` to a kept one dropped."""
    df = tiles[0]
    for more in tiles[1:]:
        df = df.unionByName(more)
    df = df.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (box_area() >= min_area))
    return greedy_suppress(df, key, cell, above, inclusive=True)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two rows of ring layers: features, area and mean number of vertices before and after."""
    one = lambda name, df: df.agg(F.lit(name).alias("state"), F.count("*").alias("n"), F.sum(g.area(F.col("ring"))).alias("area"), F.avg(F.size("ring")).alias("vertices"))
    return one("before", before).unionByName(one("after", after))
