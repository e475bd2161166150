"""Queries on vector layers with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.operators import vector as v
from fieldloom.operators.grid import box_area, mixed_pairs
from fieldloom.sources.fixtures import cte, layer

MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
AREA = "(x1 - x0) * (y1 - y0)"
IN_BOX = "p.x >= b.x0 AND p.x <= b.x1 AND p.y >= b.y0 AND p.y <= b.y1"
IN_ZONE = "p.x >= b.x0 AND p.x < b.x1 AND p.y >= b.y0 AND p.y < b.y1"

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("points_per_zone", cte("points", "zones") + f""" SELECT b.zid, b.n_name, count(p.pid) AS n_points
FROM zones b LEFT JOIN points p ON {IN_ZONE} GROUP BY ALL""")
def points_per_zone(spark, d):
    return v.count_points_per_area(layer(spark, d, "zones"), layer(spark, d, "points"), "zid", 200.0, True).select("zid", "n_name", "n_points")


@query("spatial_join", cte("points", "boxes") + f""" SELECT b.fid, b.p_brand, p.pid, p.c_mktsegment FROM boxes b JOIN points p ON {IN_BOX}""")
def spatial_join(spark, d):
    return v.spatial_join(layer(spark, d, "boxes"), layer(spark, d, "points"), 25.0).selectExpr("a_fid AS fid", "a_p_brand AS p_brand", "b_pid AS pid", "b_c_mktsegment AS c_mktsegment")


@query("count_points_per_area", cte("points", "boxes") + f""" SELECT b.fid, count(p.pid) AS n_points FROM boxes b LEFT JOIN points p ON {IN_BOX} GROUP BY ALL""")
def count_points_per_area(spark, d):
    return v.count_points_per_area(layer(spark, d, "boxes"), layer(spark, d, "points"), "fid", 25.0).select("fid", "n_points")


@query("containing_areas", cte("points", "boxes") + f""" SELECT b.fid, b.p_brand FROM boxes b WHERE EXISTS (SELECT 1 FROM points p WHERE {IN_BOX})""")
def containing_areas(spark, d):
    return v.containing_areas(layer(spark, d, "boxes"), layer(spark, d, "points"), "fid", 25.0).select("fid", "p_brand")


@query("within_distance_join", cte("points", "sites") + """ SELECT sid, pid, round(sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2), 6) AS distance
FROM sites s JOIN points p ON sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) <= 30""")
def within_distance_join(spark, d):
    pairs = v.within_distance_join(layer(spark, d, "sites"), layer(spark, d, "points"), 30.0)
    return pairs.select(F.col("a_sid").alias("sid"), F.col("b_pid").alias("pid"), F.round("distance", 6).alias("distance"))


@query("nearest_distance", cte("points", "sites") + """ SELECT pid, round(min(sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2)), 6) AS distance FROM points p, sites s GROUP BY pid""")
def nearest_distance(spark, d):
    near = v.nearest_distance(layer(spark, d, "points"), layer(spark, d, "sites"), "pid", 20.0)
    return near.select("pid", F.round("distance", 6).alias("distance"))


@query("select_by_attribute", "SELECT p_partkey, p_size FROM part WHERE p_size >= 25")
def select_by_attribute(spark, d):
    return v.select_by_attribute(spark.read.parquet(f"{d}/part.parquet"), "p_size", ">=", 25).select("p_partkey", "p_size")


@query("attribute_report", "SELECT count(*) AS total, count(*) FILTER (p_size >= 25) AS kept, count(*) FILTER (NOT coalesce(p_size >= 25, false)) AS filtered FROM part")
def attribute_report(spark, d):
    return v.attribute_report(spark.read.parquet(f"{d}/part.parquet"), "p_size", ">=", 25)


@query("requested_count", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 30 ELSE greatest(1, least(500, p_partkey)) END::INT AS n FROM part""")
def requested_count(spark, d):
    text = F.when(F.col("p_partkey") % 4 == 0, "no number here 7").otherwise(F.concat(F.lit("find 12 of "), F.col("p_partkey").cast("string"), F.lit(" 座 sites, 3 个")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", v.requested_count(text).alias("n"))


@query("mixed_size_join", cte("boxes", "zones") + f""", l AS (SELECT fid AS id, x0, y0, x1, y1 FROM boxes UNION ALL SELECT zid + 10000000, x0, y0, x1, y1 FROM zones UNION ALL SELECT 20000000, min(x0), min(y0), max(x1), max(y1) FROM zones)
SELECT a.id AS id_1, b.id AS id_2 FROM l a JOIN l b ON a.id < b.id AND {MEET}""")
def mixed_size_join(spark, d):
    zones = layer(spark, d, "zones").selectExpr("zid + 10000000 AS id", "x0", "y0", "x1", "y1")
    whole = zones.groupBy().agg(F.lit(20000000).alias("id"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    mixed = layer(spark, d, "boxes").selectExpr("fid AS id", "x0", "y0", "x1", "y1").unionByName(zones).unionByName(whole)
    return mixed_pairs(mixed, mixed, 25.0).where("a_id < b_id").select(F.col("a_id").alias("id_1"), F.col("b_id").alias("id_2"))


@query("select_intersects", cte("boxes", "zones") + f""" SELECT a.fid FROM boxes a WHERE EXISTS (SELECT 1 FROM zones b WHERE b.n_regionkey = 1 AND {MEET})""")
def select_intersects(spark, d):
    return v.select_by_location(layer(spark, d, "boxes"), layer(spark, d, "zones").where("n_regionkey = 1"), "intersects", "fid", 50.0).select("fid")


@query("select_within", cte("boxes", "zones") + f""" SELECT a.fid FROM boxes a JOIN zones b ON b.n_regionkey IN (1, 2) AND {MEET}
GROUP BY a.fid, a.x0, a.x1, a.y0, a.y1 HAVING sum({OVER}) >= (a.x1 - a.x0) * (a.y1 - a.y0) * (1 - 1e-9)""")
def select_within(spark, d):
    return v.select_by_location(layer(spark, d, "boxes"), layer(spark, d, "zones").where("n_regionkey in (1, 2)"), "within", "fid", 50.0).select("fid")


@query("select_within_union", cte("boxes") + """, b AS (SELECT x0 - 12 AS x0, y0 - 12 AS y0, x1 + 12 AS x1, y1 + 12 AS y1 FROM boxes WHERE p_brand < 'Brand#35'), p AS (SELECT a.fid, (a.x1 - a.x0) * (a.y1 - a.y0) AS area,
  greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM boxes a JOIN b ON a.p_brand >= 'Brand#35' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
xs AS (SELECT fid, x AS lo, lead(x) OVER (PARTITION BY fid ORDER BY x) AS hi FROM (SELECT fid, x0 AS x FROM p UNION SELECT fid, x1 FROM p)),
ys AS (SELECT fid, y AS lo, lead(y) OVER (PARTITION BY fid ORDER BY y) AS hi FROM (SELECT fid, y0 AS y FROM p UNION SELECT fid, y1 FROM p)),
c AS (SELECT fid, sum((xs.hi - xs.lo) * (ys.hi - ys.lo)) AS covered FROM xs JOIN ys USING (fid)
  WHERE EXISTS (SELECT 1 FROM p WHERE p.fid = xs.fid AND p.x0 <= xs.lo AND xs.hi <= p.x1 AND p.y0 <= ys.lo AND ys.hi <= p.y1) GROUP BY fid)
SELECT DISTINCT fid FROM c JOIN p USING (fid) WHERE covered >= area * (1 - 1e-9)""")
def select_within_union(spark, d):
    boxes = layer(spark, d, "boxes")
    wide = boxes.where("p_brand < 'Brand#35'").selectExpr("x0 - 12 AS x0", "y0 - 12 AS y0", "x1 + 12 AS x1", "y1 + 12 AS y1")
    return v.select_by_location(boxes.where("p_brand >= 'Brand#35'"), wide, "within", "fid", 50.0).select("fid")


@query("select_overlaps", cte("boxes", "zones") + f""" SELECT a.fid FROM boxes a JOIN zones b ON b.n_regionkey IN (1, 2) AND {MEET}
GROUP BY a.fid, a.x0, a.x1, a.y0, a.y1 HAVING sum({OVER}) > 0 AND sum({OVER}) < (a.x1 - a.x0) * (a.y1 - a.y0) * (1 - 1e-9)""")
def select_overlaps(spark, d):
    return v.select_by_location(layer(spark, d, "boxes"), layer(spark, d, "zones").where("n_regionkey in (1, 2)"), "overlaps", "fid", 50.0).select("fid")


@query("select_touches", cte("boxes", "zones") + f""" SELECT a.fid FROM boxes a JOIN zones b ON b.n_regionkey IN (1, 2) AND {MEET} GROUP BY a.fid HAVING max({OVER}) = 0""")
def select_touches(spark, d):
    return v.select_by_location(layer(spark, d, "boxes"), layer(spark, d, "zones").where("n_regionkey in (1, 2)"), "touches", "fid", 50.0).select("fid")


BOUNDS = ("min(x0) - 20 AS x0", "min(y0) - 20 AS y0", "max(x1) + 20 AS x1", "max(y1) + 20 AS y1")


@query("select_contains", cte("boxes", "zones") + f""", a AS (SELECT p_brand, {", ".join(BOUNDS)} FROM boxes GROUP BY p_brand), b AS (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM zones WHERE n_regionkey = 1)
SELECT p_brand FROM a, b WHERE a.x0 <= b.x0 AND a.y0 <= b.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1""")
def select_contains(spark, d):
    brands = layer(spark, d, "boxes").groupBy("p_brand").agg(*[F.expr(b) for b in BOUNDS])
    return v.select_by_location(brands, layer(spark, d, "zones").where("n_regionkey = 1"), "contains", "p_brand", 200.0).select("p_brand")


def _box_join(predicate: str, condition: str) -> None:
    @query(f"box_join_{predicate}", cte("boxes", "zones") + f" SELECT a.zid, b.fid FROM zones a JOIN boxes b ON {condition}")
    def box_join(spark, d):
        zones, boxes = layer(spark, d, "zones"), layer(spark, d, "boxes")
        pairs = v.box_join(boxes, zones, 50.0, predicate) if predicate == "within" else v.box_join(zones, boxes, 50.0, predicate)
        one, two = ("b_zid", "a_fid") if predicate == "within" else ("a_zid", "b_fid")
        return pairs.select(F.col(one).alias("zid"), F.col(two).alias("fid"))


_HOLDS = "a.x0 <= b.x0 AND b.x1 <= a.x1 AND a.y0 <= b.y0 AND b.y1 <= a.y1"
for _predicate, _condition in (("intersects", MEET), ("contains", _HOLDS), ("within", _HOLDS)):
    _box_join(_predicate, _condition)


@query("points_in_holed_boxes", cte("points", "boxes") + f""" SELECT b.fid, p.pid FROM boxes b JOIN points p ON {IN_BOX}
AND NOT (p.x > (2 * b.x0 + b.x1) / 3 AND p.x < (b.x0 + 2 * b.x1) / 3 AND p.y > (2 * b.y0 + b.y1) / 3 AND p.y < (b.y0 + 2 * b.y1) / 3)""")
def points_in_holed_boxes(spark, d):
    boxes = layer(spark, d, "boxes")
    third = {"x0": "(2 * x0 + x1) / 3", "y0": "(2 * y0 + y1) / 3", "x1": "(x0 + 2 * x1) / 3", "y1": "(y0 + 2 * y1) / 3"}
    holes = boxes.select("fid", *[F.expr(e).alias(n) for n, e in third.items()]).select("fid", g.box_ring().alias("hole"))
    holed = boxes.withColumn("shell", g.box_ring()).join(holes, "fid").withColumn("rings", F.array("shell", "hole"))
    pairs = v.spatial_join(holed, layer(spark, d, "points"), 25.0)
    return pairs.where(g.contains_with_holes(F.col("a_rings"), F.col("b_x"), F.col("b_y"))).select(F.col("a_fid").alias("fid"), F.col("b_pid").alias("pid"))


@query("extent_rule", cte("boxes") + """ SELECT fid, x0 >= 100 AND x1 <= 600 AND y0 >= 100 AND y1 <= 600 AS inside,
round(100 * greatest(least(x1, 600) - greatest(x0, 100), 0) * greatest(least(y1, 600) - greatest(y0, 100), 0) / ((x1 - x0) * (y1 - y0)), 1) AS share FROM boxes""")
def extent_rule(spark, d):
    return v.extent_rule(layer(spark, d, "boxes"), 100.0, 100.0, 600.0, 600.0).select("fid", "inside", "share")


@query("valid_lonlat", cte("points") + """ SELECT pid, (x - 500) BETWEEN -180 AND 180 AND (y - 500) BETWEEN -90 AND 90 AS ok FROM points""")
def valid_lonlat(spark, d):
    return layer(spark, d, "points").select("pid", v.valid_lonlat(F.col("x") - 500, F.col("y") - 500).alias("ok"))


@query("area_range", cte("boxes") + f""" SELECT fid, round({AREA}, 6) AS area FROM boxes WHERE {AREA} BETWEEN 20 AND 150""")
def area_range(spark, d):
    return v.area_range(layer(spark, d, "boxes"), 20.0, 150.0).select("fid", F.round(box_area(), 6).alias("area"))


@query("shape_filter", cte("boxes") + f""" SELECT fid FROM boxes WHERE {AREA} >= 20 AND greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) <= 4""")
def shape_filter(spark, d):
    return v.shape_filter(layer(spark, d, "boxes"), box_area(), 20.0, aspect=4.0).select("fid")


@query("overlap_pairs", cte("boxes") + f""", p AS (SELECT a.fid AS fid_1, b.fid AS fid_2, {OVER} AS o, {OVER} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS r
FROM boxes a JOIN boxes b ON a.fid < b.fid AND {MEET}) SELECT fid_1, fid_2, round(r, 4) AS overlap_ratio FROM p WHERE r > 0.05 AND o > 0""")
def overlap_pairs(spark, d):
    return v.overlap_pairs(layer(spark, d, "boxes"), "fid", 25.0, 0.05)


@query("topology_pairs", cte("boxes") + f""" SELECT 'overlap' AS rule, a.fid AS id_1, b.fid AS id_2, round({OVER}, 4) AS measure FROM boxes a JOIN boxes b ON a.fid < b.fid AND {MEET} WHERE {OVER} > 1e-4
UNION ALL SELECT 'contains', a.fid, b.fid, round((b.x1 - b.x0) * (b.y1 - b.y0) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 4) FROM boxes a JOIN boxes b ON a.fid <> b.fid AND a.x0 <= b.x0 AND b.x1 <= a.x1 AND a.y0 <= b.y0 AND b.y1 <= a.y1""")
def topology_pairs(spark, d):
    return v.topology_pairs(layer(spark, d, "boxes"), "fid", 25.0)


LONLAT = "lonlat AS (SELECT pid, 108.0::DOUBLE + x / 1000 AS lon, 34.0::DOUBLE + y / 1000 AS lat FROM points)"
HAV = "2 * 6371008.8::DOUBLE * asin(sqrt(least(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2, 1)))"


def lonlat(spark, d):
    return layer(spark, d, "points").selectExpr("pid", "108.0D + x / 1000 AS lon", "34.0D + y / 1000 AS lat")


@query("near_duplicate_points", cte("points") + f", {LONLAT} SELECT a.pid AS id_1, b.pid AS id_2, round({HAV}, 3) AS metres FROM lonlat a JOIN lonlat b ON a.pid < b.pid AND {HAV} < 300")
def near_duplicate_points(spark, d):
    return v.near_duplicate_points(lonlat(spark, d), "pid", 300.0)


@query("clip_layer", cte("boxes", "zones") + f""" SELECT a.fid, b.zid, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1
FROM boxes a JOIN zones b ON b.n_regionkey = 2 AND {MEET} WHERE {OVER} > 0""")
def clip_layer(spark, d):
    return v.clip_layer(layer(spark, d, "boxes"), layer(spark, d, "zones").where("n_regionkey = 2"), "fid", "zid", 50.0)


CELLS = """, cells AS (SELECT fid, p_brand, (x1 - x0) * (y1 - y0) AS a, r.r AS row, c.c AS col FROM boxes, LATERAL (SELECT unnest(range(ceil(y0 - 0.5)::BIGINT, ceil(y1 - 0.5)::BIGINT)) AS r) r,
LATERAL (SELECT unnest(range(ceil(x0 - 0.5)::BIGINT, ceil(x1 - 0.5)::BIGINT)) AS c) c)"""
ZCELLS = """, zcells AS (SELECT zid, r.r AS row, c.c AS col FROM zones, LATERAL (SELECT unnest(range(y0::BIGINT, y1::BIGINT)) AS r) r, LATERAL (SELECT unnest(range(x0::BIGINT, x1::BIGINT)) AS c) c WHERE n_regionkey = 2)"""


@query("rasterize", cte("boxes") + CELLS + " SELECT fid, count(*) AS n, min(row) AS r0, max(col) AS c1 FROM cells GROUP BY fid")
def rasterize(spark, d):
    return v.rasterize(layer(spark, d, "boxes"), 1.0).groupBy("fid").agg(F.count("*").alias("n"), F.min("row").alias("r0"), F.max("col").alias("c1"))


def _overlay(how):
    def run(spark, d):
        return v.overlay_cells(layer(spark, d, "boxes"), layer(spark, d, "zones").where("n_regionkey = 2"), "fid", "zid", 1.0, how)

    return run


_PIECES = "count(*)::DOUBLE AS area FROM"
query("overlay_intersection", cte("boxes", "zones") + CELLS + ZCELLS + f" SELECT fid AS a_id, zid AS b_id, {_PIECES} cells JOIN zcells USING (row, col) GROUP BY ALL")(_overlay("inner"))
query("overlay_union", cte("boxes", "zones") + CELLS + ZCELLS + f" SELECT fid AS a_id, zid AS b_id, {_PIECES} cells FULL JOIN zcells USING (row, col) GROUP BY ALL")(_overlay("full"))
query("overlay_difference", cte("boxes", "zones") + CELLS + ZCELLS + f" SELECT fid AS a_id, {_PIECES} cells ANTI JOIN zcells USING (row, col) GROUP BY ALL")(_overlay("left_anti"))


@query("dissolve", cte("boxes") + CELLS + """ SELECT p_brand, first, parts, area FROM (SELECT p_brand, min(fid) AS first, count(*) AS parts FROM boxes GROUP BY ALL)
LEFT JOIN (SELECT p_brand, count(*)::DOUBLE AS area FROM (SELECT DISTINCT p_brand, row, col FROM cells) GROUP BY ALL) USING (p_brand)""")
def dissolve(spark, d):
    return v.dissolve(layer(spark, d, "boxes"), "p_brand", "fid", 1.0)


@query("dissolve_first", cte("boxes") + CELLS + """ SELECT p_brand, first, parts, p_type, area FROM (SELECT p_brand, min(fid) AS first, count(*) AS parts, arg_min(p_type, fid) AS p_type FROM boxes GROUP BY ALL)
LEFT JOIN (SELECT p_brand, count(*)::DOUBLE AS area FROM (SELECT DISTINCT p_brand, row, col FROM cells) GROUP BY ALL) USING (p_brand)""")
def dissolve_first(spark, d):
    return v.dissolve(layer(spark, d, "boxes"), "p_brand", "fid", 1.0, ("p_type",))


@query("line_crossings", cte("boxes") + """, l AS (SELECT fid, x0 AS ax, CASE WHEN fid % 2 = 0 THEN y0 ELSE y1 END AS ay, x1 AS bx, CASE WHEN fid % 2 = 0 THEN y1 ELSE y0 END AS by FROM boxes),
s AS (SELECT a.fid AS id_1, b.fid AS id_2, (a.bx - a.ax) * (b.ay - a.ay) - (a.by - a.ay) * (b.ax - a.ax) AS s1, (a.bx - a.ax) * (b.by - a.ay) - (a.by - a.ay) * (b.bx - a.ax) AS s2,
  (b.bx - b.ax) * (a.ay - b.ay) - (b.by - b.ay) * (a.ax - b.ax) AS s3, (b.bx - b.ax) * (a.by - b.ay) - (b.by - b.ay) * (a.bx - b.ax) AS s4 FROM l a JOIN l b ON a.fid < b.fid)
SELECT id_1, id_2 FROM s WHERE s1 * s2 < 0 AND s3 * s4 < 0""")
def line_crossings(spark, d):
    lines = layer(spark, d, "boxes").selectExpr("fid", "x0", "if(fid % 2 = 0, y0, y1) AS y0", "x1", "if(fid % 2 = 0, y1, y0) AS y1")
    return v.line_crossings(lines, "fid", 25.0)


@query("geographic_area", cte("boxes") + """, b AS (SELECT fid, x0 / 10 - 50 AS x0, y0 / 20 - 20 AS y0, x1 / 10 - 50 AS x1, y1 / 20 - 20 AS y1 FROM boxes)
SELECT fid, round((x1 - x0) * 20037508.342789244::DOUBLE / 180 * (ln(tan((90 + y1) * pi() / 360)) - ln(tan((90 + y0) * pi() / 360))) * 20037508.342789244::DOUBLE / pi() * 1e-6::DOUBLE, 3) AS sq_km FROM b""")
def geographic_area(spark, d):
    boxes = layer(spark, d, "boxes").selectExpr("fid", "x0 / 10 - 50 AS x0", "y0 / 20 - 20 AS y0", "x1 / 10 - 50 AS x1", "y1 / 20 - 20 AS y1")
    return boxes.select("fid", F.round(g.geographic_area(g.box_ring(), "sq_km"), 3).alias("sq_km"))


@query("flatten_overlaps", cte("boxes") + CELLS + """, k AS (SELECT row, col, arg_max(fid, (a, -fid)) AS fid FROM cells GROUP BY ALL), n AS (SELECT fid, count(*)::DOUBLE AS kept FROM k GROUP BY ALL)
SELECT fid, count(*)::DOUBLE AS before, coalesce(any_value(kept), 0) AS kept, any_value(kept) IS NULL AS covered FROM cells LEFT JOIN n USING (fid) GROUP BY fid""")
def flatten_overlaps(spark, d):
    return v.flatten_overlaps(layer(spark, d, "boxes"), "fid", 1.0)


@query("concat_layers", cte("points", "sites") + " SELECT pid, NULL AS sid, x, y, c_mktsegment FROM points UNION ALL SELECT NULL, sid, x, y, NULL FROM sites")
def concat_layers(spark, d):
    return v.concat_layers(layer(spark, d, "points").drop("c_nationkey"), layer(spark, d, "sites")).select("pid", "sid", "x", "y", "c_mktsegment")


@query("drop_duplicate_geometry", cte("boxes") + " SELECT min(fid) AS fid FROM (SELECT fid, fid % 97 AS k, x0 - x0 % 50 AS gx, y0 - y0 % 50 AS gy FROM boxes) GROUP BY gx, gy")
def drop_duplicate_geometry(spark, d):
    coarse = layer(spark, d, "boxes").selectExpr("fid", "x0 - x0 % 50 AS gx", "y0 - y0 % 50 AS gy")
    return v.drop_duplicate_geometry(coarse, "fid", ["gx", "gy"]).select("fid")


#: Kept boxes by rank: a row goes if any kept higher-ranked box overlaps it; a recursive walk in rank order.
@query("greedy_suppress", cte("boxes") + f""", e AS (SELECT a.fid AS hi, b.fid AS lo, {OVER} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba
  FROM boxes a JOIN boxes b ON a.fid <> b.fid AND {MEET}),
f AS (SELECT hi, lo FROM e WHERE o > 0 AND o / (aa + ba - o) > 0.1 AND (aa > ba OR (aa = ba AND hi < lo))),
walk AS (WITH RECURSIVE t(n, dropped) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT n + 1, (SELECT coalesce(list(DISTINCT lo), []) FROM f WHERE hi NOT IN (SELECT x.lo FROM f x
  WHERE NOT list_contains(t.dropped, x.hi)) ) FROM t WHERE n < 12) SELECT dropped FROM t ORDER BY n DESC LIMIT 1)
SELECT fid FROM boxes, walk WHERE NOT list_contains(dropped, fid)""")
def greedy_suppress(spark, d):
    return v.greedy_suppress(layer(spark, d, "boxes"), "fid", 25.0, 0.1).select("fid")


@query("site_selection", cte("zones") + """, g AS (SELECT i, j, i * 20.0::DOUBLE AS x, j * 20.0::DOUBLE AS y FROM range(51) a(i), range(51) b(j)),
s AS (SELECT DISTINCT i, j, x, y FROM g JOIN zones z ON z.n_regionkey = 3 AND x >= x0 AND x <= x1 AND y >= y0 AND y <= y1), k AS (SELECT *, (i * 7 + j * 13) % 101 AS score FROM s)
SELECT i, j, score, row_number() OVER (ORDER BY score DESC, j, i) AS rank FROM k QUALIFY rank <= 40""")
def site_selection(spark, d):
    score = (F.col("i") * 7 + F.col("j") * 13) % 101
    return v.grid_sites(0, 0, 1000, 1000, 20, layer(spark, d, "zones").where("n_regionkey = 3"), 40, score).select("i", "j", "score", "rank")


def rings(spark, d):
    return layer(spark, d, "boxes").select("*", g.box_ring().alias("ring"))


@query("ring_measures", cte("boxes") + f""" SELECT fid, round({AREA}, 6) AS area, round({AREA} * 1e-4, 8) AS ha, round(2 * (x1 - x0 + y1 - y0), 6) AS perimeter,
round(4 * pi() * {AREA} / (4 * (x1 - x0 + y1 - y0) ** 2), 6) AS compactness, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy FROM boxes""")
def ring_measures(spark, d):
    c = g.centroid(F.col("ring"))
    return rings(spark, d).select(
        "fid", F.round(g.area(F.col("ring")), 6).alias("area"), F.round(g.area(F.col("ring"), "ha"), 8).alias("ha"), F.round(g.perimeter(F.col("ring")), 6).alias("perimeter"),
        F.round(g.compactness(F.col("ring")), 6).alias("compactness"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"),
    )


@query("point_in_polygon", cte("points", "boxes") + " SELECT b.fid, p.pid FROM boxes b JOIN points p ON p.x > b.x0 AND p.x < b.x1 AND p.y > b.y0 AND p.y < b.y1")
def point_in_polygon(spark, d):
    pairs = v.spatial_join(rings(spark, d), layer(spark, d, "points"), 25.0)
    return pairs.where(g.contains(F.col("a_ring"), F.col("b_x"), F.col("b_y"))).selectExpr("a_fid AS fid", "b_pid AS pid")


@query("reproject", cte("points") + f", {LONLAT} SELECT pid, round(lon * 20037508.342789244 / 180, 3) AS mx, round(ln(tan((90 + lat) * pi() / 360)) * 20037508.342789244 / pi(), 3) AS my, (floor((lon + 180) / 6) % 60 + 1)::INT AS zone FROM lonlat")
def reproject(spark, d):
    x, y = g.to_mercator(F.col("lon"), F.col("lat"))
    return lonlat(spark, d).select("pid", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"), g.utm_zone(F.col("lon")).alias("zone"))


@query("buffer_points", cte("sites") + " SELECT sid, 65 AS n, round(32 * 25 * 25 * sin(2 * pi() / 64), 4) AS area FROM sites")
def buffer_points(spark, d):
    ring = g.buffer_point(F.col("x"), F.col("y"), 25.0)
    b = layer(spark, d, "sites").select("sid", ring.alias("r"))
    return b.select("sid", F.size("r").alias("n"), F.round(g.area(F.col("r")), 4).alias("area"))


@query("spherical_measures", cte("points") + f", {LONLAT} SELECT a.pid, round({HAV}, 2) AS metres FROM lonlat a, (SELECT 108.5::DOUBLE AS lon, 34.5::DOUBLE AS lat) b")
def spherical_measures(spark, d):
    line = F.array(g.point(F.col("lon"), F.col("lat")), g.point(F.lit(108.5), F.lit(34.5)))
    return lonlat(spark, d).select("pid", F.round(g.haversine_length(line), 2).alias("metres"))
