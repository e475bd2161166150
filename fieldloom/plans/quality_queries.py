"""Quality checks, repair and outline queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.functions import shapes
from fieldloom.operators import quality as q
from fieldloom.sources.fixtures import cte, layer

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def polygons(spark, d):
    return q.polygon_layer(layer(spark, d, "boxes"))


def rings(spark, d):
    return layer(spark, d, "boxes").select("*", g.box_ring().alias("ring"))


OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


def _over(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return f"greatest(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}), 0) * greatest(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}), 0)"


_A, _B = ([f"{t}.{c}" for c in ("x0", "y0", "x1", "y1")] for t in "ab")
_HA, _HB = ([f"{t}.{c}" for c in ("hx0", "hy0", "hx1", "hy1")] for t in "ab")
#: Shared area of planted polygons: less the middles of holed ones, twice for two of two parts.
SHARED = f"({OVER} * (1 + (a.k = 5 AND b.k = 5)::INT) - (a.k = 4)::INT * {_over(_HA, _B)} - (b.k = 4)::INT * {_over(_A, _HB)} + (a.k = 4 AND b.k = 4)::INT * {_over(_HA, _HB)})"
BASE = cte("boxes") + ", k AS (SELECT *, fid % 97 AS k, (x1 - x0) * (y1 - y0) AS a FROM boxes)"


@query("check_layer", BASE + f""", ok AS (SELECT *, x0 + (x1 - x0) * 0.4::DOUBLE AS hx0, y0 + (y1 - y0) * 0.4::DOUBLE AS hy0, x0 + (x1 - x0) * 0.6::DOUBLE AS hx1, y0 + (y1 - y0) * 0.6::DOUBLE AS hy1, a * CASE k WHEN 4 THEN 0.96 WHEN 5 THEN 2 ELSE 1 END AS size FROM k WHERE k NOT IN (1, 2)),
o AS (SELECT a.fid, b.fid AS fid_2, {SHARED} / least(a.size, b.size) AS r FROM ok a JOIN ok b ON a.fid < b.fid AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT fid, NULL::BIGINT AS fid_2, 'Invalid' AS error_type, 'HIGH' AS severity, true AS auto_fixable, NULL::DOUBLE AS overlap_ratio FROM k WHERE k IN (1, 2)
UNION ALL SELECT fid, NULL, 'Self-Intersection', 'HIGH', true, NULL FROM k WHERE k = 1
UNION ALL SELECT fid, NULL, 'Hole', 'MEDIUM', true, NULL FROM k WHERE k = 4
UNION ALL SELECT fid, fid_2, 'Overlap', 'HIGH', true, round(r, 4) FROM o WHERE r > 0.05
UNION ALL SELECT fid, NULL, 'Sliver', 'LOW', true, NULL FROM k WHERE CASE k WHEN 1 THEN 0 WHEN 2 THEN abs(a - (x0 * y0 - x0 * y1) / 2 - (x0 * y1 - x0 * y0) / 2 - (x0 * y0 - x0 * y1) / 2) WHEN 4 THEN a * 0.96 WHEN 5 THEN 2 * a ELSE a END < 5
UNION ALL SELECT fid, NULL, 'MultiPart', 'LOW', true, NULL FROM k WHERE k = 5""")
def check_layer(spark, d):
    return q.check_layer(polygons(spark, d), 25.0)


@query("check_topology", BASE + """ SELECT fid, 'crosses_itself' AS rule FROM k WHERE k = 1 UNION ALL SELECT fid, 'unclosed' FROM k WHERE k = 2 UNION ALL SELECT fid, 'repeated' FROM k WHERE k = 3
UNION ALL SELECT fid, 'small' FROM k WHERE k = 1""")
def check_topology(spark, d):
    return q.check_topology(polygons(spark, d))


_LL = "SELECT p_partkey AS fid, 108.0::DOUBLE + x0 / 1000 AS lon, 34.0::DOUBLE + y0 / 1000 AS lat FROM boxes JOIN part ON p_partkey = fid"
_HAV = "2 * 6371008.8::DOUBLE * asin(sqrt(least(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2, 1)))"


@query("topology_report", BASE + f""", ok AS (SELECT *, x0 + (x1 - x0) * 0.4::DOUBLE AS hx0, y0 + (y1 - y0) * 0.4::DOUBLE AS hy0, x0 + (x1 - x0) * 0.6::DOUBLE AS hx1, y0 + (y1 - y0) * 0.6::DOUBLE AS hy1, a * CASE k WHEN 4 THEN 0.96 WHEN 5 THEN 2 ELSE 1 END AS size FROM k WHERE k NOT IN (1, 2)),
s AS (SELECT a.fid AS id_1, b.fid AS id_2, {SHARED} AS s, a.size AS a_size, b.size AS b_size FROM ok a JOIN ok b ON a.fid <> b.fid AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1), ll AS ({_LL})
SELECT 'crosses_itself' AS rule, fid AS id_1, NULL::BIGINT AS id_2, NULL::DOUBLE AS measure FROM k WHERE k = 1 UNION ALL SELECT 'unclosed', fid, NULL, NULL FROM k WHERE k = 2 UNION ALL SELECT 'repeated', fid, NULL, NULL FROM k WHERE k = 3 UNION ALL SELECT 'small', fid, NULL, NULL FROM k WHERE k = 1
UNION ALL SELECT 'overlap', id_1, id_2, round(s, 4) FROM s WHERE id_1 < id_2 AND s > 1e-4 UNION ALL SELECT 'contains', id_1, id_2, round(b_size / a_size, 4) FROM s WHERE s >= b_size * (1 - 1e-9)
UNION ALL SELECT 'near', a.fid, b.fid, round({_HAV}, 3) FROM ll a JOIN ll b ON a.fid < b.fid AND {_HAV} < 200""")
def topology_report(spark, d):
    points = layer(spark, d, "boxes").selectExpr("fid", "108.0D + x0 / 1000 AS lon", "34.0D + y0 / 1000 AS lat")
    return q.topology_report(polygons(spark, d), 25.0, points=points, metres=200.0)[0]


#: Boxes that the suppression keeps (as in greedy_suppress), and the features that each step of the repair leaves.
_WALK = f""", o AS (SELECT a.fid AS hi, b.fid AS lo, {OVER} AS o, a.a AS aa, b.a AS ba FROM k a JOIN k b ON a.fid <> b.fid AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
f AS (SELECT hi, lo FROM o WHERE o > 0 AND o / (aa + ba - o) > 0.4 AND (aa > ba OR (aa = ba AND hi < lo))),
walk AS (WITH RECURSIVE t(n, dropped) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT n + 1, (SELECT coalesce(list(DISTINCT lo), []) FROM f WHERE hi NOT IN (SELECT x.lo FROM f x WHERE NOT list_contains(t.dropped, x.hi))) FROM t WHERE n < 12) SELECT dropped FROM t ORDER BY n DESC LIMIT 1),
kept AS (SELECT k.* FROM k, walk WHERE NOT list_contains(dropped, fid)), large AS (SELECT * FROM kept WHERE a * CASE k WHEN 5 THEN 2 ELSE 1 END >= 10),
parts AS (SELECT fid, a, unnest(range(CASE k WHEN 5 THEN 2 ELSE 1 END)) AS part, x0, y0, x1, y1 FROM large), alone AS (SELECT min(fid) AS fid, any_value(a) AS a FROM parts GROUP BY part, x0, y0, x1, y1)"""


@query("repair_layer", BASE + _WALK + " SELECT fid, round(a, 4) AS area, 5 AS vertices FROM alone")
def repair_layer(spark, d):
    fixed, _, _ = q.repair_layer(polygons(spark, d), 25.0)
    return fixed.select("fid", F.round(g.area(F.col("ring")), 4).alias("area"), F.size("ring").alias("vertices"))


@query("repair_log", BASE + _WALK + """ SELECT 1 AS step, 'invalid' AS name, count(*) AS features FROM k UNION ALL SELECT 2, 'holes', count(*) FROM k UNION ALL SELECT 3, 'overlaps', count(*) FROM kept
UNION ALL SELECT 4, 'slivers', count(*) FROM large UNION ALL SELECT 5, 'multiparts', count(*) FROM parts UNION ALL SELECT 6, 'copies', count(*) FROM alone UNION ALL SELECT 7, 'empty', count(*) FROM alone""")
def repair_log(spark, d):
    return q.repair_layer(polygons(spark, d), 25.0)[1]


#: A box's edges lie in the main directions already: regularising keeps its area and its five vertices.
@query("regularize_layer", BASE + " SELECT fid, round(a, 4) AS area, 5 AS vertices FROM k WHERE a >= 20.005")
def regularize_layer(spark, d):
    out = q.regularize_layer(rings(spark, d), min_area=20.005)
    return out.select("fid", F.round(g.area(F.col("ring")), 4).alias("area"), F.size("ring").alias("vertices"))


@query("postprocess_layer")
def postprocess_layer(spark, d):
    out = q.postprocess_layer(rings(spark, d))
    return out.select("fid", *[F.round(c, 4).alias(c) for c in ("area", "perimeter", "compactness")])


#: One round of corner cutting by a quarter takes eight triangles' worth: 1/8 of a box.
@query("chaikin_smooth", BASE + " SELECT fid, 9 AS vertices, round(a * 7 / 8, 4) AS area FROM k")
def chaikin_smooth(spark, d):
    s = rings(spark, d).select("fid", g.chaikin(F.col("ring"), 1).alias("r"))
    return s.select("fid", F.size("r").alias("vertices"), F.round(g.area(F.col("r")), 4).alias("area"))


@query("simplify", BASE + " SELECT fid, 5 AS vertices FROM k")
def simplify(spark, d):
    dense = rings(spark, d).select("fid", F.flatten(F.transform(g.edges(F.col("ring")), lambda e: F.array(e["a"], g.point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2)))).alias("r"), "ring")
    closed = dense.select("fid", F.concat("r", F.slice("ring", 1, 1)).alias("r"))
    return closed.select("fid", F.size(shapes.simplify(F.col("r"), 0.01)).alias("vertices"))


@query("main_direction_mrr", BASE + " SELECT fid, CASE WHEN x1 - x0 >= y1 - y0 THEN 0.0 ELSE 90.0 END::DOUBLE AS degrees FROM k WHERE abs((x1 - x0) - (y1 - y0)) > 1e-6")
def main_direction_mrr(spark, d):
    r = rings(spark, d).where("abs((x1 - x0) - (y1 - y0)) > 1e-6")
    return r.select("fid", F.round(shapes.rectangle_direction(F.col("ring")), 6).alias("degrees"))


@query("explode_multipart", BASE + " SELECT fid, n, round(a, 4) AS area FROM k, LATERAL (SELECT unnest(range(CASE WHEN k = 5 THEN 2 ELSE 1 END)) AS n) WHERE k NOT IN (1, 2)")
def explode_multipart(spark, d):
    p = polygons(spark, d).where("fid % 97 not in (1, 2)").select("fid", F.posexplode("parts").alias("n", "p"))
    return p.select("fid", F.col("n").cast("long").alias("n"), F.round(g.area(F.col("p.shell")), 4).alias("area"))


@query("self_intersection", BASE + " SELECT fid, k = 1 AS crosses FROM k")
def self_intersection(spark, d):
    return polygons(spark, d).select("fid", g.self_intersects(F.col("parts")[0]["shell"]).alias("crosses"))


@query("track_position", BASE + """, p AS (SELECT fid, x0, y0, x1 - x0 AS w, y1 - y0 AS h, (fid % 20) / 10.0::DOUBLE AS f FROM k), s AS (SELECT *, CASE WHEN f > 1 THEN 2 - f ELSE f END * (w + h) AS s FROM p)
SELECT fid, round(x0 + least(s, w), 5) AS x, round(y0 + greatest(s - w, 0), 5) AS y FROM s""")
def track_position(spark, d):
    line = F.slice("ring", 1, 3)
    at = rings(spark, d).select("fid", g.position_at(line, (F.col("fid") % 20) / F.lit(10.0)).alias("p"))
    return at.select("fid", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query("merge_tile_features")
def merge_tile_features(spark, d):
    b = layer(spark, d, "boxes").select("fid", "x0", "y0", "x1", "y1")
    moved = b.selectExpr("fid + 1000000 AS fid", "x0 + 0.1D AS x0", "y0", "x1 + 0.1D AS x1", "y1")
    return q.merge_tile_features([b, moved], "fid", 25.0, 30.0).select("fid")



@query("before_after_stats", BASE + " SELECT 'before' AS state, count(*) AS n, round(sum(a), 4) AS area, 5.0::DOUBLE AS vertices FROM k UNION ALL SELECT 'after', count(*), round(sum(a * 7 / 8), 4), 9.0 FROM k")
def before_after_stats(spark, d):
    r = rings(spark, d).select("fid", "ring")
    s = q.before_after(r, r.select("fid", g.chaikin(F.col("ring"), 1).alias("ring")))
    return s.select("state", "n", F.round("area", 4).alias("area"), "vertices")
