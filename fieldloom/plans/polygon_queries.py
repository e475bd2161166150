"""Queries on general polygons and exact overlays with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.functions import shapes
from fieldloom.operators import overlay as o
from fieldloom.operators import polygons as p
from fieldloom.operators import quality as q
from fieldloom.sources.fixtures import QUAD_CORNERS, cte, layer, quads, triangles

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Vertices (fid, k, x, y) of slanted quadrilaterals, and with the vertices before and after.
_CORNERS = " UNION ALL ".join(f"SELECT fid, {k} AS k, {x} AS x, {y} AS y FROM boxes" for k, (x, y) in enumerate(QUAD_CORNERS))
QUADS = cte("boxes", "zones") + f""", v AS ({_CORNERS}),
e AS (SELECT fid, k, x, y, lead(x, 1, f.x) OVER w AS nx, lead(y, 1, f.y) OVER w AS ny FROM (SELECT *, {{'x': first(x) OVER (PARTITION BY fid ORDER BY k), 'y': first(y) OVER (PARTITION BY fid ORDER BY k)}} AS f FROM v) WINDOW w AS (PARTITION BY fid ORDER BY k))"""
#: Edges of the lower left half of each zone.
TRIANGLES = """, te AS (SELECT zid AS fid, 0 AS k, x0 AS x, y0 AS y, x1 AS nx, y0 AS ny FROM zones UNION ALL SELECT zid, 1, x1, y0, x0, y1 FROM zones UNION ALL SELECT zid, 2, x0, y1, x0, y0 FROM zones)"""


def _shared(a: str, b: str, where: str) -> str:
    """CTE ``shared`` (a_id, b_id, area) of convex polygons given by edges turned to the left: the hull of corners inside and edge crossings."""
    inside = lambda c, e: f"(e.nx - e.x) * ({c}.y - e.y) - (e.ny - e.y) * ({c}.x - e.x) >= 0"
    return f""", ab AS (SELECT fid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {a} GROUP BY fid), bb AS (SELECT fid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {b} GROUP BY fid),
pairs AS MATERIALIZED (SELECT s.fid AS a_id, t.fid AS b_id FROM ab s JOIN bb t ON {where} AND s.x0 <= t.x1 AND t.x0 <= s.x1 AND s.y0 <= t.y1 AND t.y0 <= s.y1),
pts AS (SELECT a_id, b_id, c.x, c.y FROM pairs JOIN {a} c ON c.fid = a_id JOIN {b} e ON e.fid = b_id GROUP BY a_id, b_id, c.k, c.x, c.y HAVING bool_and({inside("c", "e")})
  UNION ALL SELECT a_id, b_id, c.x, c.y FROM pairs JOIN {b} c ON c.fid = b_id JOIN {a} e ON e.fid = a_id GROUP BY a_id, b_id, c.k, c.x, c.y HAVING bool_and({inside("c", "e")})
  UNION ALL SELECT a_id, b_id, x + t * dx, y + t * dy FROM (SELECT a_id, b_id, m.x, m.y, m.nx - m.x AS dx, m.ny - m.y AS dy, (m.nx - m.x) * (n.ny - n.y) - (m.ny - m.y) * (n.nx - n.x) AS det,
    ((n.x - m.x) * (n.ny - n.y) - (n.y - m.y) * (n.nx - n.x)) / nullif(det, 0) AS t, ((n.x - m.x) * (m.ny - m.y) - (n.y - m.y) * (m.nx - m.x)) / nullif(det, 0) AS u FROM pairs JOIN {a} m ON m.fid = a_id JOIN {b} n ON n.fid = b_id)
    WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
turned AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS angle FROM pts WINDOW w AS (PARTITION BY a_id, b_id)),
closed AS (SELECT a_id, b_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny, count(*) OVER (PARTITION BY a_id, b_id) AS n FROM turned WINDOW w AS (PARTITION BY a_id, b_id ORDER BY angle, x, y)),
shared AS (SELECT a_id, b_id, sum(x * ny - nx * y) / 2 AS area FROM closed WHERE n > 2 GROUP BY a_id, b_id),
aa AS (SELECT fid AS a_id, sum(x * ny - nx * y) / 2 AS a_area FROM {a} GROUP BY fid), ba AS (SELECT fid AS b_id, sum(x * ny - nx * y) / 2 AS b_area FROM {b} GROUP BY fid)"""


@query("overlap_pairs_exact", QUADS + _shared("e", "e", "s.fid < t.fid") + " SELECT a_id AS fid_1, b_id AS fid_2, round(area / least(a_area, b_area), 4) AS overlap_ratio FROM shared JOIN aa USING (a_id) JOIN ba USING (b_id) WHERE area / least(a_area, b_area) > 0.05")
def overlap_pairs_exact(spark, d):
    return p.overlap_pairs_exact(quads(spark, d), "fid", 25.0, 0.05)


_LINES = ", l AS (SELECT fid, x0 AS ax, CASE WHEN fid % 2 = 0 THEN y0 ELSE y1 END AS ay, x1 AS bx, CASE WHEN fid % 2 = 0 THEN y1 ELSE y0 END AS by FROM boxes), ls AS (SELECT a.fid AS id_1, b.fid AS id_2, (a.bx - a.ax) * (b.ay - a.ay) - (a.by - a.ay) * (b.ax - a.ax) AS s1, (a.bx - a.ax) * (b.by - a.ay) - (a.by - a.ay) * (b.bx - a.ax) AS s2, (b.bx - b.ax) * (a.ay - b.ay) - (b.by - b.ay) * (a.ax - b.ax) AS s3, (b.bx - b.ax) * (a.by - b.ay) - (b.by - b.ay) * (a.bx - b.ax) AS s4 FROM l a JOIN l b ON a.fid < b.fid)"


@query("topology_rules", QUADS + _LINES + _shared("e", "e", "s.fid < t.fid") + """ SELECT 'overlap' AS rule, a_id AS id_1, b_id AS id_2, round(area, 4) AS measure FROM shared WHERE area > 1e-4
UNION ALL SELECT 'contains', a_id, b_id, round(b_area / a_area, 4) FROM shared JOIN aa USING (a_id) JOIN ba USING (b_id) WHERE area >= b_area * (1 - 1e-9)
UNION ALL SELECT 'contains', b_id, a_id, round(a_area / b_area, 4) FROM shared JOIN aa USING (a_id) JOIN ba USING (b_id) WHERE area >= a_area * (1 - 1e-9)
UNION ALL SELECT 'cross', id_1, id_2, NULL FROM ls WHERE s1 * s2 < 0 AND s3 * s4 < 0""")
def topology_rules(spark, d):
    lines = layer(spark, d, "boxes").selectExpr("fid", "x0", "if(fid % 2 = 0, y0, y1) AS y0", "x1", "if(fid % 2 = 0, y1, y0) AS y1")
    return p.topology_rules(quads(spark, d), "fid", 25.0, lines=lines)


@query("clip_polygons", QUADS + TRIANGLES + _shared("e", "te", "true") + " SELECT a_id AS fid, b_id AS zid, 1 AS n_parts, round(area + 1e-7::DOUBLE, 4) AS area FROM shared WHERE area > 1e-9")
def clip_polygons(spark, d):
    out = p.clip_polygons(quads(spark, d), triangles(spark, d), "fid", "zid", 50.0)
    return out.where("area > 1e-9").select("fid", "zid", F.size("parts").alias("n_parts"), F.round(F.col("area") + 1e-7, 4).alias("area"))


def _selected(relation: str, test: str) -> None:
    @query(f"select_polygons_{relation}", QUADS + TRIANGLES + _shared("e", "te", "true") + f" SELECT DISTINCT a_id AS fid FROM shared JOIN aa USING (a_id) JOIN ba USING (b_id) WHERE {test}")
    def select_polygons(spark, d):
        return p.select_polygons(quads(spark, d), triangles(spark, d), relation, "fid", "zid", 50.0).select("fid")


_selected("within", "area >= a_area * (1 - 1e-9)")
_selected("overlaps", "area > least(a_area, b_area) * 1e-12 AND area < a_area * (1 - 1e-9) AND area < b_area * (1 - 1e-9)")


#: Corners moved by the corner before them, all from the given ring; rings that would cross themselves (``tied``) stay.
_SQUARED = """, n AS (SELECT fid, (k + 1) % 4 AS k, x AS px, y AS py, nx - x AS ax, ny - y AS ay, lag(x, 1) OVER w AS bx, lag(y, 1) OVER w AS bz, last(x) OVER (PARTITION BY fid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx,
  last(y) OVER (PARTITION BY fid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ly FROM e WINDOW w AS (PARTITION BY fid ORDER BY k)),
m AS (SELECT fid, k, px, py, ax, ay, sqrt(ax * ax + ay * ay) AS reach, coalesce(bx, lx) - px AS bx, coalesce(bz, ly) - py AS bz FROM n),
s AS (SELECT *, (ax * bx + ay * bz) / (bx * bx + bz * bz) AS f, degrees(acos((ax * bx + ay * bz) / reach / sqrt(bx * bx + bz * bz))) AS angle FROM m),
r AS (SELECT fid, k, px + reach * (ax - f * bx) / sqrt((ax - f * bx) ** 2 + (ay - f * bz) ** 2) AS sx, py + reach * (ay - f * bz) / sqrt((ax - f * bx) ** 2 + (ay - f * bz) ** 2) AS sy FROM s WHERE angle > 70 AND angle < 110),
g AS (SELECT fid, k, coalesce(sx, x) AS x, coalesce(sy, y) AS y FROM e LEFT JOIN r USING (fid, k)), h AS (SELECT g.fid, g.k, g.x, g.y, j.x AS nx, j.y AS ny FROM g JOIN g j ON j.fid = g.fid AND j.k = (g.k + 1) % 4),
tied AS (SELECT DISTINCT c.fid FROM h c JOIN h d ON d.fid = c.fid AND d.k = c.k + 2
  WHERE ((c.nx - c.x) * (d.y - c.y) - (c.ny - c.y) * (d.x - c.x)) * ((c.nx - c.x) * (d.ny - c.y) - (c.ny - c.y) * (d.nx - c.x)) <= 0
  AND ((d.nx - d.x) * (c.y - d.y) - (d.ny - d.y) * (c.x - d.x)) * ((d.nx - d.x) * (c.ny - d.y) - (d.ny - d.y) * (c.nx - d.x)) <= 0),
squared AS (SELECT fid, k, x, y FROM g ANTI JOIN tied USING (fid) UNION ALL SELECT fid, k, x, y FROM e SEMI JOIN tied USING (fid))"""


def _vertices(df):
    return df.select("fid", F.posexplode(F.slice("ring", 1, 4)).alias("k", "p")).select("fid", "k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("square_corners", QUADS + _SQUARED + " SELECT fid, k, round(x, 4) AS x, round(y, 4) AS y FROM squared")
def square_corners(spark, d):
    return _vertices(quads(spark, d).select("fid", shapes.square_corners(F.col("ring")).alias("ring")))


_SNAPPED = """, a AS (SELECT *, (x + nx) / 2 AS mx, (y + ny) / 2 AS my, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS len, (degrees(atan2(ny - y, nx - x)) + 360) % 180 AS deg FROM e),
b AS (SELECT *, radians(round(deg / 45) * 45) AS t, abs(deg - round(deg / 45) * 45) <= 10 AS turn FROM a),
c AS (SELECT *, CASE WHEN cos(t) * (nx - x) + sin(t) * (ny - y) < 0 THEN -1 ELSE 1 END AS sign FROM b),
u AS (SELECT fid, k, CASE WHEN turn THEN sign * cos(t) ELSE (nx - x) / len END AS ux, CASE WHEN turn THEN sign * sin(t) ELSE (ny - y) / len END AS uy, mx, my, len FROM c),
z AS (SELECT s.fid, s.k, s.ux, s.uy, s.mx, s.my, l.ux AS lx, l.uy AS ly, l.mx AS nx, l.my AS ny FROM u s JOIN u l ON l.fid = s.fid AND l.k = (s.k + 3) % 4),
w AS (SELECT fid, k, nx + t * lx AS x, ny + t * ly AS y FROM (SELECT *, ((mx - nx) * uy - (my - ny) * ux) / (lx * uy - ly * ux) AS t FROM z))"""


@query("snap_edges", QUADS + _SNAPPED + " SELECT fid, k, round(x, 4) AS x, round(y, 4) AS y FROM w")
def snap_edges(spark, d):
    return _vertices(quads(spark, d).select("fid", shapes.snap_edges(F.col("ring")).alias("ring")))


@query("regularize_slanted", QUADS + _SNAPPED + """, area AS (SELECT fid, sum(x * ny - nx * y) / 2 AS area FROM e GROUP BY fid), wn AS (SELECT w.fid, w.x, w.y, n.x AS nx, n.y AS ny FROM w JOIN w n ON n.fid = w.fid AND n.k = (w.k + 1) % 4)
SELECT wn.fid, round(sum(x * ny - nx * y) / 2 + 1e-6::DOUBLE, 3) AS area FROM wn JOIN area ON wn.fid = area.fid AND area.area >= 30.0005 GROUP BY wn.fid""")
def regularize_slanted(spark, d):
    out = q.regularize_layer(quads(spark, d).select("fid", "ring"), tolerance=0.01, min_area=30.0005)
    return out.select("fid", F.round(g.area(F.col("ring")) + 1e-6, 3).alias("area"))


@query("postprocess_slanted", QUADS + _SQUARED + """, wn AS (SELECT w.fid, w.x, w.y, o.x AS nx, o.y AS ny FROM squared w JOIN squared o ON o.fid = w.fid AND o.k = (w.k + 1) % 4),
measured AS (SELECT fid, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) AS perimeter FROM wn GROUP BY fid)
SELECT fid, round(area + 1e-6::DOUBLE, 3) AS area, round(perimeter, 3) AS perimeter, round(4 * pi() * area / perimeter ** 2, 4) AS compactness FROM measured WHERE area >= 10.0005""")
def postprocess_slanted(spark, d):
    out = q.postprocess_layer(quads(spark, d).select("fid", "ring"), tolerance=0.01, smooth=0, min_area=10.0005)
    return out.select("fid", F.round(F.col("area") + 1e-6, 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), F.round("compactness", 4).alias("compactness"))


# Exact overlays of boxes.


def _union_of(pieces: str) -> str:
    """CTE ``c`` (id, covered) of the union of each id's boxes in ``pieces``: elementary cells between all borders."""
    return f""", xs AS (SELECT id, x AS lo, lead(x) OVER (PARTITION BY id ORDER BY x) AS hi FROM (SELECT id, x0 AS x FROM {pieces} UNION SELECT id, x1 FROM {pieces})),
ys AS (SELECT id, y AS lo, lead(y) OVER (PARTITION BY id ORDER BY y) AS hi FROM (SELECT id, y0 AS y FROM {pieces} UNION SELECT id, y1 FROM {pieces})),
c AS (SELECT id, sum((xs.hi - xs.lo) * (ys.hi - ys.lo)) AS covered FROM xs JOIN ys USING (id)
  WHERE EXISTS (SELECT 1 FROM {pieces} AS p WHERE p.id = xs.id AND p.x0 <= xs.lo AND xs.hi <= p.x1 AND p.y0 <= ys.lo AND ys.hi <= p.y1) GROUP BY id)"""


_WIDE = cte("boxes") + ", l AS (SELECT fid, x0, y0, x1, y1 FROM boxes WHERE p_brand >= 'Brand#35'), r AS (SELECT fid, x0 - 12 AS x0, y0 - 12 AS y0, x1 + 12 AS x1, y1 + 12 AS y1 FROM boxes WHERE p_brand < 'Brand#35')"
_CUT = "greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1"
_BOTH = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_LEFT = f", p AS MATERIALIZED (SELECT a.fid AS id, b.fid AS other, {_CUT} FROM l a JOIN r b ON {_BOTH})" + _union_of("p")
_GONE = f", p AS MATERIALIZED (SELECT a.fid AS id, b.fid AS other, {_CUT} FROM r a JOIN l b ON {_BOTH})" + _union_of("p")


def _rest_of(side: str, ids: str) -> str:
    return f"SELECT {ids}, round((x1 - x0) * (y1 - y0) - coalesce(covered, 0), 6) AS area FROM {side} LEFT JOIN c ON c.id = {side}.fid WHERE (x1 - x0) * (y1 - y0) - coalesce(covered, 0) > (x1 - x0) * (y1 - y0) * 1e-9"


def _layers(spark, d):
    boxes = layer(spark, d, "boxes").select("fid", "p_brand", "x0", "y0", "x1", "y1")
    wide = boxes.where("p_brand < 'Brand#35'").selectExpr("fid", "x0 - 12 AS x0", "y0 - 12 AS y0", "x1 + 12 AS x1", "y1 + 12 AS y1")
    return boxes.where("p_brand >= 'Brand#35'").drop("p_brand"), wide


def _overlay(how: str):
    def run(spark, d):
        left, right = _layers(spark, d)
        out = o.overlay_areas(left, right, "fid", "fid", 37.0, how)
        return out.withColumn("area", F.round("area", 6))

    return run


_PAIRS = f"SELECT a.fid AS a_id, b.fid AS b_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area FROM l a JOIN r b ON {_BOTH}"
query("overlay_exact_intersection", _WIDE + " " + _PAIRS)(_overlay("inner"))
query("overlay_exact_difference", _WIDE + _LEFT + " " + _rest_of("l", "fid AS a_id"))(_overlay("left_anti"))
query("overlay_exact_union", f"FROM ({_WIDE} {_PAIRS}) UNION ALL FROM ({_WIDE}{_LEFT} {_rest_of('l', 'fid AS a_id, NULL AS b_id')}) UNION ALL FROM ({_WIDE}{_GONE} {_rest_of('r', 'NULL AS a_id, fid AS b_id')})")(_overlay("full"))


@query("dissolve_exact", cte("boxes") + ", p AS (SELECT p_type AS id, x0, y0, x1, y1 FROM boxes)" + _union_of("p") + " SELECT p_type, min(fid) AS first, count(*) AS parts, arg_min(p_brand, fid) AS p_brand, round(any_value(covered), 6) AS area FROM boxes JOIN c ON c.id = p_type GROUP BY p_type")
def dissolve_exact(spark, d):
    return o.dissolve_areas(layer(spark, d, "boxes"), "p_type", "fid", 60.0, ("p_brand",)).withColumn("area", F.round("area", 6))


@query("flatten_exact", cte("boxes") + f", k AS (SELECT *, (x1 - x0) * (y1 - y0) AS a FROM boxes), p AS (SELECT a.fid AS id, {_CUT} FROM k a JOIN k b ON {_BOTH} AND (b.a > a.a OR (b.a = a.a AND b.fid < a.fid)))" + _union_of("p") + """
SELECT fid, round(a, 6) AS before, CASE WHEN a - coalesce(covered, 0) <= a * 1e-9 THEN 0 ELSE round(a - coalesce(covered, 0), 6) END AS kept, a - coalesce(covered, 0) <= a * 1e-9 AS covered FROM k LEFT JOIN c ON c.id = k.fid""")
def flatten_exact(spark, d):
    out = o.flatten_areas(layer(spark, d, "boxes").select("fid", "x0", "y0", "x1", "y1"), "fid", 25.0)
    return out.select("fid", F.round("before", 6).alias("before"), F.round("kept", 6).alias("kept"), "covered")


@query("covered_zones", cte("boxes", "zones") + f", p AS (SELECT a.zid AS id, {_CUT} FROM zones a JOIN boxes b ON {_BOTH})" + _union_of("p") + " SELECT id AS zid, round(covered, 6) AS area FROM c")
def covered_zones(spark, d):
    zones, boxes = layer(spark, d, "zones").select("zid", "x0", "y0", "x1", "y1"), layer(spark, d, "boxes").select("x0", "y0", "x1", "y1")
    return o.covered_areas(zones, boxes, "zid", 50.0).withColumn("area", F.round("area", 6))


@query("flatten_polygons", cte("boxes") + f", k AS (SELECT *, (x1 - x0) * (y1 - y0) AS a FROM boxes), p AS (SELECT a.fid AS id, {_CUT} FROM k a JOIN k b ON {_BOTH} AND (b.a > a.a OR (b.a = a.a AND b.fid < a.fid)))" + _union_of("p") + """
SELECT fid, a - coalesce(covered, 0) <= a * 1e-9 AS covered, round(CASE WHEN a - coalesce(covered, 0) <= a * 1e-9 THEN a ELSE a - coalesce(covered, 0) END, 6) AS area FROM k LEFT JOIN c ON c.id = k.fid""")
def flatten_polygons(spark, d):
    boxes = layer(spark, d, "boxes").select("fid", "x0", "y0", "x1", "y1", p.as_parts(g.box_ring()).alias("parts"))
    return p.flatten_polygons(boxes, "fid", 25.0).select("fid", "covered", F.round("area", 6).alias("area"))
