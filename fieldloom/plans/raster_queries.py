"""Queries on pixel tables with their DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.operators import raster as r
from fieldloom.operators import regions
from fieldloom.operators.vector import rasterize
from fieldloom.sources.fixtures import cte, layer

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def band(spark, d, name: str = "b1"):
    return layer(spark, d, "raster").select("row", "col", F.col(name).alias("value"))


def mask(spark, d, name: str = "v"):
    return layer(spark, d, "mask").select("row", "col", F.col(name).alias("v"))


def bands(spark, d):
    p = layer(spark, d, "raster")
    return p.select("row", "col", F.lit(1).alias("band"), F.col("b1").alias("value")).union(p.select("row", "col", F.lit(2), F.col("b2")))


STATS = """min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median,
count(value) AS valid, count(*) AS total, count(*) - count(value) AS missing"""
LONG = """, long AS (SELECT row, col, 1 AS band, b1 AS value FROM raster UNION ALL SELECT row, col, 2, b2 FROM raster)"""


@query("raster_statistics", cte("raster") + LONG + f" SELECT band, {STATS} FROM long GROUP BY band")
def raster_statistics(spark, d):
    s = r.raster_statistics(bands(spark, d), ["band"])
    return s.select("band", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")], "valid", "total", "missing")


@query("raster_histogram", cte("raster") + """, e AS (SELECT min(b1) AS lo, max(b1) AS hi FROM raster)
SELECT least(floor((b1 - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM raster, e WHERE b1 IS NOT NULL GROUP BY 1""")
def raster_histogram(spark, d):
    return r.histogram(band(spark, d), 20)


@query("band_math_join", cte("raster") + " SELECT row, col, b1 AS band_1, b2 AS band_2 FROM raster")
def band_math_join(spark, d):
    return r.band_pivot(bands(spark, d), [1, 2])


@query("raster_calculator", cte("raster") + " SELECT row, col, coalesce(round((b1 - b2) / nullif(b1 + b2, 0), 8), -9999) AS value FROM raster")
def raster_calculator(spark, d):
    out = r.raster_calculator(r.band_pivot(bands(spark, d), [1, 2]), "(band_1 - band_2) / nullif(band_1 + band_2, 0)")
    return out.select("row", "col", F.round("value", 8).alias("value"))


@query("reclassify", cte("raster") + " SELECT row, col, CASE WHEN b1 >= 40 AND b1 < 80 THEN 3 WHEN b1 >= 10 AND b1 < 60 THEN 2 WHEN b1 >= 0 AND b1 < 20 THEN 1 ELSE -1 END::DOUBLE AS value FROM raster")
def reclassify(spark, d):
    return r.reclassify(band(spark, d), [(0, 20, 1), (10, 60, 2), (40, 80, 3)], -1)


GRADIENT = cte("raster") + """, l AS (SELECT row, col, other AS v, lag(other) OVER x AS w, lead(other) OVER x AS e, lag(other) OVER y AS s, lead(other) OVER y AS n,
  lag(col) OVER x IS NULL AS fx, lead(col) OVER x IS NULL AS lx, lag(row) OVER y IS NULL AS fy, lead(row) OVER y IS NULL AS ly
  FROM raster WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
g AS (SELECT row, col, (CASE WHEN lx THEN v ELSE e END - CASE WHEN fx THEN v ELSE w END) / CASE WHEN fx OR lx THEN 1 ELSE 2 END / 10 AS gx,
  (CASE WHEN ly THEN v ELSE n END - CASE WHEN fy THEN v ELSE s END) / CASE WHEN fy OR ly THEN 1 ELSE 2 END / 10 AS gy FROM l)"""


@query("slope", GRADIENT + " SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope FROM g")
def slope(spark, d):
    return r.slope(band(spark, d, "other"), 10.0).select("row", "col", F.round("slope", 5).alias("slope"))


@query("hillshade", GRADIENT + """ SELECT row, col, coalesce(greatest(least(floor(255 * (cos(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy)))
  + sin(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(gy, -gx)))), 255), 0), 0)::INT AS shade FROM g""")
def hillshade(spark, d):
    return r.hillshade(band(spark, d, "other"), 10.0)


def _resample(how: str, sql: str):
    name = f"resample_{how}"
    oracle = cte("raster") + f" SELECT row // 4 AS row, col // 4 AS col, round({sql}, 6) AS value FROM raster GROUP BY 1, 2"
    query(name, oracle)(lambda spark, d: r.resample(band(spark, d, "other"), 4, how).select("row", "col", F.round("value", 6).alias("value")))


for _how, _sql in (("average", "avg(other)"), ("max", "max(other)"), ("min", "min(other)"), ("sum", "sum(other)"), ("med", "quantile_cont(other, 0.5)"), ("q1", "quantile_cont(other, 0.25)"), ("q3", "quantile_cont(other, 0.75)")):
    _resample(_how, _sql)


@query("resample_mode", cte("raster") + """, c AS (SELECT row // 4 AS row, col // 4 AS col, b2, count(*) AS n FROM raster GROUP BY ALL)
SELECT row, col, b2 AS value FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, b2) = 1""")
def resample_mode(spark, d):
    return r.resample(band(spark, d, "b2"), 4, "mode")


def _resample_scale(name: str, scale: float) -> None:
    reach = max(1.0, 1 / scale)
    axis = "abs((t.{a} + 0.5::DOUBLE) / {s} - 0.5 - r.{a})"
    wr, wc = (f"(1 - {axis.format(a=a, s=scale)} / {reach}::DOUBLE)" for a in ("row", "col"))

    @query(name, cte("raster") + f""", e AS (SELECT floor((max(row) + 1) * {scale}::DOUBLE)::BIGINT AS h, floor((max(col) + 1) * {scale}::DOUBLE)::BIGINT AS w FROM raster),
t AS (SELECT i AS row, j AS col FROM (SELECT unnest(range(h)) AS i FROM e), (SELECT unnest(range(w)) AS j FROM e)),
s AS (SELECT t.row, t.col, {wr} * {wc} AS w, other FROM t JOIN raster r
  ON r.row BETWEEN floor((t.row + 0.5) / {scale} - 0.5 - {reach}) AND ceil((t.row + 0.5) / {scale} - 0.5 + {reach}) AND r.col BETWEEN floor((t.col + 0.5) / {scale} - 0.5 - {reach}) AND ceil((t.col + 0.5) / {scale} - 0.5 + {reach})
  WHERE {wr} > 1e-12 AND {wc} > 1e-12 AND other IS NOT NULL)
SELECT row, col, round(sum(w * other) / sum(w), 6) AS value FROM s GROUP BY row, col""")
    def resample_bilinear(spark, d):
        other = band(spark, d, "other")
        return r.resample_scale(other, scale, *r.extent(other)).select("row", "col", F.round("value", 6).alias("value"))


_resample_scale("resample_bilinear", 1.5)
_resample_scale("resample_bilinear_coarser", 0.4)


@query("resample_nearest", cte("raster") + """, e AS (SELECT floor((max(row) + 1) * 1.5::DOUBLE)::BIGINT AS h, floor((max(col) + 1) * 1.5::DOUBLE)::BIGINT AS w FROM raster),
t AS (SELECT i, j FROM (SELECT unnest(range(h)) AS i FROM e), (SELECT unnest(range(w)) AS j FROM e))
SELECT t.i AS row, t.j AS col, other AS value FROM t JOIN raster r ON r.row = floor((t.i + 0.5::DOUBLE) / 1.5)::BIGINT AND r.col = floor((t.j + 0.5::DOUBLE) / 1.5)::BIGINT WHERE other IS NOT NULL""")
def resample_nearest(spark, d):
    other = band(spark, d, "other")
    return r.resample_scale(other, 1.5, *r.extent(other), "nearest")


@query("align_raster_pair", cte("raster") + """, e AS (SELECT ceil((max(row) + 1) / 1.7::DOUBLE)::BIGINT AS h, ceil((max(col) + 1) / 1.7::DOUBLE)::BIGINT AS w FROM raster),
t AS (SELECT i AS trow, j AS tcol, (j + 0.5::DOUBLE) * 1.7 AS x, (i + 0.5::DOUBLE) * 1.7 AS y FROM (SELECT unnest(range(h)) AS i FROM e), (SELECT unnest(range(w)) AS j FROM e)),
f AS (SELECT trow, tcol, floor(x - 0.5)::BIGINT + dc AS col, floor(y - 0.5)::BIGINT + dr AS row, x - 0.5 AS u, y - 0.5 AS v FROM t, range(2) p(dc), range(2) q(dr)),
w AS (SELECT *, (1 - abs(u - col)) * (1 - abs(v - row)) AS w FROM f)
SELECT t.trow, t.tcol, round(sum(w * other) / sum(w), 6) AS value FROM t LEFT JOIN (SELECT w.*, other FROM w JOIN raster USING (row, col) WHERE w > 0 AND other IS NOT NULL) z USING (trow, tcol) GROUP BY ALL""")
def align_raster_pair(spark, d):
    b = band(spark, d, "other")
    rows, cols = (math.ceil(n / 1.7) for n in r.extent(b))
    cells = spark.range(rows * cols).selectExpr(f"id div {cols} AS trow", f"id % {cols} AS tcol")
    t = cells.selectExpr("trow", "tcol", "(tcol + 0.5D) * 1.7D AS x", "(trow + 0.5D) * 1.7D AS y")
    return r.bilinear(b, t, 0.0, 0.0, 1.0).select("trow", "tcol", F.round("value", 6).alias("value"))


@query("mosaic", cte("raster") + " SELECT row, col, coalesce(b1, b2) AS value FROM raster")
def mosaic(spark, d):
    return r.mosaic(band(spark, d).withColumn("priority", F.lit(0)).union(band(spark, d, "b2").withColumn("priority", F.lit(1))))


@query("sample_raster_at_points", cte("raster", "points") + " SELECT pid, other AS value FROM points LEFT JOIN raster ON col = floor(x / 10) AND row = floor(y / 10)")
def sample_raster_at_points(spark, d):
    return r.sample_at_points(band(spark, d, "other"), layer(spark, d, "points"), 0.0, 0.0, 10.0).select("pid", "value")


@query("zonal_statistics", cte("raster", "zones") + """ SELECT zid, count(*) AS n, min(b1) AS min, max(b1) AS max, round(avg(b1), 6) AS mean
FROM raster JOIN zones ON col >= x0 / 10 AND col < x1 / 10 AND row >= y0 / 10 AND row < y1 / 10 WHERE b1 IS NOT NULL GROUP BY zid""")
def zonal_statistics(spark, d):
    z = r.zonal_statistics(band(spark, d), layer(spark, d, "zones"), "zid", 10.0)
    return z.select("zid", "n", "min", "max", F.round("mean", 6).alias("mean"))


@query("difference_map", cte("raster") + """, x AS (SELECT row, col, abs(b1 - other) AS d FROM raster WHERE b1 IS NOT NULL AND other IS NOT NULL), t AS (SELECT max(d) AS top FROM x)
SELECT row, col, round(d / top, 8) AS share, least(floor(d / top * 4), 3)::INT AS band FROM x, t""")
def difference_map(spark, d):
    return r.difference_map(band(spark, d), band(spark, d, "other")).select("row", "col", F.round("share", 8).alias("share"), "band")


@query("percentile_stretch", cte("raster") + """, e AS (SELECT quantile_cont(other, 0.02) AS lo, quantile_cont(other, 0.98) AS hi FROM raster)
SELECT row, col, round(greatest(least((other - lo) / (hi - lo), 1), 0) * 255, 4) AS value FROM raster, e""")
def percentile_stretch(spark, d):
    return r.percentile_stretch(band(spark, d, "other")).select("row", "col", F.round("value", 4).alias("value"))


@query("spectral_threshold", cte("raster") + """, c AS (SELECT row, col, (b2 % 256) AS rr, (floor(other)::BIGINT % 256)::DOUBLE AS gg, ((row * 7 + col) % 256)::DOUBLE AS bb FROM raster),
h AS (SELECT *, greatest(rr, gg, bb) AS hi, greatest(rr, gg, bb) - least(rr, gg, bb) AS dd FROM c),
k AS (SELECT *, CASE WHEN dd = 0 THEN 0 WHEN hi = rr THEN 60 * (gg - bb) / dd WHEN hi = gg THEN 120 + 60 * (bb - rr) / dd ELSE 240 + 60 * (rr - gg) / dd END AS hue FROM h)
SELECT row, col, round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2, 4) AS h, round(CASE WHEN hi = 0 THEN 0 ELSE 255 * dd / hi END, 4) AS s, hi AS v FROM k""")
def spectral_threshold(spark, d):
    c = layer(spark, d, "raster").selectExpr("row", "col", "b2 % 256 AS r", "cast(floor(other) % 256 AS double) AS g", "cast((row * 7 + col) % 256 AS double) AS b")
    h, s, v = r.spectral_class(F.col("r"), F.col("g"), F.col("b"))
    return c.select("row", "col", F.round(h, 4).alias("h"), F.round(s, 4).alias("s"), v.alias("v"))


@query("vegetation_classes", ORACLES["spectral_threshold"].rsplit("SELECT row, col", 1)[0] + """, m AS (SELECT row, col, CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2 AS h, CASE WHEN hi = 0 THEN 0 ELSE 255 * dd / hi END AS s, hi AS v FROM k),
f AS (SELECT *, h BETWEEN 35 AND 85 AND s >= 40 AND v >= 40 AS forest FROM m)
SELECT row, col, forest, NOT forest AND h BETWEEN 25 AND 75 AND s BETWEEN 20 AND 120 AND v BETWEEN 60 AND 200 AS grass FROM f""")
def vegetation_classes(spark, d):
    c = layer(spark, d, "raster").selectExpr("row", "col", "b2 % 256 AS r", "cast(floor(other) % 256 AS double) AS g", "cast((row * 7 + col) % 256 AS double) AS b")
    forest, grass = r.vegetation(*r.spectral_class(F.col("r"), F.col("g"), F.col("b")))
    return c.select("row", "col", forest.alias("forest"), grass.alias("grass"))


LONLAT = "SELECT fid, x0 / 10 - 50 AS x0, y0 / 20 - 20 AS y0, x1 / 10 - 50 AS x1, y1 / 20 - 20 AS y1"
TILE_X = "greatest(least(floor(({lon} + 180) / 360 * 4096), 4095), 0)::BIGINT"
TILE_Y = "greatest(least(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 4096), 4095), 0)::BIGINT"


def lonlat_boxes(spark, d):
    return layer(spark, d, "boxes").selectExpr("fid", "x0 / 10 - 50 AS x0", "y0 / 20 - 20 AS y0", "x1 / 10 - 50 AS x1", "y1 / 20 - 20 AS y1")


@query("tiles_of_boxes", cte("boxes") + f", b AS ({LONLAT} FROM boxes), t AS (SELECT fid, {TILE_Y.format(lat='y1')} AS t, {TILE_Y.format(lat='y0')} AS b, unnest(range({TILE_X.format(lon='x0')}, {TILE_X.format(lon='x1')} + 1)) AS x FROM b) SELECT fid, x, unnest(range(t, b + 1)) AS y FROM t")
def tiles_of_boxes(spark, d):
    return r.tiles_of_boxes(lonlat_boxes(spark, d), "fid", 12)


@query("tile_bounds", cte("boxes") + """, t AS (SELECT fid, fid * 7 % 4096 AS x, fid * 13 % 4096 AS y FROM boxes)
SELECT fid, round(x / 4096 * 360 - 180, 9) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 4096)))), 9) AS south, round((x + 1) / 4096 * 360 - 180, 9) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 4096)))), 9) AS north FROM t""")
def tile_bounds(spark, d):
    sides = r.tile_bounds(12, F.col("fid") * 7 % 4096, F.col("fid") * 13 % 4096)
    return layer(spark, d, "boxes").select("fid", *[F.round(s, 9).alias(n) for s, n in zip(sides, ("west", "south", "east", "north"))])


@query("max_zoom", cte("boxes") + " SELECT fid, CASE WHEN (x1 - x0) / 2e7 * 111000 >= 40075016.686::DOUBLE / (256 * 4194304) THEN 20 ELSE 14 END AS zoom FROM boxes")
def max_zoom(spark, d):
    return layer(spark, d, "boxes").select("fid", r.max_zoom((F.col("x1") - F.col("x0")) / 2e7).alias("zoom"))


NEAR = "EXISTS (SELECT 1 FROM mask n WHERE n.v = {v} AND n.row BETWEEN m.row - {k} AND m.row + {k} AND n.col BETWEEN m.col - {k} AND m.col + {k} AND (n.row - m.row) ** 2 + (n.col - m.col) ** 2 <= {k} * {k})"
query("dilate", cte("mask") + f" SELECT row, col, CASE WHEN v = 1 OR {NEAR.format(v=1, k=2)} THEN 1 ELSE 0 END AS v FROM mask m")(lambda spark, d: r.dilate(mask(spark, d), 2))
query("erode", cte("mask") + f" SELECT row, col, CASE WHEN v = 0 OR {NEAR.format(v=0, k=1)} THEN 0 ELSE 1 END AS v FROM mask m")(lambda spark, d: r.erode(mask(spark, d), 1))
query("mask_union", cte("mask") + " SELECT row, col, greatest(v, w) AS v FROM mask")(lambda spark, d: r.mask_union(mask(spark, d), mask(spark, d, "w")))


@query("boundary_f1", cte("mask") + """, b AS (SELECT row, col, 'v' AS k FROM mask m WHERE v = 1 AND EXISTS (SELECT 1 FROM mask n WHERE n.v = 0 AND abs(n.row - m.row) <= 1 AND abs(n.col - m.col) <= 1)
  UNION ALL SELECT row, col, 'w' FROM mask m WHERE w = 1 AND EXISTS (SELECT 1 FROM mask n WHERE n.w = 0 AND abs(n.row - m.row) <= 1 AND abs(n.col - m.col) <= 1)),
h AS (SELECT k, avg(EXISTS (SELECT 1 FROM b o WHERE o.k <> b.k AND o.row BETWEEN b.row - 2 AND b.row + 2 AND o.col BETWEEN b.col - 2 AND b.col + 2 AND abs(o.row - b.row) + abs(o.col - b.col) <= 2)::INT) AS s FROM b GROUP BY k),
p AS (SELECT coalesce(max(s) FILTER (WHERE k = 'w'), 0) AS p, coalesce(max(s) FILTER (WHERE k = 'v'), 0) AS q FROM h)
SELECT round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1 FROM p""")
def boundary_f1(spark, d):
    return r.boundary_f1(mask(spark, d), mask(spark, d, "w")).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("mean_boundary_f1", cte("classes") + """, t AS (SELECT row, col, truth AS c FROM classes WHERE truth < 4), p AS (SELECT row, col, pred AS c FROM classes WHERE pred < 4),
tb AS (SELECT row, col, c FROM t WHERE (SELECT count(*) FROM t o WHERE o.c = t.c AND o.row BETWEEN t.row - 1 AND t.row + 1 AND o.col BETWEEN t.col - 1 AND t.col + 1) < 9),
pb AS (SELECT row, col, c FROM p WHERE (SELECT count(*) FROM p o WHERE o.c = p.c AND o.row BETWEEN p.row - 1 AND p.row + 1 AND o.col BETWEEN p.col - 1 AND p.col + 1) < 9),
r AS (SELECT c, avg(EXISTS (SELECT 1 FROM pb o WHERE o.c = tb.c AND o.row BETWEEN tb.row - 2 AND tb.row + 2 AND abs(o.row - tb.row) + abs(o.col - tb.col) <= 2)::INT) AS r FROM tb GROUP BY c),
q AS (SELECT c, avg(EXISTS (SELECT 1 FROM tb o WHERE o.c = pb.c AND o.row BETWEEN pb.row - 2 AND pb.row + 2 AND abs(o.row - pb.row) + abs(o.col - pb.col) <= 2)::INT) AS p FROM pb GROUP BY c)
SELECT round(avg(2 * coalesce(p, 0) * r / greatest(coalesce(p, 0) + r, 1e-8)), 6) AS f1, count(*) AS classes FROM r LEFT JOIN q USING (c)""")
def mean_boundary_f1(spark, d):
    c = layer(spark, d, "classes")
    found = r.mean_boundary_f1(c.select("row", "col", F.col("truth").alias("class")), c.select("row", "col", F.col("pred").alias("class")), [0, 1, 2, 3])
    return found.select(F.round("f1", 6).alias("f1"), "classes")


@query("mosaic_on_grid", cte("raster") + """, l AS (SELECT row, col, b1 AS value, 0 AS priority FROM raster UNION ALL SELECT row + 3, col + 5, b2, 1 FROM raster)
SELECT row, col, arg_min(value, priority) AS value, 100.0::DOUBLE AS x0, 40.0::DOUBLE AS y0 FROM l WHERE value IS NOT NULL GROUP BY row, col""")
def mosaic_on_grid(spark, d):
    one = band(spark, d).withColumns({"priority": F.lit(0), "x0": F.lit(100.0), "y0": F.lit(40.0)})
    two = band(spark, d, "b2").withColumns({"priority": F.lit(1), "x0": F.lit(110.2), "y0": F.lit(45.9)})
    return r.mosaic_on_grid(one.unionByName(two), 2.0)


def headers(spark, d):
    """The raster's own extent, and two parts of it."""
    full = layer(spark, d, "raster").agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    parts = "array(struct(0 AS raster_id, height, width), struct(1 AS raster_id, int(floor(height * 0.64)) AS height, 90 AS width), struct(2 AS raster_id, 15 AS height, 40 AS width))"
    return full.select(F.explode(F.expr(parts)).alias("h")).select("h.*")


OWN = cte("raster") + ", f AS (SELECT max(row)::INT + 1 AS height, max(col)::INT + 1 AS width FROM raster), h AS (SELECT 0 AS raster_id, height, width FROM f UNION ALL SELECT 1, floor(height * 0.64)::INT, 90 FROM f UNION ALL SELECT 2, 15, 40)"


def _starts(scheme: str, n: str) -> str:
    return {
        "full": f"CASE WHEN {n} >= 20 THEN range(0, {n} - 19, 16) ELSE [] END",
        "last": f"list_distinct(list_append(range(0, greatest({n} - 20, 0) + 1, 16), greatest({n} - 20, 0)::BIGINT))",
        "clamp": f"list_transform(range(0, {n}, 16), lambda s: least(s, greatest({n} - 20, 0)))",
        "ragged": f"range(0, {n}, 16)",
        "fit": f"range(0, greatest({n} - 20, 0) + 1, 16)",
    }[scheme]


def _windows(scheme: str) -> None:
    oracle = OWN + f""", a AS (SELECT raster_id, height AS h, width AS w, unnest({_starts(scheme, 'height')})::INT AS row0 FROM h), b AS (SELECT *, unnest({_starts(scheme, 'w')})::INT AS col0 FROM a)
SELECT raster_id, row0, col0, least(20, h - row0) AS height, least(20, w - col0) AS width FROM b"""
    query(f"sliding_windows_{scheme}", oracle)(lambda spark, d: r.sliding_windows(headers(spark, d), 20, 16, scheme))


for _scheme in ("full", "last", "clamp", "ragged", "fit"):
    _windows(_scheme)


#: Window numbers up to the one that reaches the last row or column.
WIN = cte("raster", "mask") + """, last AS (SELECT ceil(greatest(max(row) - 19, 0) / 16)::BIGINT AS r, ceil(greatest(max(col) - 19, 0) / 16)::BIGINT AS c FROM mask),
p AS (SELECT row, col, v AS value, row * 100 + col AS e, a.w AS w_row, b.w AS w_col FROM mask, last, LATERAL (SELECT unnest(range(greatest(ceil((row - 19) / 16), 0)::BIGINT, least(row // 16, r) + 1)) AS w) a,
  LATERAL (SELECT unnest(range(greatest(ceil((col - 19) / 16), 0)::BIGINT, least(col // 16, c) + 1)) AS w) b)"""


@query("cut_samples", WIN + " SELECT w_row, w_col, sum(value)::BIGINT AS total FROM p GROUP BY ALL HAVING sum(value) >= 120 ORDER BY w_row, w_col LIMIT 25")
def cut_samples(spark, d):
    m = mask(spark, d).withColumnRenamed("v", "value")
    return r.cut_samples(m, 20, 16, *r.extent(m), 120, 25)


@query("tiles_with_data", WIN.replace("mask", "mask") + " SELECT w_row, w_col, count(*) AS cells FROM p GROUP BY ALL HAVING max(value) <> 0 ORDER BY w_row, w_col LIMIT 40")
def tiles_with_data(spark, d):
    m = mask(spark, d).withColumnRenamed("v", "value")
    return r.tiles_with_data(m, 20, 16, *r.extent(m), 40)


def probabilities(spark, d):
    m = mask(spark, d)
    cells = r.window_cells(m, 20, 16, *r.extent(m)).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(3))))
    prob = ((F.col("row") * 100 + F.col("col")) * 31 + F.col("class") * 17 + F.col("w_row") * 7 + F.col("w_col") * 3) % 100 / F.lit(100.0)
    return cells.select("w_row", "w_col", "row", "col", "class", prob.alias("prob"))


PROB = WIN + ", q AS (SELECT row, col, c AS class, ((e * 31 + c * 17 + w_row * 7 + w_col * 3) % 100) / 100.0::DOUBLE AS prob, w_row, w_col FROM p, range(4) k(c))"


@query("blend_windows", PROB + " SELECT row, col, class::INT AS class, round(avg(prob), 6) AS prob FROM q GROUP BY ALL")
def blend_windows(spark, d):
    return r.blend_windows(probabilities(spark, d)).select("row", "col", "class", F.round("prob", 6).alias("prob"))


@query("argmax_class", PROB + ", m AS (SELECT row, col, class, round(avg(prob), 6) AS p FROM q GROUP BY ALL) SELECT row, col, arg_max(class, (p, -class))::INT AS class FROM m GROUP BY ALL")
def argmax_class(spark, d):
    blended = r.blend_windows(probabilities(spark, d)).withColumn("prob", F.round("prob", 6))
    return r.argmax_class(blended)


@query("tile_pyramid", cte("points") + """, t AS (SELECT z, 108.0::DOUBLE + x / 1000 AS lon, 34.0::DOUBLE + y / 1000 AS lat FROM points, range(10, 14) k(z))
SELECT z::INT AS z, floor((lon + 180) / 360 * (1 << z::INT))::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (1 << z::INT))::BIGINT AS y, count(*) AS n FROM t GROUP BY ALL""")
def tile_pyramid(spark, d):
    p, out = layer(spark, d, "points").selectExpr("108.0D + x / 1000 AS lon", "34.0D + y / 1000 AS lat"), None
    for z in range(10, 14):
        x, y = r.tile_of(F.col("lon"), F.col("lat"), z)
        part = p.select(F.lit(z).alias("z"), x.alias("x"), y.alias("y"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query("clip_raster", cte("raster", "zones") + " SELECT row, col, other AS value FROM raster WHERE EXISTS (SELECT 1 FROM zones WHERE n_regionkey = 1 AND col >= x0 / 10 AND col < x1 / 10 AND row >= y0 / 10 AND row < y1 / 10)")
def clip_raster(spark, d):
    covered = rasterize(layer(spark, d, "zones").where("n_regionkey = 1"), 10.0).select("row", "col")
    return band(spark, d, "other").join(covered, ["row", "col"], "left_semi")


#: Smallest label around, as often as the widest region asks for: a recursive walk over the small grid.
LABELS = cte("mask") + """, cells AS (SELECT row, col, v, (row << 31) + col AS id FROM mask),
e AS (SELECT a.id AS a, b.id AS b FROM cells a JOIN cells b ON a.v = b.v AND ((a.row = b.row AND abs(a.col - b.col) = 1) OR (a.col = b.col AND abs(a.row - b.row) = 1))),
labels AS (WITH RECURSIVE t(id, root) USING KEY (id) AS (SELECT id, id FROM cells UNION SELECT e.a, min(t.root) FROM t JOIN e ON e.b = t.id JOIN recurring.t AS r ON r.id = e.a WHERE t.root < r.root GROUP BY e.a) SELECT * FROM t)"""


@query("label_regions", LABELS + " SELECT row, col, v, root AS label FROM cells JOIN labels USING (id)")
def label_regions(spark, d):
    return regions.label_regions(mask(spark, d), tile=32)


@query("vectorize_regions", LABELS + " SELECT root AS label, v, count(*) AS n, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM cells JOIN labels USING (id) GROUP BY ALL")
def vectorize_regions(spark, d):
    return regions.region_table(regions.label_regions(mask(spark, d), tile=32))


@query("keep_largest", LABELS + ", s AS (SELECT root, count(*) AS n FROM cells JOIN labels USING (id) WHERE v = 1 GROUP BY root), k AS (SELECT arg_max(root, (n, -root)) AS best FROM s) SELECT row, col, CASE WHEN root = best THEN v ELSE 0 END AS v FROM cells JOIN labels USING (id), k")
def keep_largest(spark, d):
    return regions.keep_largest(mask(spark, d))


@query("fill_mask_holes", LABELS + ", o AS (SELECT DISTINCT root FROM cells JOIN labels USING (id) WHERE row IN (0, (SELECT max(row) FROM cells)) OR col IN (0, (SELECT max(col) FROM cells))) SELECT row, col, CASE WHEN v = 1 THEN 1 WHEN root IN (SELECT root FROM o) THEN 0 ELSE 1 END AS v FROM cells JOIN labels USING (id)")
def fill_mask_holes(spark, d):
    m = mask(spark, d)
    return regions.fill_mask_holes(m, *r.extent(m))


@query("object_stats", LABELS + ", s AS (SELECT root, count(*) AS n FROM cells JOIN labels USING (id) WHERE v = 1 GROUP BY root) SELECT count(*) AS regions, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean, (SELECT round(avg(v), 6) FROM mask) AS coverage FROM s")
def object_stats(spark, d):
    return regions.object_stats(mask(spark, d)).select("regions", "smallest", "largest", F.round("mean", 6).alias("mean"), F.round("coverage", 6).alias("coverage"))


#: Regions that also meet at corners.
LABELS8 = LABELS.replace("((a.row = b.row AND abs(a.col - b.col) = 1) OR (a.col = b.col AND abs(a.row - b.row) = 1))", "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id")
query("remove_small", LABELS8 + ", s AS (SELECT root, count(*) AS n FROM cells JOIN labels USING (id) WHERE v = 1 GROUP BY root) SELECT row, col, CASE WHEN n < 5 OR n > 500 THEN 0 ELSE v END AS v FROM cells JOIN labels USING (id) LEFT JOIN s USING (root)")(lambda spark, d: regions.filter_regions(mask(spark, d), 5, 500))
ERODED = "SELECT row, col, CASE WHEN v = 0 OR " + NEAR.format(v=0, k=1) + " THEN 0 ELSE 1 END AS v FROM mask m"
DILATED = "SELECT row, col, CASE WHEN v = 1 OR " + NEAR.format(v=1, k=1) + " THEN 1 ELSE 0 END AS v FROM mask m"
query("open_mask", cte("mask") + f", first AS ({ERODED}) " + DILATED.replace("FROM mask", "FROM first"))(lambda spark, d: r.open_mask(mask(spark, d), 1))
query("close_mask", cte("mask") + f", first AS ({DILATED}) " + ERODED.replace("FROM mask", "FROM first"))(lambda spark, d: r.close_mask(mask(spark, d), 1))
MIRROR = "s.{a} = CASE WHEN m.{a} + k < 0 THEN -(m.{a} + k) - 1 WHEN m.{a} + k >= e.{n} THEN 2 * e.{n} - 1 - (m.{a} + k) ELSE m.{a} + k END"
query("gaussian_smooth", cte("mask") + f""", e AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM mask), t AS (SELECT k, exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) ** 2) AS g FROM range(-6, 7) x(k)),
n AS (SELECT k, g / (SELECT sum(g) FROM t) AS g FROM t),
a AS (SELECT m.row, m.col, sum(g * s.v) AS v FROM mask m CROSS JOIN n CROSS JOIN e JOIN mask s ON s.col = m.col AND {MIRROR.format(a="row", n="h")} GROUP BY m.row, m.col),
b AS (SELECT m.row, m.col, sum(g * s.v) AS v FROM mask m CROSS JOIN n CROSS JOIN e JOIN a s ON s.row = m.row AND {MIRROR.format(a="col", n="w")} GROUP BY m.row, m.col)
SELECT row, col, CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS v FROM b""")(lambda spark, d: r.gaussian_smooth(m := mask(spark, d), 1.5, 0.5, *r.extent(m)))
query("mask_pipeline")(lambda spark, d: regions.mask_pipeline(m := mask(spark, d), *r.extent(m)))


@query("raster_profile", cte("raster") + LONG + " SELECT band, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, (SELECT max(row) + 1 FROM raster) AS height, (SELECT max(col) + 1 FROM raster) AS width FROM long GROUP BY band")
def raster_profile(spark, d):
    p = r.raster_profile(bands(spark, d))
    return p.select("band", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "height", "width")


@query("window_read", cte("raster") + " SELECT row, col, other AS value FROM raster WHERE (col + 0.5) * 0.01 >= 0.2 AND (col + 0.5) * 0.01 < 0.41 AND (row + 0.5) * 0.01 >= 0.1 AND (row + 0.5) * 0.01 < 0.33")
def window_read(spark, d):
    return r.window_read(band(spark, d, "other"), (108.2, 34.1, 108.41, 34.33), 108.0, 34.0, 0.01)


@query("blend_windows_hann", PROB + """, h AS (SELECT *, greatest((0.5 - 0.5 * cos(2 * pi() * (row - w_row * 16) / 19)) * (0.5 - 0.5 * cos(2 * pi() * (col - w_col * 16) / 19)), 0.05) AS w FROM q)
SELECT row, col, class::INT AS class, round(sum(prob * w) / sum(w), 6) AS prob FROM h GROUP BY ALL""")
def blend_windows_hann(spark, d):
    p = probabilities(spark, d).withColumns({"i": F.col("row") - F.col("w_row") * 16, "j": F.col("col") - F.col("w_col") * 16})
    return r.blend_windows(p, r.hann_weight(20)).select("row", "col", "class", F.round("prob", 6).alias("prob"))


@query("reproject_raster", cte("raster") + """, n AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM raster), e AS (SELECT 108.0::DOUBLE * 20037508.342789244 / 180 AS ax, ln(tan((90 + 34.0::DOUBLE) * pi() / 360)) * 20037508.342789244 / pi() AS ay,
  (108.0::DOUBLE + w * 0.01::DOUBLE) * 20037508.342789244 / 180 AS bx, ln(tan((90 + 34.0::DOUBLE + h * 0.01::DOUBLE) * pi() / 360)) * 20037508.342789244 / pi() AS "by" FROM n),
t AS (SELECT i AS row, j AS col, (ax + (j + 0.5) * 2500) * 180 / 20037508.342789244 AS lon, degrees(2 * atan(exp((ay + (i + 0.5) * 2500) * pi() / 20037508.342789244)) - pi() / 2) AS lat
  FROM e, (SELECT unnest(range(ceil(("by" - ay) / 2500)::BIGINT)) AS i FROM e), (SELECT unnest(range(ceil((bx - ax) / 2500)::BIGINT)) AS j FROM e))
SELECT t.row, t.col, other AS value FROM t LEFT JOIN raster s ON s.col = floor((lon - 108) / 0.01) AND s.row = floor((lat - 34) / 0.01)""")
def reproject_raster(spark, d):
    b = band(spark, d, "other")
    return r.reproject_raster(b, 108.0, 34.0, 0.01, *r.extent(b), 2500.0)


_BILINEAR = """, n AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM raster), e AS (SELECT 108.0::DOUBLE * 20037508.342789244 / 180 AS ax, ln(tan((90 + 34.0::DOUBLE) * pi() / 360)) * 20037508.342789244 / pi() AS ay,
  (108.0::DOUBLE + w * 0.01::DOUBLE) * 20037508.342789244 / 180 AS bx, ln(tan((90 + 34.0::DOUBLE + h * 0.01::DOUBLE) * pi() / 360)) * 20037508.342789244 / pi() AS top FROM n),
t AS (SELECT i AS row, j AS col, ((ax + (j + 0.5) * 2500) * 180 / 20037508.342789244 - 108) / 0.01 AS u, (degrees(2 * atan(exp((ay + (i + 0.5) * 2500) * pi() / 20037508.342789244)) - pi() / 2) - 34) / 0.01 AS v
  FROM e, (SELECT unnest(range(ceil((top - ay) / 2500)::BIGINT)) AS i FROM e), (SELECT unnest(range(ceil((bx - ax) / 2500)::BIGINT)) AS j FROM e)),
f AS (SELECT t.*, floor(u - 0.5)::BIGINT + a.d AS c, floor(v - 0.5)::BIGINT + b.d AS r FROM t, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d), n WHERE u >= 0 AND u < w AND v >= 0 AND v < h),
g AS (SELECT f.row, f.col, (1 - abs(u - 0.5 - c)) * (1 - abs(v - 0.5 - r)) AS weight, s.b1 AS value FROM f JOIN raster s ON s.row = r AND s.col = c WHERE s.b1 IS NOT NULL)"""


@query("reproject_raster_bilinear", cte("raster") + _BILINEAR + " SELECT t.row, t.col, round(any_value(m.value), 4) AS value FROM t LEFT JOIN (SELECT row, col, sum(weight * value) / sum(weight) AS value FROM g WHERE weight > 0 GROUP BY ALL) m USING (row, col) GROUP BY ALL")
def reproject_raster_bilinear(spark, d):
    b = band(spark, d)
    return r.reproject_raster(b, 108.0, 34.0, 0.01, *r.extent(b), 2500.0, "bilinear").withColumn("value", F.round("value", 4))


@query("boundary_distance", cte("mask") + """, b AS (SELECT row, col, 'v' AS k FROM mask m WHERE v = 1 AND EXISTS (SELECT 1 FROM mask n WHERE n.v = 0 AND abs(n.row - m.row) + abs(n.col - m.col) = 1)
  UNION ALL SELECT row, col, 'w' FROM mask m WHERE w = 1 AND EXISTS (SELECT 1 FROM mask n WHERE n.w = 0 AND abs(n.row - m.row) + abs(n.col - m.col) = 1)),
m AS (SELECT a.k, a.row, a.col, min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) AS d FROM b a JOIN b ON a.k <> b.k GROUP BY ALL), s AS (SELECT avg(d) FILTER (WHERE k = 'v') AS p, avg(d) FILTER (WHERE k = 'w') AS q FROM m)
SELECT round(p, 6) AS to_pred, round(q, 6) AS to_truth, round(greatest(p, q), 6) AS hausdorff, round((p + q) / 2, 6) AS mean FROM s""")
def boundary_distance(spark, d):
    return r.boundary_distance(mask(spark, d), mask(spark, d, "w")).select(*[F.round(c, 6).alias(c) for c in ("to_pred", "to_truth", "hausdorff", "mean")])
