"""Outlines in longitude and latitude, there and back; classes that are squared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.functions import shapes
from fieldloom.functions.polygons import PARTS
from fieldloom.operators import quality as q


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


@pytest.mark.parametrize("zone, south, lon, lat", [(49, False, 108.9, 34.2), (1, False, -179.9, 0.1), (33, True, 15.3, -62.0), (31, False, 5.9, 71.0)])
def test_projection_there_and_back(spark, zone, south, lon, lat):
    rng = np.random.default_rng(3)
    points = [(lon + dx, lat + dy) for dx, dy in rng.uniform(-0.05, 0.05, (50, 2))]
    df = spark.createDataFrame([(ring(points),), (None,), ([],)], f"r {shapes.RING}")
    there = df.select("r", shapes.into_utm(F.col("r"), zone, south).alias("u"), F.transform("r", lambda p: g.point(*g.to_utm(p["x"], p["y"], F.lit(zone)))).alias("c"))
    first = there.first()
    assert np.abs(np.array([(p.x, p.y) for p in first.u]) - np.array([(p.x, p.y) for p in first.c])).max() < 1e-6
    rows = there.select("r", shapes.from_utm(F.col("u"), zone, south).alias("b")).collect()
    assert np.abs(np.array([(p.x, p.y) for p in rows[0].b]) - np.array(points)).max() < 1e-8
    assert rows[1].b is None and rows[2].b == []


def test_outlines_are_regularised_in_metres(spark):
    zone = 49
    turn = np.radians(4)
    square = np.array([(0, 0), (20, 0), (20, 10), (0, 10), (0, 0)]) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    metres = {1: square + (300_000, 3_780_000), 2: square / 10 + (300_100, 3_780_000), 3: np.array([(0, 0), (20, 0), (20.1, 5), (20, 10), (0, 10), (0, 0)]) + (300_200, 3_780_000), 4: np.array([(0, 0), (9, 9), (9, 0), (0, 9), (0, 0)]) + (300_300, 3_780_000)}
    rows = [(k, ring(zip(*shapes.lonlat_of_utm(*m.T, zone, False)))) for k, m in metres.items()] + [(9, None), (10, [])]
    result, record = q.regularize_lonlat(spark.createDataFrame(rows, f"fid int, ring {shapes.RING}"))
    got = {r.fid: r for r in result.collect()}
    assert set(got) == {1, 3, 4}  # 2 is too small, 4 could be untied
    assert got[1].area == pytest.approx(200 * np.cos(turn) ** 2, rel=1e-3) and got[3].area == pytest.approx(200, rel=1e-3) and got[4].area == pytest.approx(81, rel=1e-3)
    assert got[1].direction == pytest.approx(4, abs=1e-3)
    back = spark.createDataFrame([(r.fid, r.ring) for r in got.values()], f"fid int, ring {shapes.RING}")
    for r in back.select("fid", shapes.into_utm(F.col("ring"), zone).alias("u")).collect():
        along = np.diff(np.array([(p.x, p.y) for p in r.u]), axis=0)
        assert np.abs(along).min(axis=1).max() < 0.02 and len(along) == 4  # every edge follows an axis
    steps = {(r.step, r.name): r.n for r in record.groupBy("step", "name").agg(F.count("*").alias("n")).collect()}
    assert steps == {(0, "fixed"): 4, (1, "area"): 3, (2, "simplified"): 3, (3, "snapped"): 3, (4, "final"): 3}
    first = record.where("step = 0 and fid = 1").first().ring
    assert [(p.x, p.y) for p in first] == [pytest.approx((p["x"], p["y"]), abs=1e-8) for p in rows[0][1]]


def test_only_buildings_are_squared(spark):
    points = ring([(0, 0), (10, 1), (9, 8), (-1, 9), (0, 0)])
    df = spark.createDataFrame([(1, "building", points), (2, "road", points)], f"fid int, class string, ring {shapes.RING}")
    got = {r.fid: r for r in q.postprocess_layer(df, tolerance=0.01, smooth=0, kind="class").collect()}
    assert got[2].ring[1].x == 10 and got[1].ring[1].x == pytest.approx(9.9884, abs=1e-4) and got[1]["class"] == "building"


def test_repair_by_clip_keeps_what_larger_features_leave(spark):
    box = lambda x0, y0, x1, y1: [{"shell": ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]), "holes": []}]
    rows = [(1, box(0, 0, 10, 10)), (2, box(5, 5, 12, 12)), (3, box(2, 2, 4, 4)), (4, box(30, 30, 34, 34))]
    layer = spark.createDataFrame([(i, *p[0]["shell"][0].values(), *p[0]["shell"][2].values(), p) for i, p in rows], f"fid long, x0 double, y0 double, x1 double, y1 double, parts {PARTS}")
    fixed, log, bad = q.repair_layer(layer, 5.0, sliver=3.0, overlaps="clip")
    areas = {r.fid: r.area for r in fixed.groupBy("fid").agg(F.sum(g.area(F.col("ring"))).alias("area")).collect()}
    assert areas == {1: 100, 2: 24, 3: 4, 4: 16} and bad.count() == 0
    assert [r.features for r in log.orderBy("step").collect()][2] == 4
    with pytest.raises(ValueError):
        q.repair_layer(layer, 5.0, overlaps="other")


def test_flagged_features_are_listed_once(spark):
    box = lambda x0, y0, x1, y1: [{"shell": ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]), "holes": []}]
    layer = spark.createDataFrame([(1, box(0, 0, 10, 10)), (2, box(2, 2, 4, 4)), (3, box(30, 30, 31, 31))], f"fid long, parts {PARTS}")
    lines = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 2.0), (8, 0.0, 2.0, 2.0, 0.0), (9, 5.0, 5.0, 6.0, 6.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    rows, flagged = q.topology_report(layer, 5.0, lines)
    assert sorted((r.rule, r.id_1, r.id_2, r.measure) for r in rows.collect()) == [("contains", 1, 2, 0.04), ("cross", 7, 8, None), ("overlap", 1, 2, 4.0)]
    assert sorted(map(tuple, flagged.collect())) == [("areas", 1), ("areas", 2), ("lines", 7), ("lines", 8)]
