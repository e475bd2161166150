"""Relations, clips, splits, resampling and search on small hand-made inputs."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.operators import catalog, evaluate, raster, vector
from fieldloom.streaming import detections


def boxes(spark, rows):
    return spark.createDataFrame(rows, "fid long, x0 double, y0 double, x1 double, y1 double")


def test_relations_to_a_union_that_overlaps_itself(spark):
    by = boxes(spark, [(1, 0.0, 0.0, 6.0, 4.0), (2, 4.0, 0.0, 10.0, 4.0)])
    target = boxes(
        spark,
        [(1, 1.0, 1.0, 9.0, 3.0), (2, 3.0, 1.0, 7.0, 5.0), (3, 10.0, 0.0, 12.0, 4.0), (4, -1.0, -1.0, 11.0, 5.0), (5, 20.0, 0.0, 21.0, 1.0), (6, 4.5, 1.0, 5.5, 5.0)],
    )
    want = {"intersects": {1, 2, 3, 4, 6}, "within": {1}, "touches": {3}, "overlaps": {2, 6}, "contains": {4}, "crosses": set(), "unheard of": {1, 2, 3, 4, 6}}
    for relation, ids in want.items():
        assert {r["fid"] for r in vector.select_by_location(target, by, relation, "fid", 3.0).collect()} == ids, relation
    nothing = by.where("false")
    for relation in want:
        assert vector.select_by_location(target, nothing, relation, "fid", 3.0).count() == 0
    assert {(r["a_fid"], r["b_fid"]) for r in vector.box_join(target, by, 3.0, "contains").collect()} == {(4, 1), (4, 2)}
    assert {(r["a_fid"], r["b_fid"]) for r in vector.box_join(by, target, 3.0, "within").collect()} == {(1, 4), (2, 4)}


def test_attributes_fall_back_to_text(spark):
    df = spark.createDataFrame([("1",), ("9",), ("10",), (None,)], "a string")
    assert [r["a"] for r in vector.select_by_attribute(df, "a", ">", 5).orderBy("a").collect()] == ["10", "9"]
    assert [r["a"] for r in vector.select_by_attribute(df, "a", ">", "abc").collect()] == []
    assert [r["a"] for r in vector.select_by_attribute(df.union(spark.createDataFrame([("x",)], "a string")), "a", ">", 5).orderBy("a").collect()] == ["9", "x"]


@pytest.mark.parametrize("step", [0.5, 2.0, 4.0, 11.0, 25.0])
def test_clips_at_any_frame_rate(spark, step):
    start = datetime.datetime(2024, 1, 1)
    frames = [f for f in range(80) if f not in (30, 31, 55)]
    rows = [("a", f, start + datetime.timedelta(seconds=step * f)) for f in frames] * 2
    got = sorted((r["first"], r["last"], r["frames"]) for r in detections.event_clips(spark.createDataFrame(rows, "camera string, frame long, ts timestamp")).collect())
    want, clip, last = [], [], None
    for f in frames:
        if clip and f != last + 1:
            want.append((clip[0], clip[-1], len(clip)))
            clip = []
        clip.append(f)
        if step * (f - clip[0]) > 10:
            want.append((clip[0], clip[-1], len(clip)))
            clip = []
        last = f
    if clip:
        want.append((clip[0], clip[-1], len(clip)))
    assert got == want


def test_splits_follow_one_order(spark):
    df = spark.range(1000).withColumn("class", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    ranked = evaluate.hash_rank(df, "id", "class").collect()
    for c in (None, 1, 2):
        own = [r for r in ranked if r["class"] == c]
        assert sorted(r["_at"] for r in own) == list(range(1, len(own) + 1)) and {r["_n"] for r in own} == {len(own)}
    assert evaluate.split_holdout(df.where("id < 3"), "id", 0.01).where("split = 'val'").count() == 1
    assert evaluate.split_holdout(df.where("false"), "id", 0.2).count() == 0


def test_resampling_keeps_planes_and_skips_nothing(spark):
    pixels = spark.createDataFrame([(r, c, float(2 * r + 3 * c)) for r in range(12) for c in range(10)], "row long, col long, value double")
    fine = {(r["row"], r["col"]): r["value"] for r in raster.resample_scale(pixels, 2.0, 12, 10).collect()}
    assert len(fine) == 24 * 20
    assert all(fine[i, j] == pytest.approx(2 * ((i + 0.5) / 2 - 0.5) + 3 * ((j + 0.5) / 2 - 0.5)) for i in range(1, 23) for j in range(1, 19))
    coarse = {(r["row"], r["col"]): r["value"] for r in raster.resample_scale(pixels, 0.5, 12, 10).collect()}
    assert len(coarse) == 30 and coarse[2, 2] == pytest.approx(2 * 4.5 + 3 * 4.5)
    near = {(r["row"], r["col"]): r["value"] for r in raster.resample_scale(pixels, 1.7, 12, 10, "nearest").collect()}
    assert near == {(i, j): float(2 * int((i + 0.5) / 1.7) + 3 * int((j + 0.5) / 1.7)) for i in range(20) for j in range(17)}


def test_nearest_vectors_of_repeated_queries(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[0].tolist()), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = catalog.top_k_similar(df, df.where("vec_id in (3, 7)"), 4, block=1).collect()
    assert len(got) == 8
    for q in (3, 7):
        ids = [i for i, v in rows if i is not None and v]
        want = sorted((float(np.sqrt(((np.array(v) - x[q]) ** 2).sum())), i) for i, v in rows if i is not None and v)[:4]
        assert [(r["distance"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want and ids


def test_holes_crossings_and_areas(spark):
    square = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}, {"x": a, "y": a}]
    df = spark.createDataFrame([([square(0.0, 9.0), square(3.0, 6.0)],)], "rings array<array<struct<x: double, y: double>>>")
    at = lambda x, y: df.select(g.contains_with_holes(F.col("rings"), F.lit(x), F.lit(y))).first()[0]
    assert at(1.0, 1.0) and not at(4.0, 4.5) and not at(10.0, 1.0)
    lines = boxes(spark, [(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 4.0, 4.0, 0.0), (3, 5.0, 0.0, 5.0, 4.0), (4, 0.0, 0.0, -4.0, 3.0)])
    assert [tuple(r) for r in vector.line_crossings(lines, "fid", 2.0).collect()] == [(1, 2)]
    ring = spark.createDataFrame([([{"x": 8.9, "y": 0.0}, {"x": 9.1, "y": 0.0}, {"x": 9.1, "y": 0.2}, {"x": 8.9, "y": 0.2}, {"x": 8.9, "y": 0.0}],)], "ring array<struct<x: double, y: double>>")
    for mode, factor in (("mercator", 1.0), ("utm", 0.9996**2)):
        area = ring.select(g.geographic_area(F.col("ring"), "sq_km", mode)).first()[0]
        assert area == pytest.approx(factor * (0.2 * 111.32) * (0.2 * (111.32 if mode == "mercator" else 110.574)), rel=2e-3)
