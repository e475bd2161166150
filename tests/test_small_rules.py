"""Counts from text, boundary scores by numbers, windows of small rasters, layers in other coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import shapes
from fieldloom.operators import raster as r
from fieldloom.operators import vector as v
from fieldloom.operators.regions import label_regions
from fieldloom.streaming.detections import class_counts_by_window


def cells(spark, rows):
    return spark.createDataFrame([(i, j, c) for i, row in enumerate(rows) for j, c in enumerate(row)], "row long, col long, class int")


def test_equal_classes_have_a_mean_of_one(spark):
    """Two rows of three classes against themselves."""
    t = cells(spark, [[0, 1], [1, 2]])
    assert tuple(r.mean_boundary_f1(t, t, [0, 1, 2]).first()) == (1.0, 3)
    assert tuple(r.mean_boundary_f1(t, t, [7]).first()) == (0.0, 0)


def test_boundaries_by_numbers(spark):
    t = cells(spark, [[1] * 5 for _ in range(5)])
    assert r.class_boundaries(t).count() == 16  # the raster's edge counts as another class
    p = cells(spark, [[0] * 5 for _ in range(5)])
    assert tuple(r.mean_boundary_f1(t, p, [0, 1]).first()) == (0.0, 1)
    shifted = cells(spark, [[0, 1, 1, 1, 1]] * 5)
    row = r.class_boundary_f1(t, shifted, [1], 0).first()
    assert (row.precision, row.recall) == (pytest.approx(11 / 14), pytest.approx(11 / 16))


def test_counts_from_requests(spark):
    texts = {"选 12 个 风电": 12, "0处": 1, "900 座": 500, "99999999999999999999999999999999999999999999个": 500, "no count 7": 30, None: 30, "3 个 5 个": 3}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {x.t: x.n for x in df.select("t", v.requested_count(F.col("t")).alias("n")).collect()} == texts


def test_small_rasters_have_one_window(spark):
    h = spark.createDataFrame([(1, 7, 30), (2, 20, 20)], "raster_id int, height int, width int")
    got = sorted(tuple(x) for x in r.sliding_windows(h, 20, 16, "fit").collect())
    assert got == [(1, 0, 0, 7, 20), (2, 0, 0, 20, 20)]


def test_layers_come_to_the_first_ones_coordinates(spark):
    kind = f"i int, ring {shapes.RING}"
    a = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}])], kind)
    b = spark.createDataFrame([(2, [{"x": 180.0, "y": 0.0}])], kind)
    got = {x.i: x.ring[0].x for x in v.concat_layers(a, b, crs=[3857, 4326]).collect()}
    assert got == {1: 0.0, 2: pytest.approx(20037508.342789244)}
    assert v.concat_layers(a, b.drop("ring")).count() == 2


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions_equal_a_flood_fill(spark, diagonal):
    rng = np.random.default_rng(12)
    grid = (rng.random((40, 33)) < 0.55).astype(int)
    grid[5:9, 5:20] = 1
    spiral = [(i, j) for i in range(40) for j in range(33) if (i + j) % 9 != 4]  # some cells are missing
    held = {(i, j): int(grid[i, j]) for i, j in spiral}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (diagonal or not i or not j)]
    want = {}
    for cell in sorted(held):
        if cell in want:
            continue
        want[cell], todo = cell, [cell]
        while todo:
            i, j = todo.pop()
            for near in ((i + a, j + b) for a, b in steps):
                if near not in want and held.get(near) == held[cell]:
                    want[near] = cell
                    todo.append(near)
    df = spark.createDataFrame([(i, j, v) for (i, j), v in held.items()], "row long, col long, v long")
    for tile in (7, 256):
        got = {(x.row, x.col): (x.label >> 31, x.label & (2**31 - 1)) for x in label_regions(df, diagonal, tile).collect()}
        assert got == want


def test_sliding_windows_count_a_row_in_each(spark):
    df = spark.createDataFrame([(1, "person", 30), (1, "car", 330)], "camera long, class_name string, s long").select("camera", "class_name", F.timestamp_seconds("s").alias("ts"))
    got = sorted((x.start.timestamp(), x.persons, x.vehicles, x.n) for x in class_counts_by_window(df, "10 minutes", "5 minutes").collect())
    assert got == [(-300, 1, 0, 1), (0, 1, 1, 2), (300, 0, 1, 1)]
