"""Joins and selections built for uneven data, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import selection
from fieldloom.operators.grid import candidate_pairs, mixed_pairs
from fieldloom.operators.vector import nearest_distance


def test_percentiles_equal_the_built_in_ones(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=4000), 1: np.round(rng.normal(size=3000)), 2: np.r_[rng.normal(size=500), 1e300, -1e300, 1e-300], 3: np.array([5.0]), 4: np.r_[np.full(900, 7.0), 8.0], 5: np.exp(rng.normal(0, 60, 800)), 6: np.array([-0.0, 0.0, 1e308, -1e308])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (1, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    for bins, accuracy in ((4096, 10_000), (2, 10)):
        got = {(r.k, r.share): r.value for r in selection.percentiles(df, ["k"], "v", shares, bins, accuracy).collect()}
        assert set(got) == {(k, p) for k in groups for p in shares}
        for k, vs in groups.items():
            vs = np.sort(vs)
            for p in shares:
                at = (len(vs) - 1) * p
                lo, hi, part = vs[math.floor(at)], vs[math.ceil(at)], at - math.floor(at)
                assert got[k, p] == pytest.approx(lo * (1 - part) + hi * part, rel=1e-12)
    one = {r.share: r.value for r in selection.percentiles(df.where("k = 0"), [], "v", [0.5]).collect()}
    assert one[0.5] == pytest.approx(np.median(groups[0]))
    assert selection.percentiles(df.where("k = 9"), [], "v", [0.5]).collect() == []


def test_nearest_with_far_outliers_and_clusters(spark):
    rng = np.random.default_rng(6)
    right = np.vstack([rng.normal(0, 3, (300, 2)), rng.normal(5000, 1, (200, 2)), [[-9e5, 4e5]], [[0.0, 0.0]], [[0.0, 0.0]]])
    left = np.vstack([rng.normal(0, 3, (60, 2)), rng.uniform(-6000, 6000, (60, 2)), [[1e7, -1e7], [-9e5, 4e5], [2500, 2500], [0, 0]]])
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(left)] + [(900, None, 1.0), (901, 2.0, None)], "id int, x double, y double")
    b = spark.createDataFrame([(float(x), float(y)) for x, y in right] + [(None, 3.0)], "x double, y double")
    got = {r.id: r.distance for r in nearest_distance(a, b, "id", 2.0).collect()}
    want = np.sqrt(((left[:, None] - right[None]) ** 2).sum(-1)).min(1)
    assert [got[i] for i in range(len(left))] == pytest.approx(want.tolist(), rel=1e-9)
    assert got[900] is None and got[901] is None and len(got) == len(left) + 2
    assert {r.distance for r in nearest_distance(a, b.limit(0), "id", 2.0).collect()} == {None}


def test_mixed_sizes_meet_as_in_one_grid(spark):
    rng = np.random.default_rng(8)

    def layer(n, key):
        low, size = rng.uniform(-300, 300, (n, 2)), np.exp(rng.uniform(-2, 6, (n, 2)))
        rows = [(i, *map(float, (x, y, x + w, y + h))) for i, ((x, y), (w, h)) in enumerate(zip(low, size))] + [(n, -1000.0, -1000.0, 1000.0, 1000.0), (n + 1, 3.0, 3.0, 3.0, 3.0)]
        return spark.createDataFrame(rows, f"{key} int, x0 double, y0 double, x1 double, y1 double")

    a, b = layer(120, "i"), layer(150, "j")
    pairs = lambda df: sorted((r.a_i, r.b_j) for r in df.collect())
    want = sorted((r.i, r.j) for r in a.alias("a").join(b.alias("b"), F.expr("a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")).select("i", "j").collect())
    assert pairs(candidate_pairs(a, b, 200.0)) == want
    for cell, limit in ((5.0, 20_000), (5.0, 3), (500.0, 10)):
        assert pairs(mixed_pairs(a, b, cell, limit)) == want
    assert mixed_pairs(a, b.limit(0), 5.0).count() == 0


def test_small_boxes_do_not_meet_in_the_cells_of_large_ones(spark):
    small = spark.range(40_000).selectExpr("id", "id % 200 * 10D AS x0", "id div 200 * 10D AS y0").selectExpr("id", "x0", "y0", "x0 + 9 AS x1", "y0 + 9 AS y1")
    boxes = small.unionByName(spark.range(1).selectExpr("-1L AS id", "0D AS x0", "0D AS y0", "2000D AS x1", "2000D AS y1"))
    pairs = mixed_pairs(boxes, boxes, 10.0)  # 1.6 billion pairs in the large box's cell
    assert pairs.where("a_id < b_id").groupBy("a_id").count().collect() == [(-1, 40_000)]
    assert pairs.count() == 3 * 40_000 + 1
