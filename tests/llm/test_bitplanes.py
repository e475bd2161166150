"""Bit-plane products and clusters against plain integers, and the stated results of odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import bitplane_clusters as b


def key(vec_id):
    return F.sha2(F.concat(F.lit("2:"), vec_id.cast("string")), 256)


def plain(rows, k, rounds, scale, dim):
    """[(id, cluster, distance)] and the centroids, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in first]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("dim", [1, 10, 64, 100])
def test_products_are_exact(dim):
    rng = np.random.default_rng(dim)
    for planes in (1, 2, 9, 28):
        top = 1 << (planes - 1)
        x, y = (rng.integers(-top, top, (n, dim)) for n in (50, 7))
        p, q = b.pack(x, planes), b.pack(y, planes)
        assert (b.unpack(p, dim) == x).all()
        assert (b.dots(p, q) == x @ y.T).all() and (b.norms(p) == (x * x).sum(1)).all()


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(120)]  # one vector that a third of all rows hold
    rows += [(500, None), (501, [1.0] * 5), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [math.nan] * 6), (504, [math.inf] + [0.0] * 5), (505, []), (None, [0.5] * 6), (7, rows[7][1]), (7, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, 1, "p") for i, v in rows], "vec_id long, embedding array<double>, cluster int, planes string").repartition(7)
    for k, rounds in ((8, 3), (1, 1), (1000, 1)):
        found, centroids = b.clusters(df, key, k=k, rounds=rounds, scale=16, dim=6)
        want, kept = plain(rows, k, rounds, 16, 6)
        assert sorted(map(tuple, found.collect()), key=str) == want
        assert centroids.tolist() == kept


def test_empty_tables_and_large_components(spark):
    schema = "vec_id long, embedding array<float>"
    found, centroids = b.clusters(spark.createDataFrame([(1, [1.0])], schema), key, dim=64)
    assert found.collect() == [] and len(centroids) == 0
    with pytest.raises(ValueError):
        b.clusters(spark.createDataFrame([(1, [1e30, 0.0])], schema), key, dim=2)
