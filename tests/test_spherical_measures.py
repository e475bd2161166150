"""spherical_measures gives every point its distance."""

import math

import pytest

from fieldloom.plans import registry
from fieldloom.plans.vector_queries import lonlat

SF = "/root/testdata/sf0.001"


def test_every_point_is_measured(spark):
    got = {r["pid"]: r["metres"] for r in registry.queries()["spherical_measures"](spark, SF).collect()}
    points = lonlat(spark, SF).collect()
    assert len(got) == len(points) > 100
    for p in points:
        a, b = math.radians(p["lat"]), math.radians(34.5)
        half = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(108.5 - p["lon"]) / 2) ** 2
        assert got[p["pid"]] == pytest.approx(12742017.6 * math.asin(math.sqrt(half)), rel=1e-3, abs=0.02)
