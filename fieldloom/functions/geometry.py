"""Geometry as column expressions on rings: array<struct<x: double, y: double>>, closed (first = last)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = 20037508.342789244
EARTH = 6371008.8
UNITS = {"sq_m": 1.0, "sq_km": 1e-6, "ha": 1e-4}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring() -> Column:
    """The closed ring of a row's box (x0, y0, x1, y1)."""
    c = F.col
    return F.array(point(c("x0"), c("y0")), point(c("x1"), c("y0")), point(c("x1"), c("y1")), point(c("x0"), c("y1")), point(c("x0"), c("y0")))


def edges(ring: Column) -> Column:
    """Pairs of neighbouring vertices: array<struct<a, b>>."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2))


def area(ring: Column, unit: str = "sq_m") -> Column:
    """Shoelace area; unknown units count as square metres."""
    return F.abs(signed_area(ring)) * UNITS.get(unit, 1.0)


def geographic_area(ring: Column, unit: str = "sq_m", mode: str = "mercator") -> Column:
    """Area of a lon/lat ring on the web Mercator plane, or (``utm``) on that of the zone of its first vertex."""
    if mode == "mercator":
        return area(F.transform(ring, lambda p: point(*to_mercator(p["x"], p["y"]))), unit)
    zone = utm_zone(ring[0]["x"])
    return area(F.transform(ring, lambda p: point(*to_utm(p["x"], p["y"], zone))), unit)


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.sqrt((e["a"]["x"] - e["b"]["x"]) ** 2 + (e["a"]["y"] - e["b"]["y"]) ** 2)))


def compactness(ring: Column) -> Column:
    p = perimeter(ring)
    return F.when(p == 0, 0.0).otherwise(4 * math.pi * area(ring) / (p * p))


def centroid(ring: Column) -> Column:
    """Area centroid; of a ring without area the mean of its vertices."""
    a = signed_area(ring)
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    axis = lambda c: _sum(F.transform(edges(ring), lambda e: (e["a"][c] + e["b"][c]) * cross(e))) / (6 * a)
    mean = lambda c: _sum(F.transform(ring, lambda p: p[c])) / F.size(ring)
    return F.when(a == 0, point(mean("x"), mean("y"))).otherwise(point(axis("x"), axis("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right."""
    crossed = F.filter(
        edges(ring),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def contains_with_holes(rings: Column, x: Column, y: Column) -> Column:
    """Ray casting on a polygon's shell and holes: inside an odd number of the rings."""
    return F.size(F.filter(rings, lambda ring: contains(ring, x, y))) % 2 == 1


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * HALF / 180, F.ln(F.tan((90 + lat) * math.pi / 360)) * HALF / math.pi


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 180 / HALF, F.degrees(2 * F.atan(F.exp(y * math.pi / HALF)) - math.pi / 2)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone or a given one (WGS 84, series to the sixth order)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    r = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.sin(r) ** 2)
    t, c = F.tan(r) ** 2, ep * F.cos(r) ** 2
    k = F.cos(r) * F.radians(lon - ((utm_zone(lon) if zone is None else zone) * 6 - 183))
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * r
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * r)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * r)
        - (35 * e2**3 / 3072) * F.sin(6 * r)
    )
    east = 0.9996 * n * (k + (1 - t + c) * k**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * k**5 / 120) + 500000
    north = 0.9996 * (m + n * F.tan(r) * (k**2 / 2 + (5 - t + 9 * c + 4 * c**2) * k**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * k**6 / 720))
    return east, F.when(lat < 0, north + 10000000).otherwise(north)


def reproject(ring: Column, source: int, target: int) -> Column:
    """Rings between 4326 and 3857; other codes are an error."""
    if (source, target) == (4326, 3857):
        return F.transform(ring, lambda p: point(*to_mercator(p["x"], p["y"])))
    if (source, target) == (3857, 4326):
        return F.transform(ring, lambda p: point(*from_mercator(p["x"], p["y"])))
    if source == target:
        return ring
    raise ValueError(f"no way from {source} to {target}")


def haversine_length(line: Column) -> Column:
    def metres(e: Column) -> Column:
        dlat, dlon = F.radians(e["b"]["y"] - e["a"]["y"]), F.radians(e["b"]["x"] - e["a"]["x"])
        h = F.sin(dlat / 2) ** 2 + F.cos(F.radians(e["a"]["y"])) * F.cos(F.radians(e["b"]["y"])) * F.sin(dlon / 2) ** 2
        return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    return _sum(F.transform(edges(line), metres))


def spherical_area(ring: Column) -> Column:
    """Area of a lon/lat ring on the sphere by the sum over its edges."""
    part = lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
    return F.abs(_sum(F.transform(edges(ring), part)) * (EARTH * EARTH / 2))


def length_label(metres: Column) -> Column:
    return F.when(metres > 100, F.concat(F.round(metres / 1000, 2).cast("string"), F.lit(" km"))).otherwise(F.concat(F.round(metres, 2).cast("string"), F.lit(" m")))


def buffer_point(x: Column, y: Column, radius: float, quarter: int = 16) -> Column:
    """A closed regular polygon with ``quarter`` segments a quarter circle."""
    n = 4 * quarter
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: point(x + radius * F.cos(k % n * (2 * math.pi / n)), y + radius * F.sin(k % n * (2 * math.pi / n))))


def chaikin(ring: Column, rounds: int, ratio: float = 0.25) -> Column:
    """Corner cutting of a closed ring."""
    def toward(a: Column, b: Column) -> Column:
        return point(a["x"] * (1 - ratio) + b["x"] * ratio, a["y"] * (1 - ratio) + b["y"] * ratio)

    for _ in range(rounds):
        cut = F.flatten(F.transform(edges(ring), lambda e: F.array(toward(e["a"], e["b"]), toward(e["b"], e["a"]))))
        ring = F.concat(cut, F.slice(cut, 1, 1))
    return ring


def main_direction(ring: Column) -> Column:
    """First principal axis of the vertices (the closing one included), 0 to 180 degrees."""
    n = F.size(ring)
    mx, my = _sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n
    sxx = _sum(F.transform(ring, lambda p: (p["x"] - mx) ** 2))
    syy = _sum(F.transform(ring, lambda p: (p["y"] - my) ** 2))
    sxy = _sum(F.transform(ring, lambda p: (p["x"] - mx) * (p["y"] - my)))
    return F.pmod(F.degrees(F.atan2(2 * sxy, sxx - syy)) / 2 + 180, F.lit(180.0))


def fill_holes(holes: Column, max_area: float | None) -> Column:
    """Holes that stay: those larger than ``max_area`` (None: none)."""
    return F.filter(holes, lambda h: F.lit(False) if max_area is None else area(h) > max_area)


def ring_checks(ring: Column, min_area: float = 1e-6, same: float = 1e-6) -> dict[str, Column]:
    n = F.size(ring)
    near = lambda a, b: (F.abs(a["x"] - b["x"]) <= same) & (F.abs(a["y"] - b["y"]) <= same)
    return {
        "few_vertices": n < 4,
        "unclosed": ~near(F.element_at(ring, 1), F.element_at(ring, -1)),
        "small": area(ring) < min_area,
        "repeated": F.exists(edges(ring), lambda e: near(e["a"], e["b"])),
    }


def self_intersects(ring: Column) -> Column:
    """Whether two edges that aren't neighbours cross."""
    numbered = F.transform(edges(ring), lambda e, i: F.struct(i.alias("i"), e["a"].alias("a"), e["b"].alias("b")))
    n = F.size(ring) - 1

    def side(p: Column, q: Column, r: Column) -> Column:
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def crosses(e: Column, f: Column) -> Column:
        apart = (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
        return apart & (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    return F.exists(numbered, lambda e: F.exists(numbered, lambda f: crosses(e, f)))


def position_at(line: Column, fraction: Column) -> Column:
    """The point at a fraction of a line's length; fractions above 1 run back (2 is the start again)."""
    f = F.when(fraction > 1, 2 - fraction).otherwise(fraction)
    dist = lambda e: F.sqrt((e["a"]["x"] - e["b"]["x"]) ** 2 + (e["a"]["y"] - e["b"]["y"]) ** 2)
    start = F.struct(F.lit(None).cast("struct<x:double,y:double>").alias("p"), (perimeter(line) * f).alias("left"))

    def go(s: Column, e: Column) -> Column:
        d = dist(e)
        k = F.when(d > 0, s["left"] / d).otherwise(0.0)
        at = point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * k, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * k)
        here = s["p"].isNull() & (s["left"] <= d * (1 + 1e-12))
        return F.struct(F.when(here, at).otherwise(s["p"]).alias("p"), (s["left"] - d).alias("left"))

    return F.coalesce(F.aggregate(edges(line), start, go)["p"], F.element_at(line, -1))
