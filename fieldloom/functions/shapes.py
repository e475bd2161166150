"""Geometry helpers that built-in functions don't express, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _rows(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*base)
        apart = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        far = int(apart.argmax())
        if apart[far] > tolerance:
            keep[a + 1 + far] = True
            stack += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def simplify(ring: Column, tolerance: float) -> Column:
    """Douglas-Peucker; a ring that would have fewer than four points stays as it is."""

    def run(rings: pd.Series) -> pd.Series:
        def one(ring):
            if ring is None:
                return None
            points = _points(ring)
            less = douglas_peucker(points, tolerance) if len(points) > 2 else points
            return _rows(less if len(less) >= 4 else points)

        return rings.map(one)

    return F.pandas_udf(run, RING)(ring)


def _rectangle_direction(points: np.ndarray) -> float:
    """Direction of the longer side of the smallest rotated rectangle, by the edges of the convex hull."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return float("nan")

    def half(ordered: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1:
                a, b = out[-1] - out[-2], p - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(half(list(pts)) + half(list(pts[::-1])))
    best = (np.inf, 0.0)
    for a, b in zip(hull, np.roll(hull, -1, 0)):
        angle = np.arctan2(*(b - a)[::-1])
        c, s = np.cos(angle), np.sin(angle)
        u, v = hull @ [c, s], hull @ [-s, c]
        w, h = np.ptp(u), np.ptp(v)
        if w * h < best[0] - 1e-12:
            best = (w * h, np.degrees(angle if w >= h else angle + np.pi / 2) % 180)
    return float(best[1])


def _map_vertices(ring: Column, change) -> Column:
    """Rings whose vertices are changed all at once: ``change`` takes and gives arrays of x and y."""

    @F.arrow_udf(RING)
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        size = column.value_lengths().to_numpy(zero_copy_only=False)
        empty = np.isnan(size.astype(float))
        axes = dict(zip([f.name for f in flat.type], flat.flatten())) if len(flat) else {}
        x, y = change(*(axes[c].to_numpy(zero_copy_only=False) for c in ("x", "y"))) if len(flat) else (np.zeros(0), np.zeros(0))
        offsets = np.r_[0, np.cumsum(np.where(empty, 0, size))].astype(np.int32)
        starts = pa.array(offsets, pa.int32(), mask=np.r_[empty, False]) if empty.any() else pa.array(offsets)
        return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["x", "y"]))

    return run(ring)


def lonlat_of_utm(x: np.ndarray, y: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of eastings and northings (WGS 84, inverse series to the sixth order)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep, e1 = e2 / (1 - e2), (1 - np.sqrt(1 - e2)) / (1 + np.sqrt(1 - e2))
    m = (y - (10_000_000 if south else 0)) / 0.9996
    mu = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * np.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * np.sin(4 * mu)
        + 151 * e1**3 / 96 * np.sin(6 * mu) + 1097 * e1**4 / 512 * np.sin(8 * mu)
    )
    c, t = ep * np.cos(foot) ** 2, np.tan(foot) ** 2
    w = 1 - e2 * np.sin(foot) ** 2
    n, r = a / np.sqrt(w), a * (1 - e2) / w**1.5
    d = (x - 500_000) / (n * 0.9996)
    lat = foot - n * np.tan(foot) / r * (
        d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep - 3 * c**2) * d**6 / 720
    )
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep + 24 * t**2) * d**5 / 120) / np.cos(foot)
    return zone * 6 - 183 + np.degrees(lon), np.degrees(lat)


def utm_of_lonlat(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eastings and northings in a zone (WGS 84, series to the sixth order)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    r = np.radians(lat)
    n = a / np.sqrt(1 - e2 * np.sin(r) ** 2)
    t, c, k = np.tan(r) ** 2, ep * np.cos(r) ** 2, np.cos(r) * np.radians(lon - (zone * 6 - 183))
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * r - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * np.sin(2 * r)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * np.sin(4 * r) - 35 * e2**3 / 3072 * np.sin(6 * r)
    )
    x = 0.9996 * n * (k + (1 - t + c) * k**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * k**5 / 120) + 500_000
    y = 0.9996 * (m + n * np.tan(r) * (k**2 / 2 + (5 - t + 9 * c + 4 * c**2) * k**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * k**6 / 720))
    return x, y + (10_000_000 if south else 0)


def into_utm(ring: Column, zone: int, south: bool = False) -> Column:
    """Lon/lat rings in a UTM zone; northings of a layer in the south count from 10,000 km."""
    return _map_vertices(ring, lambda x, y: utm_of_lonlat(x, y, zone, south))


def from_utm(ring: Column, zone: int, south: bool = False) -> Column:
    """Rings of a UTM zone in longitude and latitude."""
    return _map_vertices(ring, lambda x, y: lonlat_of_utm(x, y, zone, south))


def rectangle_direction(ring: Column) -> Column:
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else _rectangle_direction(_points(r))).astype(float)

    return F.pandas_udf(run, "double")(ring)


def crosses_itself(points: np.ndarray) -> bool:
    """Whether an open list of vertices, read as a ring, isn't simple: edges that meet elsewhere than neighbours at their vertex.

    Edges are compared with those only that begin before they end on the x axis, in blocks: long rings cost by what overlaps.
    """
    n = len(points)
    if n < 3:
        return True
    a, b = points, np.roll(points, -1, 0)
    if (a == b).all(1).any():
        keep = ~(a == b).all(1)
        return crosses_itself(points[keep]) if keep.sum() >= 3 else True
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    until = np.searchsorted(low[order, 0], high[order, 0], "right")
    side = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
    at = 0
    while at < n:
        end = at + max(1, int(np.searchsorted(np.cumsum(until[at:] - np.arange(at, n)), 1 << 20)))
        size = until[at:end] - np.arange(at, min(end, n)) - 1
        i = np.repeat(np.arange(at, min(end, n)), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        i, j = order[i], order[j]
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[meet], j[meet]
        first, second = side(a[i], b[i], a[j]), side(a[i], b[i], b[j])
        third, fourth = side(a[j], b[j], a[i]), side(a[j], b[j], b[i])
        touch = (np.sign(first) * np.sign(second) <= 0) & (np.sign(third) * np.sign(fourth) <= 0)
        after, before = (i + 1) % n == j, (j + 1) % n == i
        flat = (first == 0) & (second == 0)
        back = ((a[i] - b[i]) * (b[j] - a[j])).sum(1) > 0  # neighbours on one line that turn back
        if (touch & ~after & ~before).any() or (touch & (after | before) & flat & back).any():
            return True
        at = end
    return False


def crossing_rings(rings: np.ndarray) -> np.ndarray:
    """``crosses_itself`` of rings with equally many vertices (rings, vertices, 2): all pairs of edges of a block at once."""
    m, n = rings.shape[:2]
    if n < 3 or n > 64:
        return np.array([crosses_itself(r) for r in rings], bool)
    i, j = np.triu_indices(n, 1)
    near, back_near = j == i + 1, (i == 0) & (j == n - 1)
    out, step = np.zeros(m, bool), max(1, (1 << 17) // len(i))
    for at in range(0, m, step):
        a = rings[at : at + step]
        b = np.roll(a, -1, 1)
        low = np.minimum(a[..., 0], b[..., 0])
        swap = low[:, j] < low[:, i]
        first, second = np.where(swap, j, i), np.where(swap, i, j)
        row = np.arange(len(a))[:, None]
        p, q, r, s = a[row, first], b[row, first], a[row, second], b[row, second]
        side = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
        one, two, three, four = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
        boxes = ((np.minimum(p, q) <= np.maximum(r, s)) & (np.minimum(r, s) <= np.maximum(p, q))).all(-1)
        touch = boxes & (np.sign(one) * np.sign(two) <= 0) & (np.sign(three) * np.sign(four) <= 0)
        beside = near | back_near
        turns = (one == 0) & (two == 0) & (((p - q) * (s - r)).sum(-1) > 0)
        found = (touch & (~beside | turns)).any(1)
        for k in np.flatnonzero((a == b).all(-1).any(1)):  # repeated vertices
            found[k] = crosses_itself(a[k])
        out[at : at + step] = found
    return out


def _size(points: np.ndarray) -> float:
    x, y = points.T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _each_ring(ring: Column, change) -> Column:
    """``change`` from open vertices to open vertices, or None where the ring stays as it is; null rings stay null."""

    def one(rows):
        if rows is None or len(rows) < 5:
            return rows
        new = change(_points(rows)[:-1])
        return rows if new is None else _rows(np.vstack([new, new[:1]]))

    return F.pandas_udf(lambda rings: rings.map(one), RING)(ring)


MAIN_DIRECTIONS = (0.0, 45.0, 90.0, 135.0)


def snapped(points: np.ndarray, within: float, directions: tuple[float, ...] = MAIN_DIRECTIONS) -> np.ndarray | None:
    """Vertices after edges near a main direction have turned about their middles; None where the ring should stay."""
    to = np.roll(points, -1, 0)
    along, half = to - points, np.hypot(*(to - points).T)[:, None] / 2
    middle = (points + to) / 2
    angle = np.degrees(np.arctan2(along[:, 1], along[:, 0])) % 180
    apart = np.abs(angle[:, None] - np.array(directions))
    apart = np.minimum(apart, 180 - apart)
    target = np.radians(np.array(directions)[apart.argmin(1)])
    unit = np.stack([np.cos(target), np.sin(target)], 1)
    unit *= np.where((unit * along).sum(1) < 0, -1.0, 1.0)[:, None]
    turn = (apart.min(1) <= within)[:, None]
    unit = np.where(turn, unit, along / np.maximum(2 * half, 1e-300))
    begin, end = np.where(turn, middle - half * unit, points), np.where(turn, middle + half * unit, to)
    last, last_end = np.roll(unit, 1, 0), np.roll(end, 1, 0)
    cross = last[:, 0] * unit[:, 1] - last[:, 1] * unit[:, 0]
    gap = begin - last_end
    with np.errstate(divide="ignore", invalid="ignore"):
        step = (gap[:, 0] * unit[:, 1] - gap[:, 1] * unit[:, 0]) / cross
        new = np.where((np.abs(cross) < 1e-12)[:, None], (last_end + begin) / 2, last_end + step[:, None] * last)
    return None if _size(new) < _size(points) / 2 or crosses_itself(new) else new


def snap_edges(ring: Column, within: float = 10.0) -> Column:
    """Edges near 0, 45, 90 or 135 degrees turn about their middles, keeping their lengths; new vertices are the crossings
    of neighbouring edges' lines, or the midpoint between their ends where the two are parallel.

    The ring stays as it is when it has fewer than four vertices, and when the new one crosses itself or has less than
    half of the area.
    """
    return _each_ring(ring, lambda points: snapped(points, within))


def squared(rings: np.ndarray, low: float, high: float) -> np.ndarray:
    """Rings (rings, vertices, 2) after corners between two angles have been made square; those that should stay as they are."""
    length = lambda v: np.hypot(v[..., 0], v[..., 1])
    back, ahead = np.roll(rings, 1, 1) - rings, np.roll(rings, -1, 1) - rings
    reach = length(ahead)
    back, to = back / (length(back)[..., None] + 1e-10), ahead / (reach[..., None] + 1e-10)
    cosine = (back * to).sum(-1)
    angle = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
    square = to - cosine[..., None] * back
    square /= length(square)[..., None] + 1e-10
    moved = np.roll((low < angle) & (angle < high), 1, 1)[..., None]
    new = np.where(moved, np.roll(rings + square * reach[..., None], 1, 1), rings)
    ahead = np.roll(new, -1, 1)
    flat = (new[..., 0] * ahead[..., 1]).sum(1) == (new[..., 1] * ahead[..., 0]).sum(1)
    stay = flat | crossing_rings(rings) | crossing_rings(new)
    return np.where(stay[:, None, None], rings, new)


def square_corners(ring: Column, low: float = 70.0, high: float = 110.0) -> Column:
    """Corners between two angles (both exclusive) become right angles: the next vertex moves along its distance.

    All angles are those of the given ring, whatever moves. Rings that cross themselves stay as they are, as do those that
    would.
    """

    def run(rings: pd.Series) -> pd.Series:
        out, by_size = rings.copy(), {}
        for k, rows in enumerate(rings):
            if rows is not None and len(rows) >= 5:
                by_size.setdefault(len(rows), []).append(k)
        for size, places in by_size.items():
            given = np.stack([_points(rings.iat[k]) for k in places])[:, :-1]
            new = squared(given, low, high)
            for k in np.flatnonzero((new != given).any((1, 2))):
                out.iat[places[k]] = _rows(np.vstack([new[k], new[k, :1]]))
        return out

    return F.pandas_udf(run, RING)(ring)


def chunk_text(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of at most ``size`` characters: split at blank lines, then lines, spaces, characters, and merged again."""

    def split(text: str, marks: tuple[str, ...]) -> list[str]:
        mark, rest = next(((m, marks[i + 1 :]) for i, m in enumerate(marks) if m == "" or m in text))
        pieces = list(text) if mark == "" else [p for p in text.split(mark)]
        out: list[str] = []
        good: list[str] = []
        for piece in filter(None, pieces):
            if len(piece) <= size:
                good.append(piece)
                continue
            out += merge(good, mark)
            good = []
            out += split(piece, rest)
        return out + merge(good, mark)

    def merge(pieces: list[str], mark: str) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        total, gap = 0, len(mark)
        for piece in pieces:
            if held and total + gap + len(piece) > size:
                out.append(mark.join(held))
                while held and (total > overlap or total + gap + len(piece) > size):
                    total -= len(held[0]) + (gap if len(held) > 1 else 0)
                    held.pop(0)
            total += len(piece) + (gap if held else 0)
            held.append(piece)
        return out + ([mark.join(held)] if held else [])

    def one(text: str | None) -> list[str] | None:
        return None if text is None else [c.strip() for c in split(text, ("\n\n", "\n", " ", "")) if c.strip()]

    return F.pandas_udf(lambda texts: texts.map(one), "array<string>")(text)
