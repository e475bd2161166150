"""Exact intersection of general polygons: convex clipping of all pairs of an Arrow batch at once.

Polygons are parts: array<struct<shell, holes: array<ring>>>. A ring is cut by a convex ring edge by edge: every edge
keeps what lies to its left, for all pairs of the batch in the same few numpy steps. A ring that isn't convex is a signed
sum of the triangles of a fan; areas add up with the signs, whatever the ring's shape, so shells, holes and parts of any
form have exact intersection areas. Pieces with a geometry come from the triangles of an ear cutting instead, which don't
overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.shapes import RING, crossing_rings

PARTS = f"array<struct<shell:{RING},holes:array<{RING}>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PIECE = pa.list_(pa.struct([("shell", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT)))]))
_BLOCK = 1 << 16


@dataclass
class Rings:
    """Open rings, one after the other: vertices, their number, the row of each ring, 1 for shells and -1 for holes."""

    xy: np.ndarray
    size: np.ndarray
    row: np.ndarray
    sign: np.ndarray
    part: np.ndarray

    def take(self, i: np.ndarray) -> Rings:
        return Rings(self.xy[_span(self.size, i)], self.size[i], self.row[i], self.sign[i], self.part[i])

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)


def _span(size: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of the vertices of the rings ``i``."""
    start, n = (np.cumsum(size) - size)[i], size[i]
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _after(size: np.ndarray) -> np.ndarray:
    """The place of each vertex's successor in its ring."""
    out = np.arange(1, int(size.sum()) + 1)
    full = size > 0
    end = np.cumsum(size)
    out[end[full] - 1] = (end - size)[full]
    return out


def signed_areas(xy: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = len(size)
    if not len(xy):
        return np.zeros(n)
    owner = np.repeat(np.arange(n), size)
    base = xy[np.repeat((np.cumsum(size) - size), size)]
    p = xy - base
    q = p[_after(size)]
    return np.bincount(owner, (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]) / 2, n)


def _lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes and the flat values of a list column; null lists are empty."""
    return array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), array.flatten()


def _fields(array: pa.Array) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in array.type], array.flatten()))


def rings_of(parts: pa.Array) -> Rings:
    """The rings of a column of parts: closing and repeated vertices left out, turned to the left, without empty ones."""
    per_row, flat = _lists(parts)
    row = np.repeat(np.arange(len(per_row)), per_row)
    fields = _fields(flat)
    found = []
    for name, sign in (("shell", 1), ("holes", -1)):
        part, rings = np.arange(len(row)), fields[name]
        if sign < 0:
            per_part, rings = _lists(rings)
            part = np.repeat(part, per_part)
        size, points = _lists(rings)
        axes = _fields(points)
        xy = np.stack([axes[c].to_numpy(zero_copy_only=False) for c in ("x", "y")], 1) if len(points) else np.zeros((0, 2))
        found.append((xy, size, row[part], np.full(len(part), sign), part))
    rings = Rings(*(np.concatenate(x) for x in zip(*found)))
    owner, keep = rings.owner, np.ones(len(rings.xy), bool)
    if len(keep):
        keep = (rings.xy != rings.xy[_after(rings.size)]).any(1)
    rings = Rings(rings.xy[keep], np.bincount(owner[keep], minlength=len(rings.size)), rings.row, rings.sign, rings.part)
    area = signed_areas(rings.xy, rings.size)
    begin, owner = np.cumsum(rings.size) - rings.size, rings.owner
    place = np.arange(len(rings.xy))
    place = np.where(area[owner] < 0, 2 * begin[owner] + rings.size[owner] - 1 - place, place)
    rings.xy = rings.xy[place]
    order = np.argsort(rings.row, kind="stable")
    return rings.take(order[(rings.size >= 3)[order] & (area != 0)[order]])


def convex(rings: Rings) -> np.ndarray:
    """Whether each ring, turned to the left, bends nowhere to the right and goes round once."""
    after = _after(rings.size)
    along = rings.xy[after] - rings.xy
    ahead = along[after]
    bend = along[:, 0] * ahead[:, 1] - along[:, 1] * ahead[:, 0]
    turn = np.arctan2(bend, (along * ahead).sum(1))
    n = len(rings.size)
    return (np.bincount(rings.owner, bend < 0, n) == 0) & (np.bincount(rings.owner, turn, n) < 2 * np.pi + 1e-6)


def clip(xy: np.ndarray, size: np.ndarray, by: np.ndarray, by_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each ring cut to the convex ring of the same number; rings without anything in common become empty."""
    begin = np.cumsum(by_size) - by_size
    for k in range(int(by_size.max(initial=0))):
        owner = np.repeat(np.arange(len(size)), size)
        live = by_size > k
        here = np.minimum(begin + k, len(by) - 1)
        there = np.where(k + 1 < by_size, here + 1, begin)
        a, d = by[here], by[np.minimum(there, len(by) - 1)] - by[here]
        side = d[owner, 0] * (xy[:, 1] - a[owner, 1]) - d[owner, 1] * (xy[:, 0] - a[owner, 0])
        side = np.where(live[owner], side, 1.0)
        after = _after(size)
        inside, crosses = side >= 0, (side >= 0) != (side[after] >= 0)
        share = np.divide(side, side - side[after], out=np.zeros_like(side), where=crosses)
        met = xy + (xy[after] - xy) * share[:, None]
        count = inside.astype(np.int64) + crosses
        end = np.cumsum(count)
        out = np.empty((int(count.sum()), 2))
        out[(end - count)[inside]] = xy[inside]
        out[end[crosses] - 1] = met[crosses]
        xy, size = out, np.bincount(owner, count, len(size)).astype(np.int64)
    return xy, size


def _clippers(rings: Rings) -> tuple[Rings, np.ndarray]:
    """Convex rings with the factor by which each counts: rings as they are, or the triangles of a fan."""
    whole = convex(rings)
    rest = rings.take(np.flatnonzero(~whole))
    fan = np.maximum(rest.size - 2, 0)
    owner = np.repeat(np.arange(len(fan)), fan)
    first = (np.cumsum(rest.size) - rest.size)[owner]
    k = np.arange(len(owner)) - np.repeat(np.cumsum(fan) - fan, fan) + 1
    corners = rest.xy[np.stack([first, first + k, first + k + 1], 1).reshape(-1)].reshape(-1, 3, 2) if len(owner) else np.zeros((0, 3, 2))
    area = signed_areas(corners.reshape(-1, 2), np.full(len(corners), 3))
    corners = np.where((area < 0)[:, None, None], corners[:, ::-1], corners)
    kept = rings.take(np.flatnonzero(whole))
    flat = area != 0
    both = Rings(
        np.concatenate([kept.xy, corners[flat].reshape(-1, 2)]), np.r_[kept.size, np.full(int(flat.sum()), 3)], np.r_[kept.row, rest.row[owner][flat]],
        np.r_[kept.sign, rest.sign[owner][flat]], np.r_[kept.part, rest.part[owner][flat]],
    )
    factor = np.r_[np.ones(len(kept.size)), np.sign(area[flat])]
    order = np.argsort(both.row, kind="stable")
    return both.take(order), factor[order]


def _meetings(a: Rings, b: Rings, rows: int):
    """Blocks of (ring of a, ring of b) of the same row whose boxes meet."""
    start, count = np.searchsorted(b.row, np.arange(rows)), np.bincount(b.row, minlength=rows)
    n = count[a.row] if len(a.row) else np.zeros(0, np.int64)
    i = np.repeat(np.arange(len(n)), n)
    j = start[a.row][i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) if len(i) else i
    if len(i):
        box = lambda r, f: np.stack([f.reduceat(r.xy[:, c], np.cumsum(r.size) - r.size) for c in (0, 1)], 1)
        meet = ((box(a, np.minimum)[i] <= box(b, np.maximum)[j]) & (box(b, np.minimum)[j] <= box(a, np.maximum)[i])).all(1)
        i, j = i[meet], j[meet]
    for at in range(0, len(i), _BLOCK):
        yield i[at : at + _BLOCK], j[at : at + _BLOCK]


def intersection_areas(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Area that the polygons of each row share."""
    a = rings_of(left)
    b, factor = _clippers(rings_of(right))
    out = np.zeros(len(left))
    for i, j in _meetings(a, b, len(left)):
        one, two = a.take(i), b.take(j)
        base = two.xy[np.cumsum(two.size) - two.size]  # numbers near 0 lose less
        xy, size = clip(one.xy - np.repeat(base, one.size, 0), one.size, two.xy - np.repeat(base, two.size, 0), two.size)
        area = np.abs(signed_areas(xy, size)) * one.sign * two.sign * factor[j]
        out += np.bincount(one.row, area, len(out))
    return np.maximum(out, 0.0)


def intersection_area(left: Column, right: Column) -> Column:
    """Area that two polygons (parts) share; null or empty polygons share nothing. Rings must not cross themselves."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(intersection_areas(a, b))

    return run(left, right)


# Pieces.


def _keyhole(shell: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """One ring for a shell and its holes: each hole is joined to it by the shortest bridge that crosses nothing."""
    for hole in sorted(holes, key=lambda h: -h[:, 0].max()):
        h = np.roll(hole[::-1], -int(hole[::-1][:, 0].argmax()), 0)
        lines = [np.stack([r, np.roll(r, -1, 0)], 1) for r in (shell, *holes)]
        p, q = np.concatenate(lines).transpose(1, 0, 2)
        for k in np.argsort(((shell - h[0]) ** 2).sum(1), kind="stable"):
            a, b = h[0], shell[k]
            cross = lambda o, s, t: (s[..., 0] - o[..., 0]) * (t[..., 1] - o[..., 1]) - (s[..., 1] - o[..., 1]) * (t[..., 0] - o[..., 0])
            if not ((cross(a, b, p) * cross(a, b, q) < 0) & (cross(p, q, a[None]) * cross(p, q, b[None]) < 0)).any():
                shell = np.concatenate([shell[: k + 1], h, h[:1], shell[k:]])
                break
    return shell


def ears(ring: np.ndarray) -> list[np.ndarray]:
    """Triangles that fill a ring turned to the left, by cutting ears."""
    left, out = list(range(len(ring))), []
    while len(left) > 3:
        p = ring[left]
        a, b, c = np.roll(p, 1, 0), p, np.roll(p, -1, 0)
        bend = (b - a)[:, 0] * (c - b)[:, 1] - (b - a)[:, 1] * (c - b)[:, 0]
        inner = p[bend <= 0]
        cut = None
        for k in np.argsort(-bend, kind="stable"):
            if bend[k] <= 0:
                break
            side = lambda s, t: (t - s)[0] * (inner - s)[:, 1] - (t - s)[1] * (inner - s)[:, 0]
            held = (side(a[k], b[k]) > 0) & (side(b[k], c[k]) > 0) & (side(c[k], a[k]) >= 0)
            held &= (inner != a[k]).any(1) & (inner != c[k]).any(1)
            if not held.any():
                cut = int(k)
                break
        if cut is None:  # what is left has no area, or crosses itself
            flat = int(np.abs(bend).argmin())
            left.pop(flat)
            continue
        out.append(np.stack([a[cut], b[cut], c[cut]]))
        left.pop(cut)
    last = ring[left]
    return out + ([last] if len(left) == 3 and abs(signed_areas(last, np.array([3]))[0]) > 0 else [])


def _tiles(rings: Rings) -> Rings:
    """Convex rings that fill each polygon without overlap: convex shells as they are, others by their ears."""
    whole, found = convex(rings), []
    begin = np.cumsum(rings.size) - rings.size
    holes: dict[int, list[np.ndarray]] = {}
    for r in np.flatnonzero(rings.sign < 0):
        holes.setdefault(int(rings.part[r]), []).append(rings.xy[begin[r] : begin[r] + rings.size[r]])
    for r in np.flatnonzero(rings.sign > 0):
        ring, inner = rings.xy[begin[r] : begin[r] + rings.size[r]], holes.get(int(rings.part[r]), [])
        for tile in [ring] if whole[r] and not inner else ears(_keyhole(ring, inner)):
            found.append((tile, int(rings.row[r]), int(rings.part[r])))
    size = np.array([len(t) for t, *_ in found], np.int64)
    return Rings(np.concatenate([t for t, *_ in found]) if found else np.zeros((0, 2)), size, np.array([r for _, r, _ in found], np.int64), np.ones(len(found), np.int64), np.array([p for *_, p in found], np.int64))


def pieces(left: pa.Array, right: pa.Array, least: float = 1e-12) -> list[list[dict]]:
    """Parts of the left polygons inside the right ones: one for each left part and convex tile of the right polygon."""
    a, tiles = rings_of(left), _tiles(rings_of(right))
    out: list[dict[tuple[int, int], dict]] = [{} for _ in range(len(left))]
    for i, j in _meetings(a, tiles, len(left)):
        one, two = a.take(i), tiles.take(j)
        base = two.xy[np.cumsum(two.size) - two.size]
        xy, size = clip(one.xy - np.repeat(base, one.size, 0), one.size, two.xy - np.repeat(base, two.size, 0), two.size)
        area, end = signed_areas(xy, size), np.cumsum(size)
        for k in np.flatnonzero(area > least):
            ring = xy[end[k] - size[k] : end[k]] + base[k]
            ring = [{"x": float(x), "y": float(y)} for x, y in np.vstack([ring, ring[:1]])]
            piece = out[one.row[k]].setdefault((int(one.part[k]), int(j[k])), {"shell": None, "holes": []})
            if one.sign[k] > 0:
                piece["shell"] = ring
            else:
                piece["holes"].append(ring)
    return [[p for _, p in sorted(row.items()) if p["shell"] is not None] for row in out]


def clipped(left: Column, right: Column) -> Column:
    """Parts of the left polygon inside the right one; empty where they share no area, null polygons count as empty.

    Convex clip polygons leave one part for each part; others are cut into convex tiles, each of which leaves its own.
    What a concave part leaves on both sides of a tile's border stays one part, joined along that border.
    """

    @F.arrow_udf(PARTS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(pieces(a, b), _PIECE)

    return run(left, right)


def _beside(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What of a convex ring lies to the left of the line from ``a`` to ``b``."""
    side = (b - a)[0] * (ring[:, 1] - a[1]) - (b - a)[1] * (ring[:, 0] - a[0])
    out = []
    for p, q, s, t in zip(ring, np.roll(ring, -1, 0), side, np.roll(side, -1)):
        if s >= 0:
            out.append(p)
        if (s >= 0) != (t >= 0):
            out.append(p + (q - p) * (s / (s - t)))
    return np.array(out).reshape(-1, 2)


def _taken_from(pieces: list[np.ndarray], tile: np.ndarray, least: float) -> list[np.ndarray]:
    """Convex pieces without a convex tile: what lies beyond one edge of it and within those before, edge by edge."""
    out = []
    for piece in pieces:
        if (piece.max(0) <= tile.min(0)).any() or (tile.max(0) <= piece.min(0)).any():
            out.append(piece)
            continue
        left, beyond = piece, []
        for a, b in zip(tile, np.roll(tile, -1, 0)):
            beyond.append(_beside(left, b, a))
            left = _beside(left, a, b)
            if len(left) < 3:
                break
        size = lambda r: signed_areas(r, np.array([len(r)]))[0] if len(r) > 2 else 0.0
        out += [piece] if size(left) <= least else [r for r in beyond if size(r) > least]
    return out


def cut_away(parts: Column, others: Column) -> Column:
    """Convex parts that are left of a polygon without all of an array of polygons; empty where nothing is left.

    A polygon that meets none of the others keeps its parts as they are.
    """

    @F.arrow_udf(PARTS)
    def run(mine: pa.Array, taken: pa.Array) -> pa.Array:
        per_row, flat = _lists(taken)
        own, tiles = _tiles(rings_of(mine)), _tiles(rings_of(flat))
        tiles.row = np.repeat(np.arange(len(per_row)), per_row)[tiles.row] if len(tiles.row) else tiles.row
        split = lambda r: np.split(r.xy, np.cumsum(r.size)[:-1]) if len(r.size) else []
        have: list[list[np.ndarray]] = [[] for _ in range(len(mine))]
        for ring, row in zip(split(own), own.row.tolist()):
            have[row].append(ring)
        changed = [False] * len(mine)
        for tile, row in zip(split(tiles), tiles.row.tolist()):
            left = _taken_from(have[row], tile, 1e-12)
            changed[row] |= len(left) != len(have[row]) or any(x is not y for x, y in zip(left, have[row]))
            have[row] = left
        close = lambda r: [{"x": float(x), "y": float(y)} for x, y in np.vstack([r, r[:1]])]
        return pa.array([[{"shell": close(r), "holes": []} for r in have[k]] if changed[k] else mine[k].as_py() for k in range(len(mine))], _PIECE)

    return run(parts, others)


def valid_parts(parts: Column) -> Column:
    """Whether every ring has an area and doesn't cross or touch itself; null counts as invalid."""

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        per_row, flat = _lists(column)
        good = per_row > 0
        row = np.repeat(np.arange(len(per_row)), per_row)
        fields = _fields(flat)
        per_part, holes = _lists(fields["holes"])
        for rings, of in ((fields["shell"], row), (holes, np.repeat(row, per_part))):
            size, points = _lists(rings)
            axes = _fields(points)
            xy = np.stack([axes[c].to_numpy(zero_copy_only=False) for c in ("x", "y")], 1) if len(points) else np.zeros((0, 2))
            begin, ok = np.cumsum(size) - size, np.zeros(len(size), bool)
            for n in np.unique(size[size > 3]):
                at = np.flatnonzero(size == n)
                same = xy[begin[at][:, None] + np.arange(n)]
                area = signed_areas(same[:, :-1].reshape(-1, 2), np.full(len(at), n - 1))
                ok[at] = (same[:, 0] == same[:, -1]).all(1) & (area != 0) & ~crossing_rings(same[:, :-1])
            np.logical_and.at(good, of, ok)
        return pa.array(good)

    return run(parts)


def bounds(parts: Column) -> dict[str, Column]:
    """Box columns x0, y0, x1, y1 of the shells."""
    points = F.flatten(F.transform(parts, lambda p: p["shell"]))
    axis = lambda c: F.transform(points, lambda q: q[c])
    return {"x0": F.array_min(axis("x")), "y0": F.array_min(axis("y")), "x1": F.array_max(axis("x")), "y1": F.array_max(axis("y"))}
