"""Exact polygon areas and pieces against cells, closed forms and random half-planes; ring rules by numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import polygons as fp
from fieldloom.functions import shapes
from fieldloom.operators import overlay as o
from fieldloom.operators import polygons as p
from fieldloom.operators import vector as v


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def poly(*parts):
    return [{"shell": ring(shell), "holes": [ring(h) for h in holes]} for shell, *holes in parts]


L = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
U = [(0, 0), (9, 0), (9, 6), (6, 6), (6, 2), (3, 2), (3, 6), (0, 6)]
BOX = [(0, 0), (8, 0), (8, 8), (0, 8)]
HOLE = [(3, 3), (3, 5), (5, 5), (5, 3)]


def moved(points, dx, dy, turn=0.0):
    c, s = np.cos(turn), np.sin(turn)
    return [(x * c - y * s + dx, x * s + y * c + dy) for x, y in points]


def inside(points, x, y):
    out = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def cells(parts, n=40):
    """Area of an integer polygon by the centres of unit cells."""
    y, x = np.mgrid[-n:n, -n:n] + 0.5
    out = np.zeros(x.shape, bool)
    for shell, *holes in parts:
        one = inside(shell, x, y)
        for h in holes:
            one &= ~inside(h, x, y)
        out |= one
    return out


SHAPES = [[[L]], [[U]], [[BOX, HOLE]], [[BOX, HOLE], [moved(L, 10, 1)]], [[moved(U, -2, -3)]], [[moved(L, 1, 1)]], [[moved(BOX, 4, 4), moved(HOLE, 4, 4)]], [[moved(BOX, 20, 0)]]]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"i int, a {fp.PARTS}, b {fp.PARTS}")


def test_shared_areas_of_any_form_equal_cells(spark):
    pairs = [(a, b) for a in SHAPES for b in SHAPES]
    rows = [(k, poly(*a), poly(*b)) for k, (a, b) in enumerate(pairs)] + [(-1, None, poly([L])), (-2, poly([L]), []), (-3, None, None)]
    got = {r.i: r.area for r in frame(spark, rows).select("i", fp.intersection_area(F.col("a"), F.col("b")).alias("area")).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == pytest.approx((cells(a) & cells(b)).sum(), abs=1e-9)
    assert [got[k] for k in (-1, -2, -3)] == [0, 0, 0]


def test_turning_both_keeps_the_shared_area(spark):
    turn = lambda shape, t: [[moved(r, 1000.5, -77, t) for r in part] for part in shape]
    rows, want = [], []
    for a in SHAPES[:6]:
        for b in SHAPES[:6]:
            rows.append((len(rows), poly(*turn(a, 0.7)), poly(*turn(b, 0.7))))
            want.append((cells(a) & cells(b)).sum())
    got = {r.i: r.area for r in frame(spark, rows).select("i", fp.intersection_area(F.col("a"), F.col("b")).alias("area")).collect()}
    assert [got[k] for k in range(len(rows))] == pytest.approx(want, abs=1e-7)


def test_pieces_fill_what_is_shared(spark):
    pairs = [(a, b) for a in SHAPES for b in SHAPES]
    rows = [(k, poly(*a), poly(*b)) for k, (a, b) in enumerate(pairs)]
    cut = frame(spark, rows).select("i", "b", fp.clipped(F.col("a"), F.col("b")).alias("c"))
    got = {r.i: (r.area, r.inside) for r in cut.select("i", p.parts_area(F.col("c")).alias("area"), fp.intersection_area(F.col("c"), F.col("b")).alias("inside")).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == pytest.approx(((cells(a) & cells(b)).sum(),) * 2, abs=1e-9)


def test_random_convex_pairs_equal_sampled_half_planes():
    rng = np.random.default_rng(4)
    import pyarrow as pa

    shapes_, rows = [], []
    for _ in range(60):
        angles = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        if np.diff(np.r_[angles, angles[0] + 2 * np.pi]).max() > 3:
            continue
        centre = rng.uniform(0, 1, 2)
        shapes_.append([tuple(centre + 0.8 * np.array([np.cos(t), np.sin(t)])) for t in angles])
        rows.append(poly([shapes_[-1]]))
    y, x = (np.mgrid[0:900, 0:900] + 0.5) * (4 / 900) - 1.5
    kind = fp._PIECE
    got = fp.intersection_areas(pa.array(rows[:-1], kind), pa.array(rows[1:], kind))
    for area, a, b in zip(got, shapes_[:-1], shapes_[1:]):
        assert area == pytest.approx((inside(a, x, y) & inside(b, x, y)).sum() * (4 / 900) ** 2, abs=0.02)


def test_square_corners_reads_all_angles_from_the_given_ring(spark):
    rows = [(0, ring([(0, 0), (10, 1), (9, 8), (-1, 9)])), (1, ring([(0, 0), (4, 4), (4, 0), (0, 4)])), (2, None), (3, ring([(0, 0), (10, 0), (10, 5), (0, 5)])), (4, ring([(0, 0), (1, 0), (0, 1)]))]
    got = {r.i: r.out for r in spark.createDataFrame(rows, f"i int, r {shapes.RING}").select("i", shapes.square_corners(F.col("r")).alias("out")).collect()}
    want = [(-1.9010, -0.0104), (9.9884, 1.1098), (9.2964, 8.0360), (-0.9489, 6.5787)]
    assert [(q.x, q.y) for q in got[0][:4]] == [pytest.approx(w, abs=1e-4) for w in want] and got[0][0] == got[0][4]
    assert [(q.x, q.y) for q in got[1]] == [(q["x"], q["y"]) for q in rows[1][1]]  # crosses itself: as it was
    assert got[2] is None and [(q.x, q.y) for q in got[3]] == [pytest.approx((q["x"], q["y"]), abs=1e-8) for q in rows[3][1]] and len(got[4]) == 4


def test_parallel_neighbours_meet_between_the_turned_ends():
    got = shapes.snapped(np.array([(0, 0), (10, 0.6), (20, 0), (20, 10), (0, 10.0)]), 10)
    assert got == pytest.approx(np.array([(0, 0.3), (10, 0.3), (20, 0.3), (20, 10), (0, 10)]), abs=1e-9)
    assert shapes.snapped(np.array([(0, 0), (10, 5), (20, 0), (10, 30.0)]), 0) == pytest.approx(np.array([(0, 0), (10, 5), (20, 0), (10, 30.0)]))


def test_crossing_rings_are_told():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4.0)])
    assert not shapes.crosses_itself(square) and not shapes.crosses_itself(square[::-1])
    assert shapes.crosses_itself(square[[0, 2, 1, 3]])
    assert shapes.crosses_itself(np.array([(0, 0), (4, 0), (2, 0), (2, 3.0)]))  # turns back
    assert shapes.crosses_itself(np.array([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4.0)]))  # touches an edge
    angle = np.linspace(0, 2 * np.pi, 5001)[:-1]
    circle = np.stack([np.cos(angle), np.sin(angle)], 1)
    assert not shapes.crosses_itself(circle)
    circle[[10, 2500]] = circle[[2500, 10]]
    assert shapes.crosses_itself(circle)


def test_valid_parts(spark):
    rows = [(0, poly([BOX, HOLE]), None), (1, poly([[BOX[k] for k in (0, 2, 1, 3)]]), None), (2, None, None), (3, [], None), (4, [{"shell": ring(BOX)[:-1], "holes": []}], None), (5, poly([L], [U[:2] + U[2:4] + [(6, -1)]]), None)]
    assert {r.i: r.v for r in frame(spark, rows).select("i", fp.valid_parts(F.col("a")).alias("v")).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_what_is_left_without_others_equals_cells(spark):
    rows, want = [], []
    for a in SHAPES:
        for b, c in ((SHAPES[0], SHAPES[4]), (SHAPES[1], SHAPES[6]), (SHAPES[2], SHAPES[5]), (SHAPES[7], SHAPES[7]), (a, a)):
            rows.append((len(rows), poly(*a), [poly(*b), None, poly(*c)]))
            want.append((cells(a) & ~cells(b) & ~cells(c)).sum())
    df = spark.createDataFrame(rows, f"i int, a {fp.PARTS}, o array<{fp.PARTS}>")
    got = {r.i: r.area for r in df.select("i", p.parts_area(fp.cut_away(F.col("a"), F.col("o"))).alias("area")).collect()}
    assert [got[k] for k in range(len(rows))] == pytest.approx(want, abs=1e-9)


def test_larger_polygons_keep_what_they_share(spark):
    layer = p.with_bounds(spark.createDataFrame([(1, poly([BOX])), (2, poly([moved(BOX, 4, 4)])), (3, poly([moved(L, 1, 1)])), (4, poly([[(2, 2), (3, 2), (3, 3), (2, 3)]])), (5, poly([moved(L, 30, 30)]))], f"fid int, parts {fp.PARTS}"))
    got = {r.fid: (round(r.area, 9), r.covered) for r in p.flatten_polygons(layer, "fid", 5.0).collect()}
    assert got == {1: (64, False), 2: (48, False), 3: (20, True), 4: (1, True), 5: (20, False)}


def boxes_df(spark, boxes):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "fid int, x0 double, y0 double, x1 double, y1 double")


def test_unions_do_not_depend_on_cells_or_limits(spark):
    rng = np.random.default_rng(9)
    low = rng.integers(0, 60, (150, 2))
    boxes = np.hstack([low, low + rng.integers(0, 25, (150, 2))])
    df = boxes_df(spark, boxes).withColumn("g", F.col("fid") % 3)
    mask = np.zeros((3, 100, 100), bool)
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        mask[i % 3, y0:y1, x0:x1] = True
    want = {g: float(m.sum()) for g, m in enumerate(mask)}
    for cell, limit in ((7.3, 2048), (500.0, 2048), (500.0, 5), (13.0, 3)):
        got = {r.g: r.area for r in o.union_areas(df, ["g"], cell, limit, rounds=6).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    assert o.swept_area(np.zeros((0, 4))) == 0 and o.swept_area(np.array([[0, 0, 2, 3], [0, 0, 2, 3], [1, 1, 1, 9.0]])) == 6


def test_flatten_dissolve_and_overlay_by_numbers(spark):
    df = boxes_df(spark, [(0, 0, 4, 4), (1, 1, 3, 3), (2, 2, 5, 3), (10, 10, 11, 11), (10, 10, 11, 11)])
    got = {r.fid: (r.before, r.kept, r.covered) for r in o.flatten_areas(df, "fid", 3.0).collect()}
    assert got == {0: (16, 16, False), 1: (4, 0, True), 2: (3, 1, False), 3: (1, 1, False), 4: (1, 0, True)}
    other = boxes_df(spark, [(1, 1, 6, 2), (9, 9, 12, 12)]).withColumn("fid", F.col("fid") + 100)
    full = {(r.a_id, r.b_id): round(r.area, 9) for r in o.overlay_areas(df.where("fid in (0, 3)"), other, "fid", "fid", 2.5, "full").collect()}
    assert full == {(0, 100): 3, (3, 101): 1, (0, None): 13, (None, 100): 2, (None, 101): 8}
    assert [(r.fid, r.a) for r in o.covered_areas(df.where("fid = 0"), df.where("fid > 0"), "fid", 1.0).selectExpr("fid", "area AS a").collect()] == [(0, 5.0)]


def test_one_box_over_a_dense_layer_is_covered_by_many(spark):
    grid = boxes_df(spark, [(i, j, i + 1, j + 1) for i in range(40) for j in range(40)])
    target = boxes_df(spark, [(0, 0, 40, 40), (0.5, 0.5, 41, 3)])
    assert [r.fid for r in v.select_by_location(target, grid, "within", "fid", 5.0).collect()] == [0]
    assert [r.fid for r in v.select_by_location(target, grid, "overlaps", "fid", 5.0).collect()] == [1]


def test_clip_brings_features_to_the_clip_layers_coordinates(spark):
    square = [(1, 1), (2, 1), (2, 2), (1, 2)]
    layer = p.with_bounds(spark.createDataFrame([(7, poly([square]))], f"fid int, parts {fp.PARTS}"))
    clip = p.with_bounds(spark.createDataFrame([(1, poly([[(-1, -1), (3e5, -1), (3e5, 3e5), (-1, 3e5)]]))], f"cid int, parts {fp.PARTS}"))
    (row,) = p.clip_polygons(layer, clip, "fid", "cid", 1e6, crs=4326, clip_crs=3857).collect()
    assert row.area == pytest.approx(111319.4908 * 111359.6, rel=1e-3) and len(row.parts) == 1


def test_cells_settle_stacked_boxes_without_pairs(spark):
    rng = np.random.default_rng(12)
    low = np.round(rng.uniform(0, 20, (300, 2)), 1)
    boxes = np.c_[low, low + np.round(rng.uniform(0.1, 9, (300, 2)), 1)]
    cuts = lambda b, by: np.c_[np.maximum(by[:, :2], b[:2]), np.minimum(by[:, 2:], b[2:])]
    assert o.covered_by_union(boxes[:90], boxes[90:]) == pytest.approx([o.swept_area(cuts(b, boxes[90:])) for b in boxes[:90]])
    lost = [o.swept_area(cuts(b, boxes[k + 1 :])) for k, b in enumerate(boxes)]
    assert o.kept_by_last(boxes) == pytest.approx((boxes[:, 2:] - boxes[:, :2]).prod(1) - lost)
    n = 30_000  # all of one corner: 450 million pairs
    df = spark.range(n).selectExpr("id AS fid", "0D AS x0", "0D AS y0", "1D + id % 3000 AS x1", "1D AS y1")
    got = {r.fid: r.kept for r in o.flatten_areas(df, "fid", 40.0).where("kept > 0").collect()}
    assert got == {2999: 3000.0}
    held = o.covered_areas(df, df.where("fid < 2"), "fid", 40.0).groupBy("area").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, held.collect())) == [(1.0, 10), (2.0, n - 10)]


def test_kinds_of_polygons_share_what_the_general_way_finds(spark):
    import pyarrow as pa

    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    ring = lambda points: [{"x": float(x), "y": float(y)} for x, y in points]
    part = lambda shell, *holes: {"shell": ring(shell), "holes": [ring(h) for h in holes]}
    shapes = [
        [part(box(0, 0, 10, 10))], [part(box(2, 2, 8, 8)[::-1])], [part(box(1, 1, 9, 9), box(3, 3, 6, 6))], [part(box(0, 0, 4, 4)), part(box(900, 0, 906, 4))],
        [part(box(3, 3, 12, 5)), part(box(901, 1, 903, 9))], [part([(5, 0), (10, 5), (5, 10), (0, 5), (5, 0)])], [part([(902, 2), (905, 2), (902, 5), (902, 2)])],
    ]
    layer = p.with_bounds(spark.createDataFrame(list(enumerate(shapes)), f"i long, parts {fp.PARTS}"))
    got = {(r.a_i, r.b_i): r.shared for r in p.polygon_pairs(layer, layer, "i", "i", 5.0).collect()}
    rows, kind = [(i, j) for i in range(7) for j in range(7)], pa.array([shapes[0]], fp._PIECE).type
    want = dict(zip(rows, fp.intersection_areas(pa.array([shapes[i] for i, _ in rows], kind), pa.array([shapes[j] for _, j in rows], kind))))
    assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want) and set(got) <= set(want)
    assert (3, 0) in got and (6, 0) not in got and got[3, 4] == pytest.approx(1 + 6)


def test_rings_of_a_batch_are_told_as_single_ones():
    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 8):
        rings = np.r_[rng.uniform(0, 9, (150, n, 2)), rng.integers(0, 4, (300, n, 2)).astype(float)]
        told = shapes.crossing_rings(rings)
        assert told.tolist() == [shapes.crosses_itself(r) for r in rings] and told.any()
        assert shapes.squared(rings, 70, 110) == pytest.approx(np.stack([shapes.squared(r[None], 70, 110)[0] for r in rings]))
    assert shapes.crossing_rings(np.zeros((0, 4, 2))).tolist() == []
