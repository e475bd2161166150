"""Hand-made rows with known results, and properties that hold on any input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import geometry as g
from fieldloom.functions import shapes
from fieldloom.operators import catalog, evaluate, quality, raster, regions, vector
from fieldloom.streaming import detections


def mask_df(spark, grid):
    return spark.createDataFrame([(i, j, int(v)) for i, row in enumerate(grid) for j, v in enumerate(row)], "row long, col long, v long")


def grid_of(df, shape, name="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


def test_binary_metrics_of_equal_masks(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "t int, p int")
    r = evaluate.binary_change_metrics(df, "t", "p").first()
    assert (r["oa"], r["f1"], r["iou"], r["kappa"]) == (1, 1, 1, 1)


def test_mask_quality_known_scores_and_empty_case(spark):
    df = spark.createDataFrame([(1, a, b) for a, b in [(0, 0), (1, 1), (1, 0), (1, 1)]] + [(2, 0, 0)], "s int, t int, p int")
    rows = {r["s"]: r for r in evaluate.mask_quality(df, "s", "t", "p").collect()}
    assert rows[1]["iou"] == pytest.approx(2 / 3) and rows[1]["dice"] == pytest.approx(0.8) and rows[1]["precision"] == 1
    assert rows[2]["iou"] == 1 and rows[2]["area_error"] == 0


def test_confusion_drops_ignored(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (255, 1), (1, 7)], "truth int, pred int")
    counts = {(r["truth"], r["pred"]): r["n"] for r in evaluate.confusion_matrix(df, 2).collect()}
    assert counts == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_reclassify_half_open_and_later_wins(spark):
    df = spark.createDataFrame([(0, 0, v) for v in (0.0, 10.0, 20.0, 99.0)], "row int, col int, value double")
    got = [r["value"] for r in raster.reclassify(df, [(0, 20, 1), (10, 30, 2)], -1).collect()]
    assert got == [1.0, 2.0, 2.0, -1.0]


def test_calculator_rejects_other_names(spark):
    with pytest.raises(ValueError):
        raster.checked_expression("band_1 + java_method('x')", ["band_1"])


def test_select_by_attribute_compares_numbers_only_if_all_cast(spark):
    numbers = spark.createDataFrame([("9",), ("10",), (None,)], "v string")
    words = spark.createDataFrame([("9",), ("10",), ("x",)], "v string")
    assert [r["v"] for r in vector.select_by_attribute(numbers, "v", ">", 9).collect()] == ["10"]
    assert [r["v"] for r in vector.select_by_attribute(words, "v", ">", "9").collect()] == ["x"]
    with pytest.raises(ValueError):
        vector.select_by_attribute(words, "v", "~", 1)


def brute_labels(grid, diagonal):
    label, seen = {}, set()
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for r in range(grid.shape[0]):
        for c in range(grid.shape[1]):
            if (r, c) in seen:
                continue
            stack, seen = [(r, c)], seen | {(r, c)}
            while stack:
                a = stack.pop()
                label[a] = (r << 31) + c
                for dr, dc in steps:
                    b = a[0] + dr, a[1] + dc
                    if 0 <= b[0] < grid.shape[0] and 0 <= b[1] < grid.shape[1] and b not in seen and grid[a] == grid[b]:
                        seen.add(b)
                        stack.append(b)
    return label


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions_match_flood_fill_over_tile_borders(spark, diagonal):
    grid = np.random.default_rng(3).integers(0, 2, (23, 31))
    got = {(r["row"], r["col"]): r["label"] for r in regions.label_regions(mask_df(spark, grid), diagonal, tile=7).collect()}
    assert got == brute_labels(grid, diagonal)


def test_morphology_and_smoothing_match_numpy(spark):
    grid = np.random.default_rng(5).integers(0, 2, (12, 14))
    disk = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    inside = lambda i, j: 0 <= i < 12 and 0 <= j < 14
    want = np.array([[max(grid[i + a, j + b] for a, b in disk if inside(i + a, j + b)) for j in range(14)] for i in range(12)])
    assert (grid_of(raster.dilate(mask_df(spark, grid), 2), grid.shape) == want).all()
    want = np.array([[min(grid[i + a, j + b] for a, b in disk if inside(i + a, j + b)) for j in range(14)] for i in range(12)])
    assert (grid_of(raster.erode(mask_df(spark, grid), 2), grid.shape) == want).all()
    k = np.exp(-0.5 * (np.arange(-4, 5) / 1.0) ** 2)
    k /= k.sum()
    padded = np.pad(grid.astype(float), 4, mode="symmetric")
    rows = np.array([np.convolve(c, k, "valid") for c in padded.T]).T
    smooth = np.array([np.convolve(c, k, "valid") for c in rows])
    got = grid_of(raster.gaussian_smooth(mask_df(spark, grid), 1.0, 0.5, 12, 14), grid.shape)
    assert (got == (smooth > 0.5))[np.abs(smooth - 0.5) > 1e-9].all()


def test_holes_are_filled_and_small_regions_go(spark):
    grid = np.zeros((7, 7), int)
    grid[1:6, 1:6] = 1
    grid[3, 3] = 0
    assert grid_of(regions.fill_mask_holes(mask_df(spark, grid), 7, 7), grid.shape)[3, 3] == 1
    grid = np.zeros((6, 6), int)
    grid[0, 0] = grid[3:6, 3:6] = 1
    assert grid_of(regions.filter_regions(mask_df(spark, grid), 4), grid.shape).sum() == 9


def test_overlay_areas_add_up(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 2.0, 2.0, 6.0, 6.0)], "a long, x0 double, y0 double, x1 double, y1 double")
    other = spark.createDataFrame([(7, 1.0, 1.0, 3.0, 3.0)], "b long, x0 double, y0 double, x1 double, y1 double")
    area = lambda how: sum(r["area"] for r in vector.overlay_cells(boxes, other, "a", "b", 1.0, how).collect())
    assert area("inner") + area("left_anti") == 32


def test_suppression_leaves_no_pair_above(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(1, 12, (4, 60))))]
    boxes = spark.createDataFrame(rows, "fid long, x0 double, y0 double, x1 double, y1 double")

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = max(w, 0) * max(h, 0)
        return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)

    kept = []
    for r in sorted(rows, key=lambda r: (-(r[3] - r[1]) * (r[4] - r[2]), r[0])):
        if all(iou(r, k) <= 0.3 for k in kept):
            kept.append(r)
    got = {r["fid"] for r in vector.greedy_suppress(boxes, "fid", 5.0, 0.3).collect()}
    assert got == {k[0] for k in kept}


def test_nearest_distance_with_far_points_and_nulls(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 900.0), (3, None, 1.0)], "pid long, x double, y double")
    right = spark.createDataFrame([(3.0, 4.0), (0.0, 50.0)], "x double, y double")
    got = {r["pid"]: r["distance"] for r in vector.nearest_distance(left, right, "pid", 2.0).collect()}
    assert got[1] == 5 and got[3] is None and got[2] == pytest.approx(np.hypot(900, 850))


def test_geometry_expressions(spark):
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 0D, 'y', 3D), named_struct('x', 0D, 'y', 0D))")
    bow = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 3D), named_struct('x', 0D, 'y', 0D))")
    x, y = g.to_utm(F.lit(108.945), F.lit(34.265))
    r = spark.range(1).select(
        g.area(ring).alias("a"), g.perimeter(ring).alias("p"), g.contains(ring, F.lit(1.0), F.lit(1.0)).alias("i"), g.contains(ring, F.lit(5.0), F.lit(1.0)).alias("o"),
        g.self_intersects(ring).alias("s"), g.self_intersects(bow).alias("b"), g.main_direction(ring).alias("d"), x.alias("x"), y.alias("y"), shapes.snap_edges(ring).alias("r"),
    ).first()
    assert (r["a"], r["p"], r["i"], r["o"], r["s"], r["b"]) == (12, 14, True, False, False, True)
    assert abs(r["x"] - 310841) < 1500 and abs(r["y"] - 3793000) < 3000
    assert len(r["r"]) == 5


def test_douglas_peucker_keeps_far_points():
    points = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], float)
    assert shapes.douglas_peucker(points, 1.0).tolist() == [[0, 0], [2, -0.1], [3, 5], [7, 9], [9, 9]]


def test_tracker_gives_new_ids_only_in_surplus_frames():
    t = detections.Tracker()
    assert t.frame([(0, 0, "a"), (100, 100, "b")]) == [0, 1]
    assert t.frame([(5, 5, "a"), (400, 400, "c")]) == [0, None]
    assert t.objects[1][3] == 1
    assert t.frame([(6, 6, "a"), (100, 101, "b"), (400, 400, "c")]) == [0, 1, 2]
    for _ in range(11):
        t.frame([])
    assert not t.objects


def test_dwell_alert_needs_time_and_stillness():
    d = detections.Dwell()
    assert not d.step(1000, 0.5, 0.5, "person")
    assert d.step(1030, 0.5, 0.5, "person")
    assert not d.step(1050, 0.5, 0.5, "person")
    assert d.step(1090, 0.5, 0.52, "person")
    assert not d.step(1200, 0.9, 0.5, "person")


def test_saves_depend_on_the_last_saved_row(spark):
    df = spark.createDataFrame([(0, 1, f) for f in (0, 20, 35, 50, 66)], "camera long, track_id long, frame long")
    assert sorted(r["frame"] for r in detections.dedupe_saves(df).collect()) == [0, 35, 66]


def test_dwell_stream_gives_the_batch_rows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    d = detections.detections(events)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = detections.dwell_alerts_stream(source).writeStream.format("memory").queryName("dwell").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("dwell").select("camera", "track_id", "ts").collect()))
    want = sorted(map(tuple, detections.dwell_alerts(d).select("camera", "track_id", "ts").collect()))
    assert got == want and want


def test_window_stream_counts_as_batch(spark, tmp_path):
    d = detections.detections(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    d.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = detections.class_counts_by_window(source, "5 minutes", late="1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, detections.class_counts_by_window(d, "5 minutes").collect()))


def test_geojson_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    catalog.write_geojson(boxes.select("fid", g.box_ring().alias("ring")), str(tmp_path / "g"))
    back = catalog.read_geojson(spark, str(tmp_path / "g"), "fid long").first()
    assert back["fid"] == 1 and back["geom_type"] == "Polygon" and back["parts"][0][0][2] == [2.0, 1.0]


def test_layer_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "fid long, kind string")
    for name in ("l.parquet", "l.orc"):
        catalog.write_layer(df, str(tmp_path / name))
        assert sorted(map(tuple, catalog.read_layer(spark, str(tmp_path / name)).select("fid", "kind").collect())) == [(1, "a"), (2, "b")]


def test_splits(spark):
    df = spark.range(200).withColumn("class", F.col("id") % 2)
    counts = {(r["class"], r["split"]): r["count"] for r in evaluate.split_stratified(df, "id", "class").groupBy("class", "split").count().collect()}
    assert counts == {(c, s): n for c in (0, 1) for s, n in (("train", 70), ("val", 15), ("test", 15))}
    assert evaluate.split_holdout(df, "id", 0.2).where("split = 'val'").count() == 40


def test_chunks_keep_to_the_size(spark):
    text = "one two three\n\n" * 60 + "x" * 1200
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = [r["c"] for r in df.select(shapes.chunk_text(F.col("t"), 100, 10).alias("c")).collect()]
    assert rows[1] is None and rows[2] == [] and all(len(c) <= 100 for c in rows[0]) and "".join(rows[0]).count("x") >= 1200


def test_repair_keeps_log_and_quarantine(spark):
    boxes = spark.createDataFrame([(i, 10.0 * i, 0.0, 10.0 * i + 4, 5.0) for i in range(1, 8)], "fid long, x0 double, y0 double, x1 double, y1 double")
    fixed, log, bad = quality.repair_layer(quality.polygon_layer(boxes), 10.0)
    assert [r["name"] for r in log.orderBy("step").collect()] == ["invalid", "holes", "overlaps", "slivers", "multiparts", "copies", "empty"]
    assert bad.isEmpty() and fixed.count() == 8
    assert isinstance(fixed.schema["ring"].dataType, T.ArrayType)


def test_keyframe_stream_gives_the_batch_rows(spark, tmp_path):
    from fieldloom.sources.fixtures import layer

    frames = layer(spark, "/root/testdata/sf0.001", "frames")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    q = detections.keyframe_stream(source).writeStream.format("memory").queryName("keys").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["frame"] for r in spark.table("keys").collect()) == sorted(r["frame"] for r in detections.keyframes(frames).collect())


def test_stream_to_files_by_date_and_distinct_tracks(spark, tmp_path):
    d = detections.detections(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    d.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = detections.write_by_date(detections.distinct_tracks_stream(source, "30 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == d.select("camera", "track_id").distinct().count()


def test_vector_index_is_bucketed(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    catalog.index_vectors(df, "vector_index_test", 4)
    assert spark.table("vector_index_test").count() == 2
    spark.sql("DROP TABLE vector_index_test")
