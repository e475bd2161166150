"""Streams of shuffled micro-batches give the rows of their batch twins."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.streaming import detections as d
from fieldloom.streaming import stateful as s

SCHEMA = "camera long, frame long, ts timestamp, track_id long, class_name string, confidence double, x1 long, y1 long, x2 long, y2 long"
BEGIN = pd.Timestamp("2024-01-01")


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows(seed=1, cameras=3, frames=160, ranked=False):
    """Detections of some frames, with gaps short and long; two seconds a frame. ``ranked``: four numbers make a frame."""
    rng, out = random.Random(seed), []
    for camera in range(cameras):
        frame, at = 0, [(rng.randrange(1800), rng.randrange(900)) for _ in range(4)]
        while frame < frames:
            for track in range(rng.randrange(1, 5)):
                x, y = at[track]
                at[track] = (max(0, x + rng.randrange(-30, 31)), max(0, y + rng.randrange(-30, 31)))
                out.append((camera, 4 * frame + track if ranked else frame, (BEGIN + pd.Timedelta(seconds=2 * frame)).to_pydatetime(), track, rng.choice(["person", "car"]), 0.5, *at[track], at[track][0] + 40, at[track][1] + 60))
            frame += rng.choice([1] * 12 + [2, 5, 13, 30])
    return out


def replay(spark, tmp_path, data, schema, job, columns, batches=7, seed=3):
    """Rows of ``job`` over files of shuffled rows that stay within the watermark, and a last row that moves it on."""
    data, rng = sorted(data, key=lambda r: r[2]), random.Random(seed)
    for k in range(batches):
        part = data[k * len(data) // batches : (k + 1) * len(data) // batches]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    far = list(data[0])
    far[0], far[2] = 99, (BEGIN + pd.Timedelta(days=3)).to_pydatetime()
    spark.createDataFrame([tuple(far)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = job(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    return sorted(tuple(r) for r in out.where(F.col(columns[0]) != 99).select(*columns).collect())


def test_tracker_stream_equals_batch(rocks, tmp_path):
    data, columns = rows(ranked=True), ["camera", "frame", "n", "x", "y", "object"]
    want = sorted(tuple(r) for r in s.track_objects(rocks.createDataFrame(data, SCHEMA)).select(*columns).collect())
    assert replay(rocks, tmp_path, data, SCHEMA, s.track_objects_stream, columns) == want


def test_tracked_pieces_equal_one_tracker(spark):
    data = rows(5, ranked=True)
    got = sorted(tuple(r) for r in s.track_objects(spark.createDataFrame(data, SCHEMA)).collect())
    frame = pd.DataFrame([(r[0], r[1] // 4, r[1], r[4], (r[6] + r[8]) // 2, (r[7] + r[9]) // 2) for r in data], columns=["camera", "frame", "rank", "class_name", "x", "y"])
    want = [tuple(r) for camera, part in frame.groupby("camera") for r in s._track(d.Tracker(), None, camera, part).itertuples(index=False)]
    assert got == sorted(want)


def test_runs_are_cut_at_gaps_in_any_block(spark):
    frames = sorted(random.Random(2).sample(range(1000), 300))
    df = spark.createDataFrame([(c, f) for c in (1, 2) for f in frames], "camera long, frame long")
    run, want = None, {}
    for last, f in zip([None, *frames], frames):
        run = f if last is None or f - last > 4 else run
        want[f] = run
    for block in (1, 7, 5000):
        assert {(r.camera, r.frame): r.run for r in s.frame_runs(df, 4, block).collect()} == {(c, f): r for c in (1, 2) for f, r in want.items()}


def test_saves_stream_equals_batch(rocks, tmp_path):
    data, columns = rows(2), ["camera", "track_id", "frame"]
    want = sorted(tuple(r) for r in d.dedupe_saves(rocks.createDataFrame(data, SCHEMA), 30).select(*columns).collect())
    assert replay(rocks, tmp_path, data, SCHEMA, s.dedupe_saves_stream, columns) == want


def test_clips_stream_equals_batch(rocks, tmp_path):
    data, columns = rows(3), ["camera", "first", "last", "frames"]
    want = sorted(tuple(r) for r in d.event_clips(rocks.createDataFrame(data, SCHEMA)).select(*columns).collect())
    assert replay(rocks, tmp_path, data, SCHEMA, s.event_clips_stream, columns) == want


def test_growing_errors_raise_alerts_and_late_rows_are_dropped(rocks, tmp_path):
    schema = "stream_id long, n long, ts timestamp, kind string, bytes long"
    at = lambda minute: (BEGIN + pd.Timedelta(minutes=minute)).to_pydatetime()
    data = [(i, k, at(10 * w + k), "error" if k < errors else "bytes", 0) for i, counts in ((1, [1, 3, 3, 5, 2, 4]), (2, [0, 0, 1, 0, 0, 6])) for w, errors in enumerate(counts) for k in range(8)]
    want = sorted((r.stream_id, r.start, r.errors, r.before) for r in s.error_growth(rocks.createDataFrame(data, schema)).collect())
    assert [(i, e, b) for i, _, e, b in want] == [(1, 3, 1), (1, 5, 3), (1, 4, 2), (2, 1, 0), (2, 6, 0)]
    columns = ["stream_id", "start", "errors", "before"]
    assert replay(rocks, tmp_path, data, schema, s.error_growth_stream, columns) == want
    late = [(1, 50, at(0), "error", 0)] * 9  # after the whole log: the first window is final
    rocks.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = s.error_growth_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in rocks.read.parquet(str(tmp_path / "out")).where("stream_id <> 99").select(*columns).collect()) == want


def test_merged_sketches_are_near_the_exact_counts(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS camera", "(id * 7919) % 30011 AS track_id", "timestamp_seconds(1704067200 + id % 86400) AS ts")
    exact = {(r.camera, r.start): r.n for r in rows.groupBy("camera", F.window("ts", "6 hours").start.alias("start")).agg(F.countDistinct("track_id").alias("n")).collect()}
    got = {(r.camera, r.start): r.tracks for r in s.distinct_tracks(s.track_sketches(rows, "10 minutes"), "6 hours").collect()}
    assert set(got) == set(exact) and min(exact.values()) > 1000
    assert all(abs(got[k] - n) <= 4 * 0.0163 * n for k, n in exact.items())
