"""Stateful jobs on detection streams that take a key's rows in event-time order, each with a batch twin.

Rows of a key wait in list state until the watermark has passed them; event-time timers then hand them on in order, so that
any division into micro-batches gives the rows of the batch form. A timer behind a key's last row closes what is open when
the key falls silent. The streams need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fieldloom.streaming.detections import SAVE_GAP, Tracker

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Gives ``step`` a key's rows by (at, frame) once the watermark is behind them, and ``close`` the key when it is silent.

    ``columns`` is the DDL of the rows kept besides ``at`` (milliseconds) and ``frame``. Rows that come later than a frame
    that has been handed on are left out.
    """

    columns = ""

    def __init__(self, silent_ms: int = 3_600_000):
        self.silent_ms = silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.names = ["at", "frame"] + [c.split()[0] for c in self.columns.split(", ") if c]
        self.waiting = handle.getListState("waiting", ", ".join(filter(None, ["at long, frame long", self.columns])))
        self.seen = handle.getValueState("seen", "at long, frame long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.assign(at=part["ts"].astype("datetime64[ms]").astype("int64"))
            if len(part):
                self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in part[self.names].itertuples(index=False)])
                for at in {*part["at"].tolist(), int(part["at"].max()) + self.silent_ms}:
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.names)
        due = held["at"] <= until
        if due.any():
            rest = held[~due]
            self.waiting.clear()
            if len(rest):
                self.waiting.put([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in rest.itertuples(index=False)])
            last = self.seen.get() if self.seen.exists() else None
            rows = held[due].sort_values(["at", "frame"], kind="stable")
            rows = rows if last is None else rows[rows["frame"] > last[1]]
            if len(rows):
                self.seen.update((int(rows["at"].max()), int(rows["frame"].max())))
                yield self.step(key, rows)
        if due.all() and self.seen.exists() and self.seen.get()[0] + self.silent_ms <= until:
            yield self.end(key)
            self.seen.clear()

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def end(self, key) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def frame_runs(df: DataFrame, gap: int, block: int = 4096) -> DataFrame:
    """camera, frame, run of distinct frames; a run (its first frame) ends where more than ``gap`` frames lie to the next.

    Frames meet their neighbours in blocks, and blocks their neighbours by two numbers each, so that no task sorts a whole
    camera.
    """
    w, over = W.partitionBy("camera", "block").orderBy("frame"), W.partitionBy("camera").orderBy("block")
    frames = df.select("camera", "frame").distinct().withColumn("block", F.floor(F.col("frame") / block))
    edges = frames.groupBy("camera", "block").agg(F.max("frame").alias("high")).select("camera", "block", F.lag("high").over(over).alias("last"))
    frames = frames.withColumn("before", F.lag("frame").over(w)).join(edges, ["camera", "block"])
    before = F.coalesce("before", "last")
    frames = frames.withColumn("start", F.when(before.isNull() | (F.col("frame") - before > gap), F.col("frame")))
    carried = frames.groupBy("camera", "block").agg(F.max("start").alias("start")).select("camera", "block", F.max("start").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    so_far = F.max("start").over(w.rowsBetween(W.unboundedPreceding, 0))
    return frames.withColumn("run", so_far).join(carried, ["camera", "block"]).select("camera", "frame", F.coalesce("run", "carried").alias("run"))


# Tracking.

_TRACKED = "camera long, frame long, n long, x long, y long, object long"


def _boxes_as_points(df: DataFrame, per_frame: int) -> DataFrame:
    """One frame holds ``per_frame`` ranks; integer box centres."""
    return df.select(
        "camera", F.floor(F.col("frame") / per_frame).cast("long").alias("frame"), F.col("frame").cast("long").alias("rank"), "class_name",
        F.floor((F.col("x1") + F.col("x2")) / 2).cast("long").alias("x"), F.floor((F.col("y1") + F.col("y2")) / 2).cast("long").alias("y"), *(["ts"] if "ts" in df.columns else []),
    )


def _track(tracker: Tracker, last: int | None, camera: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Object of each row (-1: none), frame by frame; frames between without detections count as misses."""
    out = []
    for frame, part in rows.sort_values(["frame", "rank"]).groupby("frame", sort=True):
        for _ in range(min(int(frame) - last - 1, tracker.patience + 1) if last is not None else 0):
            tracker.frame([])
        last = int(frame)
        seen = list(zip(part["x"].astype(int), part["y"].astype(int), part["class_name"]))
        out += [(camera, last, n, x, y, -1 if got is None else got) for (x, y, _), n, got in zip(seen, part["rank"], tracker.frame(seen))]
    return pd.DataFrame(out, columns=["camera", "frame", "n", "x", "y", "object"])


def track_objects(df: DataFrame, per_frame: int = 4, patience: int = 10) -> DataFrame:
    """camera, frame, n, x, y, object: ids for detections without tracks; ``per_frame`` ranks make one frame.

    A camera's history is cut where no object outlives the frames without detections; each piece is tracked by itself and
    its ids follow those of the pieces before. A piece is held by one task.
    """
    points = _boxes_as_points(df.drop("ts"), per_frame)
    pieces = points.join(frame_runs(points, patience + 1), ["camera", "frame"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _track(Tracker(patience=patience), None, int(rows["camera"].iloc[0]), rows).assign(run=int(rows["run"].iloc[0]))

    tracked = pieces.groupBy("camera", "run").applyInPandas(run, _TRACKED + ", run long")
    ids = tracked.groupBy("camera", "run").agg((F.max("object") + 1).alias("used"))
    before = ids.select("camera", "run", F.coalesce(F.sum("used").over(W.partitionBy("camera").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    moved = F.when(F.col("object") < 0, F.lit(-1)).otherwise(F.col("object") + F.col("before")).cast("long")
    return tracked.join(before, ["camera", "run"]).select("camera", "frame", "n", "x", "y", moved.alias("object"))


class _TrackObjects(InOrder):
    columns = "rank long, class_name string, x long, y long"

    def __init__(self, silent_ms: int, patience: int):
        super().__init__(silent_ms)
        self.patience = patience

    def init(self, handle) -> None:
        super().init(handle)
        self.objects = handle.getListState("objects", "id long, x long, y long, class_name string, misses int")
        self.count = handle.getValueState("count", "next long, frame long")

    def step(self, key, rows):
        tracker = Tracker(patience=self.patience)
        tracker.next, last = self.count.get() if self.count.exists() else (0, None)
        tracker.objects = {i: [x, y, name, misses] for i, x, y, name, misses in (self.objects.get() if self.objects.exists() else ())}
        out = _track(tracker, last, int(key[0]), rows)
        self.objects.clear()
        if tracker.objects:
            self.objects.put([(int(i), int(x), int(y), name, int(misses)) for i, (x, y, name, misses) in tracker.objects.items()])
        self.count.update((int(tracker.next), int(rows["frame"].max())))
        return out

    def end(self, key):  # a silent camera keeps the number of its next object only
        self.objects.clear()
        return pd.DataFrame([], columns=["camera", "frame", "n", "x", "y", "object"])


def track_objects_stream(df: DataFrame, per_frame: int = 4, patience: int = 10, late: str = "1 minute", silent_ms: int = 3_600_000) -> DataFrame:
    """Streaming twin of ``track_objects``."""
    points = _boxes_as_points(df, per_frame).withWatermark("ts", late)
    return points.groupBy("camera").transformWithStateInPandas(_TrackObjects(silent_ms, patience), _TRACKED, "Append", "EventTime")


# Saves.

_SAVED = "camera long, track_id long, frame long"


class _Saves(InOrder):
    def __init__(self, silent_ms: int, gap: int):
        super().__init__(silent_ms)
        self.gap = gap

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "frame long")

    def step(self, key, rows):
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for frame in rows["frame"].tolist():
            if last is None or frame - last >= self.gap:
                out.append((int(key[0]), int(key[1]), frame))
                last = frame
        self.last.update((last,))
        return pd.DataFrame(out, columns=["camera", "track_id", "frame"])

    def end(self, key):
        self.last.clear()
        return pd.DataFrame([], columns=["camera", "track_id", "frame"])


def dedupe_saves_stream(df: DataFrame, gap: int = SAVE_GAP, late: str = "1 minute", silent_ms: int = 86_400_000) -> DataFrame:
    """Streaming twin of ``dedupe_saves``: rows of a track that are saved. After ``silent_ms`` without rows a track is new."""
    slim = df.select("camera", "track_id", F.col("frame").cast("long").alias("frame"), "ts").withWatermark("ts", late)
    return slim.groupBy("camera", "track_id").transformWithStateInPandas(_Saves(silent_ms, gap), _SAVED, "Append", "EventTime")


# Clips.

_CLIPS = "camera long, first long, last long, frames long"


class _Clips(InOrder):
    def __init__(self, silent_ms: int, seconds: float):
        super().__init__(silent_ms)
        self.seconds = seconds

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "first long, last long, frames long, began long, full boolean")

    def step(self, key, rows):
        clip, out = list(self.open.get()) if self.open.exists() else None, []
        for frame, at in zip(rows["frame"].tolist(), rows["at"].tolist()):
            if clip and frame == clip[1]:
                continue
            if clip and (clip[4] or frame - clip[1] != 1):
                out.append((int(key[0]), *clip[:3]))
                clip = None
            clip = [clip[0], frame, clip[2] + 1, clip[3], False] if clip else [frame, frame, 1, at, False]
            clip[4] = at - clip[3] > self.seconds * 1000
        self.open.update(tuple(clip))
        return pd.DataFrame(out, columns=["camera", "first", "last", "frames"])

    def end(self, key):
        out = [(int(key[0]), *self.open.get()[:3])] if self.open.exists() else []
        self.open.clear()
        return pd.DataFrame(out, columns=["camera", "first", "last", "frames"])


def event_clips_stream(df: DataFrame, seconds: float = 10, late: str = "1 minute", silent_ms: int = 60_000) -> DataFrame:
    """Streaming twin of ``event_clips``: camera, first, last, frames of each clip once it is over.

    A clip's end and its cap are state of its camera; the last clip before ``silent_ms`` of silence is closed by a timer.
    """
    slim = df.select("camera", F.col("frame").cast("long").alias("frame"), "ts").withWatermark("ts", late)
    return slim.groupBy("camera").transformWithStateInPandas(_Clips(silent_ms, seconds), _CLIPS, "Append", "EventTime")


# Health.

_ALERTS = "stream_id long, start timestamp, errors long, before long"


def error_counts(log: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """stream_id, start, ts (the window's last moment), errors of each window in which a stream logs something."""
    log = log.withWatermark("ts", late) if late else log
    counted = log.groupBy(F.window("ts", length).alias("window"), F.col("stream_id").cast("long").alias("stream_id")).agg(
        F.sum(F.when(F.col("kind") == "error", 1).otherwise(0)).cast("long").alias("errors")
    )
    return counted.select("stream_id", F.col("window.start").alias("start"), F.window_time("window").alias("ts"), "errors")


def error_growth(log: DataFrame, length: str = "10 minutes") -> DataFrame:
    """stream_id, start, errors, before: windows with more errors than the stream's window before (the last one with rows)."""
    counts = error_counts(log, length)
    grown = counts.withColumn("before", F.lag("errors").over(W.partitionBy("stream_id").orderBy("start")))
    return grown.where(F.col("errors") > F.col("before")).select("stream_id", "start", "errors", "before")


class _Growth(StatefulProcessor):
    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "errors long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, out = self.last.get()[0] if self.last.exists() else None, []
        for r in pd.concat(list(rows)).sort_values("start").itertuples():
            if before is not None and r.errors > before:
                out.append((int(key[0]), r.start, int(r.errors), int(before)))
            before = int(r.errors)
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["stream_id", "start", "errors", "before"])

    def close(self) -> None:
        pass


def error_growth_stream(log: DataFrame, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``error_growth``: a windowed count feeds a state that holds the count of the window before.

    Windows are final once the watermark has passed them; rows that come later are dropped.
    """
    return error_counts(log, length, late).groupBy("stream_id").transformWithStateInPandas(_Growth(), _ALERTS, "Append", "None")


# Distinct tracks.


def track_sketches(df: DataFrame, length: str, late: str | None = None, bits: int = 12) -> DataFrame:
    """camera, start, sketch: a mergeable sketch of the track ids of each window (batch, or with ``late`` a stream)."""
    df = df.withWatermark("ts", late) if late else df
    sketch = df.groupBy(F.window("ts", length).alias("window"), "camera").agg(F.hll_sketch_agg(F.col("track_id").cast("long"), bits).alias("sketch"))
    return sketch.select("camera", F.col("window.start").alias("start"), "sketch")


def distinct_tracks(sketches: DataFrame, length: str) -> DataFrame:
    """camera, start, tracks: about how many ids longer windows hold, from the sketches of shorter ones.

    The standard error is 1.04 / sqrt(2 ** bits), 1.6 % at 12 bits; merged windows are no less exact.
    """
    merged = sketches.groupBy("camera", F.window("start", length).alias("window")).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("camera", F.col("window.start").alias("start"), F.hll_sketch_estimate("sketch").alias("tracks"))
