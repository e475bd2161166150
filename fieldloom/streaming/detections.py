"""Jobs on streams of detections: batch forms and their streaming twins.

State lives per (camera, track) or per camera; rows of a key are taken in event-time order. The streaming forms drop
rows that come after the watermark and let an event-time timer end the state of a key that falls silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds that a class may stay, vehicles and persons.
DWELL_SECONDS = {"person": 30, "car": 600, "truck": 600, "bus": 600, "motorcycle": 600, "bicycle": 600}
UNKNOWN_SECONDS, STILL, ALERT_GAP = 9999, 0.05, 60
SAVE_GAP = 30


def detections(events: DataFrame) -> DataFrame:
    """Detection rows from the events table: 8 cameras, frame = rank in the camera, two seconds a frame."""
    rank = F.row_number().over(W.partitionBy("camera").orderBy("ts0", "event_id")) - 1
    name = F.create_map(*[F.lit(x) for x in ("click", "person", "view", "car", "purchase", "truck", "signup", "bus")])[F.col("event_type")]
    still = F.col("user_id") % 3 == 0
    d = events.select("event_id", "user_id", "event_type", F.col("ts").alias("ts0"), (F.col("user_id") % 8).alias("camera")).withColumn("frame", rank.cast("long"))
    d = d.select(
        "camera", "frame", F.timestamp_seconds(F.lit(1704067200) + 2 * F.col("frame")).alias("ts"), F.col("user_id").alias("track_id"),
        F.coalesce(name, F.lit("other")).alias("class_name"), ((F.col("event_id") % 100) / 100.0).cast("double").alias("confidence"),
        F.when(still, 100 + F.col("user_id") % 50).otherwise((F.col("event_id") * 37) % 1800).alias("x1"),
        F.when(still, 200 + F.col("user_id") % 50).otherwise((F.col("event_id") * 53) % 1000).alias("y1"),
    )
    return d.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 60})


def target_class_filter(df: DataFrame, classes: list[str], confidence: float) -> DataFrame:
    return df.where(F.col("class_name").isin(classes) & (F.col("confidence") >= confidence))


def zone_label(width: int = 1920, height: int = 1080) -> Column:
    """left / center / right by the box centre, with _top or _bottom where the height asks for it."""
    cx, cy = F.floor((F.col("x1") + F.col("x2")) / 2), F.floor((F.col("y1") + F.col("y2")) / 2)
    side = F.when(cx < width * 0.3, "left").when(cx > width * 0.7, "right").otherwise("center")
    return F.concat(side, F.when(cy < height * 0.3, "_top").when(cy > height * 0.7, "_bottom").otherwise(""))


class Dwell:
    """State of a track: start, last centre, path length and last alert; step() tells whether a row raises an alert."""

    def __init__(self, state: tuple[float, float, float, float, float] | None = None):
        self.first, self.x, self.y, self.path, self.alert = state or (-1.0, 0.0, 0.0, 0.0, 0.0)

    def step(self, t: float, x: float, y: float, name: str) -> bool:
        if self.first < 0:
            self.first, self.x, self.y = t, x, y
        self.path += float(np.hypot(x - self.x, y - self.y))
        self.x, self.y = x, y
        limit = DWELL_SECONDS.get(name, UNKNOWN_SECONDS)
        if t - self.first >= limit and self.path <= STILL and t - self.alert >= ALERT_GAP:
            self.alert = t
            return True
        return False


DWELL_SCHEMA = "camera long, track_id long, ts timestamp, class_name string, seconds double, path double"


def _dwell_rows(dwell: Dwell, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["ts", "frame"]).itertuples():
        t = r.ts.timestamp()
        if dwell.step(t, (r.x1 + r.x2) / 2 / 1920, (r.y1 + r.y2) / 2 / 1080, r.class_name):
            out.append((*key, r.ts, r.class_name, t - dwell.first, dwell.path))
    return pd.DataFrame(out, columns=["camera", "track_id", "ts", "class_name", "seconds", "path"])


def dwell_alerts(df: DataFrame) -> DataFrame:
    """Alerts of tracks that stay still for their class's time, at most one a minute and track.

    A path only grows, so a window tells the rows that may alert; only these meet for the rule of one a minute.
    """
    w = W.partitionBy("camera", "track_id").orderBy("ts", "frame")
    x, y = (F.col("x1") + F.col("x2")) / 2 / 1920, (F.col("y1") + F.col("y2")) / 2 / 1080
    step = F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w))
    moved = df.withColumns({"step": F.coalesce(step, F.lit(0.0)), "at": F.unix_micros("ts")})
    so_far = moved.withColumns({"path": F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)), "seconds": (F.col("at") - F.first("at").over(w)) / 1e6})
    limit = F.coalesce(F.create_map(*[F.lit(x) for pair in DWELL_SECONDS.items() for x in pair])[F.col("class_name")], F.lit(UNKNOWN_SECONDS))
    still = so_far.where((F.col("seconds") >= limit) & (F.col("path") <= STILL)).select("camera", "track_id", "frame", "ts", "at", "class_name", "seconds", "path")

    def spaced(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "frame"])
        at, keep, k = rows["at"].to_numpy(), [], 0
        while k < len(at):
            keep.append(k)
            k = max(k + 1, int(np.searchsorted(at, at[k] + ALERT_GAP * 1_000_000)))
        return rows.iloc[keep][["camera", "track_id", "ts", "class_name", "seconds", "path"]]

    return still.groupBy("camera", "track_id").applyInPandas(spaced, DWELL_SCHEMA)


def dwell_alerts_stream(df: DataFrame, late: str = "1 minute", silent_ms: int = 3_600_000) -> DataFrame:
    """Streaming twin of ``dwell_alerts``; rows within a batch are ordered, a silent track's state ends by timer."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        dwell = Dwell(state.get if state.exists else None)
        rows = pd.concat(list(parts))
        yield _dwell_rows(dwell, key, rows)
        state.update((dwell.first, dwell.x, dwell.y, dwell.path, dwell.alert))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + silent_ms)

    return df.withWatermark("ts", late).groupBy("camera", "track_id").applyInPandasWithState(
        run, DWELL_SCHEMA, "first double, x double, y double, path double, alert double", "append", GroupStateTimeout.EventTimeTimeout
    )


def dedupe_saves(df: DataFrame, gap: int = SAVE_GAP) -> DataFrame:
    """Rows of a track that are saved: the first, then each ``gap`` frames or more after the last saved one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, keep, last = rows.sort_values("frame"), [], None
        for frame in rows["frame"]:
            save = last is None or frame - last >= gap
            keep.append(save)
            last = frame if save else last
        return rows[keep]

    slim = df.select("camera", "track_id", "frame")
    return slim.groupBy("camera", "track_id").applyInPandas(run, slim.schema)


def event_clips(df: DataFrame, seconds: float = 10) -> DataFrame:
    """Clips of a camera's frames with detections: (camera, run, clip, first, last, frames).

    A frame without detections ends a clip. So does the first frame more than ``seconds`` after the clip's first one;
    it still belongs to the clip, and the next frame begins another, at any frame rate. A run of frames without a gap is
    held by one task (16 bytes a frame).
    """
    frames = df.groupBy("camera", "frame").agg(F.min("ts").alias("ts"))
    w = W.partitionBy("camera").orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(w) == 1, 0).otherwise(1)
    runs = frames.select("camera", "frame", F.unix_micros("ts").alias("at"), F.sum(new).over(w).alias("run"))

    def cut_run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        frame, at = rows["frame"].to_numpy(), np.maximum.accumulate(rows["at"].to_numpy())
        begins, ends = [0], []
        while True:
            ends.append(min(int(np.searchsorted(at, at[begins[-1]] + int(seconds * 1_000_000), "right")), len(at) - 1))
            if ends[-1] + 1 >= len(at):
                break
            begins.append(ends[-1] + 1)
        out = pd.DataFrame({"clip": range(len(begins)), "first": frame[begins], "last": frame[ends], "frames": np.array(ends) - np.array(begins) + 1})
        out.insert(0, "run", rows["run"].iloc[0])
        out.insert(0, "camera", rows["camera"].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    return runs.groupBy("camera", "run").applyInPandas(
        cut_run, f"camera {kinds['camera']}, run {kinds['run']}, clip long, first {kinds['frame']}, last {kinds['frame']}, frames long"
    )


def class_counts_by_window(df: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """persons, vehicles and all detections by camera and window; with ``late``, for streams."""
    df = df.withWatermark("ts", late) if late else df
    counted = df.groupBy(F.window("ts", length, slide), "camera").agg(
        F.sum(F.when(F.col("class_name") == "person", 1).otherwise(0)).alias("persons"),
        F.sum(F.when(F.col("class_name").isin("car", "truck", "bus"), 1).otherwise(0)).alias("vehicles"),
        F.count("*").alias("n"),
    )
    return counted.select("camera", F.col("window.start").alias("start"), "persons", "vehicles", "n")


def running_totals(df: DataFrame) -> DataFrame:
    """Cumulative persons, vehicles and detections by camera and frame."""
    per = df.groupBy("camera", "frame").agg(
        F.sum(F.when(F.col("class_name") == "person", 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("class_name").isin("car", "truck", "bus"), 1).otherwise(0)).alias("v"),
        F.count("*").alias("n"),
    )
    w = W.partitionBy("camera").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return per.select("camera", "frame", F.sum("p").over(w).alias("persons"), F.sum("v").over(w).alias("vehicles"), F.sum("n").over(w).alias("all"))


class Tracker:
    """Greedy nearest-centroid tracker of one camera."""

    def __init__(self, reach: float = 50.0, patience: int = 10):
        self.reach, self.patience, self.next = reach, patience, 0
        self.objects: dict[int, list] = {}  # id -> [x, y, class, misses]

    def _miss(self, ids: list[int]) -> None:
        for i in ids:
            self.objects[i][3] += 1
            if self.objects[i][3] > self.patience:
                del self.objects[i]

    def _add(self, row: tuple[int, int, str]) -> int:
        self.objects[self.next] = [row[0], row[1], row[2], 0]
        self.next += 1
        return self.next - 1

    def frame(self, rows: list[tuple[int, int, str]]) -> list[int | None]:
        """The object id of each detection (x, y, class) of a frame; None where none is given."""
        if not rows:
            self._miss(list(self.objects))
            return []
        if not self.objects:
            return [self._add(r) for r in rows]
        ids = list(self.objects)
        held = np.array([self.objects[i][:2] for i in ids], float)
        seen = np.array([r[:2] for r in rows], float)
        apart = np.hypot(*(held[:, None] - seen[None]).transpose(2, 0, 1))
        out: list[int | None] = [None] * len(rows)
        used: set[int] = set()
        for i in np.argsort(apart.min(1), kind="stable"):
            j = int(apart[i].argmin())
            if j in used or out[j] is not None or apart[i, j] > self.reach:
                continue
            self.objects[ids[i]][:2], self.objects[ids[i]][3] = list(rows[j][:2]), 0
            out[j] = ids[i]
            used.add(j)
        matched = {x for x in out if x is not None}
        if len(rows) > len(ids):
            for j, got in enumerate(out):
                if got is None:
                    out[j] = self._add(rows[j])
        else:
            self._miss([i for i in ids if i not in matched])
        return out


def keyframes(frames: DataFrame, above: float = 30.0) -> DataFrame:
    """Frames whose mean absolute change against the frame before exceeds ``above``; never the first."""
    before = frames.select("camera", (F.col("frame") + 1).alias("frame"), "row", "col", F.col("grey").alias("was"))
    change = frames.join(before, ["camera", "frame", "row", "col"]).groupBy("camera", "frame").agg(F.avg(F.abs(F.col("grey") - F.col("was"))).alias("change"))
    return change.where(F.col("change") > above)


def fps_30(df: DataFrame) -> DataFrame:
    """Every 30th frame of a camera with 30 / (seconds since the mark before)."""
    marks = df.where("frame % 30 = 0").select("camera", "frame", F.unix_timestamp("ts").alias("t")).distinct()
    w = W.partitionBy("camera").orderBy("frame")
    return marks.select("camera", "frame", (30.0 / (F.col("t") - F.lag("t").over(w))).alias("fps"))


def stream_health(log: DataFrame) -> DataFrame:
    """Per stream and in all (null): uptime in seconds, bytes, errors, reconnections."""
    ts, count = F.col("ts").cast("timestamp"), lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    return log.rollup("stream_id").agg(
        (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("uptime"), F.sum("bytes").alias("bytes"), count("error").alias("errors"), count("reconnect").alias("reconnects")
    )


def stream_health_windows(log: DataFrame, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Live form: errors and bytes by window and stream, for streams with an event-time column ts."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", length), "stream_id").agg(
        F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("kind") == "error", 1).otherwise(0)).alias("errors")
    ).select("stream_id", F.col("window.start").alias("start"), "bytes", "errors")


def distinct_tracks_stream(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First row of each (camera, track) within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera", "track_id"])


def keyframe_stream(frames: DataFrame, above: float = 30.0, silent_ms: int = 3_600_000) -> DataFrame:
    """``keyframes`` on arriving frames: the state of a camera is its last frame's cells, gone after ``silent_ms`` of silence."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, known = None, None
        if state.exists:
            last, row, col, grey = state.get
            known = pd.DataFrame({"row": row, "col": col, "was": grey})
        out = []
        for frame, now in pd.concat(list(parts)).sort_values("frame").groupby("frame", sort=True):
            if last is not None and frame == last + 1:
                both = now.merge(known, on=["row", "col"])
                change = (both["grey"] - both["was"]).abs().mean() if len(both) else 0.0
                if change > above:
                    out.append((key[0], frame, change))
            last, known = int(frame), now[["row", "col", "grey"]].rename(columns={"grey": "was"})
        state.update((last, known["row"].astype(int).tolist(), known["col"].astype(int).tolist(), known["was"].astype(float).tolist()))
        state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(out, columns=["camera", "frame", "change"])

    return frames.groupBy("camera").applyInPandasWithState(
        run, "camera long, frame long, change double", "last long, row array<long>, col array<long>, grey array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def write_by_date(df: DataFrame, path: str, checkpoint: str, column: str = "ts"):
    """Start a streaming query that appends each batch to Parquet files by date; a repeated batch replaces its own rows."""

    def sink(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("date", F.to_date(column)).withColumn("batch", F.lit(number))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
