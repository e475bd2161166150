"""GeoJSON files of any size and layout as tables: one feature a line, or whole collections on one line or many.

A collection is one JSON value, so a reader that starts in the middle knows neither whether it is inside a string nor how
deep. Each block of a file is therefore scanned twice over at once, for both answers to the first question: how the quotes
leave the end of the block, how the depth changes, and how many objects open at each depth. Two small rows a block settle
the state at the start of every block (and the number of its first feature); a second pass cuts out the features that begin
in each block, reading on to their ends. Both passes are tasks over byte ranges; a file is never read by one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTE, _SLASH, _OPEN, _CLOSE = 34, 92, (123, 91), (125, 93)
_BLOCKS = "path string, block int, start long, length long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Local paths, and every scheme that pyarrow knows."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    system, inner = _filesystem(path)
    found = system.get_file_info(inner)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == pafs.FileType.File:
        return [(path, found.size)]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    inside = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in inside if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


def _escaped(data: np.ndarray, at: np.ndarray, before: int) -> np.ndarray:
    """Whether an odd number of backslashes stands before each place; ``before`` of them precede the data."""
    count, live, k = np.zeros(len(at), np.int64), np.ones(len(at), bool), 1
    while live.any():
        place = at - k
        live &= np.where(place >= 0, data[np.maximum(place, 0)] == _SLASH, place >= -before)
        count += live
        k += 1
    return count % 2 == 1


def _signs(data: np.ndarray, inside: bool, before: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, +1 or -1) of brackets outside strings, and whether the end is inside a string."""
    quotes = np.flatnonzero(data == _QUOTE)
    quotes = quotes[~_escaped(data, quotes, before)]
    up, down = (data == _OPEN[0]) | (data == _OPEN[1]), (data == _CLOSE[0]) | (data == _CLOSE[1])
    at = np.flatnonzero(up | down)
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, np.where(up[at], 1, -1), bool((len(quotes) + inside) % 2)


def _slashes(file, start: int) -> int:
    """Backslashes right before a place of a file."""
    count, step = 0, 64
    while start - count > 0:
        begin = max(0, start - count - step)
        file.seek(begin)
        part = file.read(start - count - begin)
        tail = len(part) - len(part.rstrip(b"\\"))
        count += tail
        if tail < len(part):
            break
        step *= 4
    return count


def _in_arrays(data: np.ndarray, at: np.ndarray, step: np.ndarray, depth: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Events at which an object opens at depth ``level``, and whether it does in an array (1), an object (0) or in what has
    opened before the data (-1)."""
    found = np.flatnonzero((step > 0) & (depth == level + 1) & (data[at] == _OPEN[0]))
    around = np.flatnonzero((step > 0) & (depth == level))
    last = np.searchsorted(around, found) - 1
    kind = np.where(last < 0, -1, (data[at[around[np.maximum(last, 0)]]] == _OPEN[1]).astype(int)) if len(around) else np.full(len(found), -1)
    return found, kind


_SUMMARY = "path string, block int, inside boolean, after boolean, step long, levels string, collection boolean"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and answer: state at the end, change of depth, by depth the objects that open and the last bracket around
    them, and the kind of the file."""
    kinds = [("path", pa.string()), ("block", pa.int32()), ("inside", pa.bool_()), ("after", pa.bool_()), ("step", pa.int64()), ("levels", pa.string()), ("collection", pa.bool_())]
    for batch in batches:
        for row in batch.to_pylist():
            system, inner = _filesystem(row["path"])
            with system.open_input_file(inner) as file:
                before = _slashes(file, row["start"])
                file.seek(row["start"])
                data = np.frombuffer(file.read(row["length"]), np.uint8)
            for inside in (False, True):
                at, step, end = _signs(data, inside, before)
                depth = np.cumsum(step)
                levels = {}
                for level in np.unique(depth).tolist() + np.unique(depth[step > 0] - 1).tolist():
                    _, kind = _in_arrays(data, at, step, depth, level)
                    around = np.flatnonzero((step > 0) & (depth == level))
                    levels[level] = [int((kind == 1).sum()), int((kind == -1).sum()), bool(data[at[around[-1]]] == _OPEN[1]) if len(around) else None]
                whole = _is_collection(data, at, step, depth) if row["block"] == 0 and not inside else None
                yield pa.RecordBatch.from_pylist(
                    [{"path": row["path"], "block": row["block"], "inside": inside, "after": end, "step": int(step.sum()), "levels": json.dumps(levels), "collection": whole}], pa.schema(kinds)
                )


def _is_collection(data: np.ndarray, at: np.ndarray, step: np.ndarray, depth: np.ndarray) -> bool:
    """Whether the first value of a file is a collection; of a value longer than a block its ``features`` tell."""
    closed = np.flatnonzero(depth == 0)
    if len(closed):
        value = json.loads(data[at[0] : at[closed[0]] + 1].tobytes())
        return isinstance(value, dict) and value.get("type") == "FeatureCollection"
    arrays = at[(step > 0) & (depth == 2) & (data[at] == _OPEN[1])].tolist()
    return any(re.search(rb'"features"\s*:\s*$', data[max(0, p - 200) : p].tobytes()) for p in arrays)


_CUT = "path string, number long, feature string"


def _cut_features(read_on: int):
    """Features that begin in each block, with the number of each in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, inner = _filesystem(row["path"])
                with system.open_input_file(inner) as file:
                    before = _slashes(file, row["start"])
                    file.seek(row["start"])
                    data = file.read(row["length"])
                    while True:
                        view = np.frombuffer(data, np.uint8)
                        at, step, _ = _signs(view, row["inside"], before)
                        depth = row["depth"] + np.cumsum(step)
                        first, kind = _in_arrays(view, at, step, depth, row["level"])
                        if row["level"]:  # what opens in another member of a collection is no feature
                            first = first[(kind == 1) | ((kind == -1) & row["array"])]
                        ends = np.flatnonzero((step < 0) & (depth == row["level"]) & (view[at] == _CLOSE[0]))
                        first = first[at[first] < row["length"]]
                        place = np.searchsorted(ends, first)
                        if not len(first) or place[-1] < len(ends) or not (more := file.read(read_on)):
                            break
                        data += more  # the last feature goes on
                if len(first) and place[-1] == len(ends):
                    raise ValueError(f"{row['path']} ends inside a feature")
                numbers = row["number"] + np.arange(len(first))
                texts = [data[a : b + 1].decode() for a, b in zip(at[first].tolist(), at[ends[place]].tolist())]
                for k in range(0, len(texts), 1000):
                    part = texts[k : k + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(part)), pa.array(numbers[k : k + 1000]), pa.array(part, pa.string())], ["path", "number", "feature"])

    return run


def feature_texts(spark: SparkSession, path: str, block_bytes: int = 32 << 20) -> DataFrame:
    """(path, number, feature): the JSON text of every feature of a file or folder, with its number in its file from 0.

    Lines of features and collections are told apart by the first value of each file. What is passed through the driver is
    two numbers a block.
    """
    rows = [(f, k, at, min(block_bytes, size - at)) for f, size in _files(path) for k, at in enumerate(range(0, size, block_bytes))]
    if not rows:
        return spark.createDataFrame([], _CUT)
    blocks = spark.createDataFrame(rows, _BLOCKS).repartition(len(rows))
    told = {(r["path"], r["block"], r["inside"]): r for r in blocks.mapInArrow(_summaries, _SUMMARY).collect()}  # two a block
    states, last = [], None
    for f, k, start, length in rows:
        if f != last:
            last, inside, depth, number, array = f, False, 0, 0, False
            level = 2 if told[f, 0, False]["collection"] else 0
        row = told[f, k, inside]
        states.append((f, k, start, length, inside, depth, level, number, array))
        sure, open_, around = json.loads(row["levels"]).get(str(level - depth), (0, 0, None))
        number += sure + (open_ if array or not level else 0)
        array = array if around is None else around
        inside, depth = row["after"], depth + row["step"]
    known = spark.createDataFrame(states, _BLOCKS + ", inside boolean, depth long, level long, number long, array boolean").repartition(len(states))
    return known.mapInArrow(_cut_features(min(block_bytes, 4 << 20)), _CUT)


def read_geojson(spark: SparkSession, path: str, properties: str, block_bytes: int = 32 << 20) -> DataFrame:
    """One row a feature: fid, the given properties, geom_type, parts (rings of [x, y] arrays).

    ``path`` is a file or folder of features one a line, or of collections in any layout; ``properties`` is a DDL schema.
    ``fid`` is the feature's number in its file, unless ``properties`` has a ``fid``. Polygons become one-part
    multipolygons, points and lines one-ring parts; a null geometry, and a geometry collection, has null parts. Values that
    aren't features raise.
    """
    feature = f"type string, properties struct<{properties}>, geometry struct<type:string,coordinates:string>"
    rows = feature_texts(spark, path, block_bytes).select("number", F.from_json("feature", feature).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    nested = F.when(kind == "MultiPolygon", text).when(kind.isin("Polygon", "MultiLineString"), F.concat(F.lit("["), text, F.lit("]")))
    nested = nested.when(kind.isin("LineString", "MultiPoint"), F.concat(F.lit("[["), text, F.lit("]]"))).when(kind == "Point", F.concat(F.lit("[[["), text, F.lit("]]]")))
    sure = F.when(F.col("f.type") == "Feature", F.col("number")).otherwise(F.raise_error(F.lit("not a GeoJSON feature")).cast("long"))
    out = rows.select(sure.alias("fid"), "f.properties.*", kind.alias("geom_type"), F.from_json(nested, "array<array<array<array<double>>>>").alias("parts"))
    names = [c.lower() for c in rows.select("f.properties.*").columns]
    return out if "fid" not in names else rows.select(F.when(sure.isNotNull(), F.col("f.properties")).alias("p"), kind.alias("geom_type"), F.from_json(nested, "array<array<array<array<double>>>>").alias("parts")).select("p.*", "geom_type", "parts")


def _text(value: Column) -> Column:
    """The JSON text of an array."""
    whole = F.to_json(F.struct(value.alias("c")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def write_features(df: DataFrame, path: str, kind: str = "geom_type", parts: str = "parts") -> None:
    """One feature a line from ``read_geojson``'s columns, all other columns as properties; any kind of geometry."""
    p = F.col(parts)
    text = (
        F.when(F.col(kind) == "MultiPolygon", _text(p)).when(F.col(kind).isin("Polygon", "MultiLineString"), _text(p[0]))
        .when(F.col(kind).isin("LineString", "MultiPoint"), _text(p[0][0])).when(F.col(kind) == "Point", _text(p[0][0][0]))
    )
    rest = F.to_json(F.struct(*[c for c in df.columns if c not in (kind, parts)]), {"ignoreNullFields": "false"})
    geometry = F.coalesce(F.concat(F.lit('{"type":"'), F.col(kind), F.lit('","coordinates":'), text, F.lit("}")), F.lit("null"))
    df.select(F.concat(F.lit('{"type":"Feature","properties":'), rest, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value")).write.mode("overwrite").text(path)
