"""GeoJSON in any layout, cut into blocks of any size, and back."""

import json
import random

import pytest

from fieldloom.sources.geojson import feature_texts, read_geojson, write_features

GEOMETRIES = [
    ("Point", [1.5, 2.0]), ("LineString", [[0.0, 0.0], [1.0, 1.0], [2.0, 0.5]]), ("MultiPoint", [[0.0, 0.0], [3.0, 4.0]]),
    ("Polygon", [[[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 0.0]], [[1.0, 0.5], [2.0, 0.5], [2.0, 1.0], [1.0, 0.5]]]),
    ("MultiLineString", [[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 6.0]]]),
    ("MultiPolygon", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 5.0]], [[5.5, 5.2], [5.6, 5.2], [5.6, 5.3], [5.5, 5.2]]]]),
]
WORDS = ['plain', 'a "quoted" {brace', "back\\slash\\\\", 'ends in \\', "[é ß}", '{"type": "Feature"}', "", "line\nbreak"]
DEPTH = {"Point": 3, "LineString": 2, "MultiPoint": 2, "Polygon": 1, "MultiLineString": 1, "MultiPolygon": 0}


def features(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind, coordinates = rng.choice(GEOMETRIES)
        geometry = {"type": kind, "coordinates": coordinates} if k % 11 else None
        feature = {"type": "Feature", "properties": {"name": rng.choice(WORDS), "size": k, "more": {"list": [{"type": "Feature"}, {}]}}, "geometry": geometry}
        out.append(dict(rng.sample(list(feature.items()), 3)))
    return out


def rows(found):
    out = []
    for k, f in enumerate(found):
        parts = None
        if f["geometry"]:
            parts = f["geometry"]["coordinates"]
            for _ in range(DEPTH[f["geometry"]["type"]]):
                parts = [parts]
        out.append((k, f["properties"]["name"], f["properties"]["size"], f["geometry"] and f["geometry"]["type"], json.dumps(parts)))
    return out


def read(spark, path, block):
    got = read_geojson(spark, str(path), "name string, size long", block)
    assert got.columns == ["fid", "name", "size", "geom_type", "parts"]
    return sorted((r.fid, r.name, r.size, r.geom_type, json.dumps(r.parts)) for r in got.collect())


@pytest.mark.parametrize("layout", ["one line", "pretty", "lines", "type last", "collections a line"])
def test_layouts_and_blocks(spark, tmp_path, layout):
    found = features(60)
    whole = {"type": "FeatureCollection", "name": 'odd " {[ name', "bbox": [0, 0, 1, 1], "crs": {"type": "name", "properties": {"name": "x"}, "l": [{}, [{}]]}, "features": found, "more": {"a": {"b": {}}}}
    text = {
        "one line": json.dumps(whole), "pretty": json.dumps(whole, indent=3), "lines": "\n".join(map(json.dumps, found)) + "\n", "type last": json.dumps({"features": found, "type": "FeatureCollection"}),
        "collections a line": "\n".join(json.dumps({"type": "FeatureCollection", "features": found[k : k + 7]}, ensure_ascii=False) for k in range(0, 60, 7)),
    }[layout]
    path = tmp_path / "layer.geojson"
    path.write_text(text, encoding="utf-8")
    for block in (1 << 25, 4096, 1009):
        if layout == "collections a line" and block < 1 << 25:
            block *= 4  # the first collection must lie in the first block
        assert read(spark, path, block) == rows(found)


def test_every_block_border_is_safe(spark, tmp_path):
    found = features(4, 3)
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": found}, ensure_ascii=False), encoding="utf-8")
    size = path.stat().st_size
    for block in range(size // 9, size // 9 + 24):
        assert read(spark, path, block) == rows(found)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.geojson"
    ring = [[k * 0.25, (k * 7919 % 1000) * 0.5] for k in range(400)]
    with path.open("w") as file:
        file.write('{"type": "FeatureCollection", "features": [\n')
        for k in range(3000):
            file.write((",\n" if k else "") + json.dumps({"type": "Feature", "properties": {"name": "n", "size": k}, "geometry": {"type": "Polygon", "coordinates": [ring + ring[:1]]}}))
        file.write("\n]}")
    got = feature_texts(spark, str(path), 2 << 20)
    assert got.rdd.getNumPartitions() == -(-path.stat().st_size // (2 << 20)) > 8
    assert sorted(r.number for r in got.select("number").collect()) == list(range(3000))


def test_round_trip_of_all_kinds(spark, tmp_path):
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features(40)}))
    first = read_geojson(spark, str(path), "name string, size long")
    write_features(first, str(tmp_path / "out"))
    again = read_geojson(spark, str(tmp_path / "out"), "fid long, name string, size long")
    plain = lambda df: sorted((r.fid, r.name, r.size, r.geom_type, json.dumps(r.parts)) for r in df.collect())
    assert plain(again) == plain(first)


def test_other_values_raise(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "Topology"}\n')
    with pytest.raises(Exception, match="not a GeoJSON feature"):
        read_geojson(spark, str(tmp_path / "a.geojson"), "name string").collect()
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", ')
    with pytest.raises(Exception, match="inside a feature"):
        read_geojson(spark, str(tmp_path / "b.geojson"), "name string").collect()
    with pytest.raises(FileNotFoundError):
        read_geojson(spark, str(tmp_path / "none"), "name string")
