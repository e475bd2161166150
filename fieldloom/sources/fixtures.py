"""Input layers derived from the test tables by integer arithmetic, for Spark and, as CTEs, for the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.operators.polygons import as_parts, with_bounds
from fieldloom.session import table

#: layer -> (table, columns as (expression, name), filter); {d} is integer division.
LAYERS: dict[str, tuple[str, list[tuple[str, str]], str]] = {
    "boxes": (
        "part",
        [
            ("p_partkey", "fid"),
            ("cast((p_partkey * 7919) % 9800 as double) / 10", "x0"),
            ("cast((p_partkey * 104729) % 9800 as double) / 10", "y0"),
            ("cast((p_partkey * 7919) % 9800 as double) / 10 + 2 + p_size % 20", "x1"),
            ("cast((p_partkey * 104729) % 9800 as double) / 10 + 2 + p_partkey % 13", "y1"),
            ("p_brand", "p_brand"),
            ("p_type", "p_type"),
        ],
        "true",
    ),
    "points": (
        "customer",
        [
            ("c_custkey", "pid"),
            ("cast((c_custkey * 7919) % 9973 as double) / 10 + cast(5 as double) / 100", "x"),
            ("cast((c_custkey * 6151) % 9967 as double) / 10 + cast(5 as double) / 100", "y"),
            ("c_mktsegment", "c_mktsegment"),
            ("c_nationkey", "c_nationkey"),
        ],
        "true",
    ),
    "sites": (
        "supplier",
        [
            ("s_suppkey", "sid"),
            ("cast((s_suppkey * 7919) % 9973 as double) / 10 + cast(5 as double) / 100", "x"),
            ("cast((s_suppkey * 6151) % 9967 as double) / 10 + cast(5 as double) / 100", "y"),
        ],
        "true",
    ),
    "zones": (
        "nation",
        [
            ("n_nationkey", "zid"),
            ("cast(n_nationkey % 5 as double) * 200", "x0"),
            ("cast(n_nationkey {d} 5 as double) * 200", "y0"),
            ("cast(n_nationkey % 5 as double) * 200 + 200", "x1"),
            ("cast(n_nationkey {d} 5 as double) * 200 + 200", "y1"),
            ("n_name", "n_name"),
            ("n_regionkey", "n_regionkey"),
        ],
        "true",
    ),
    "raster": (
        "events",
        [
            ("event_id {d} 100", "row"),
            ("event_id % 100", "col"),
            ("case when event_type = 'error' then null else value end", "b1"),
            ("cast(user_id as double)", "b2"),
            ("value + (event_id % 7) * 5", "other"),
        ],
        "true",
    ),
    "classes": (
        "events",
        [
            ("event_id {d} 100", "row"),
            ("event_id % 100", "col"),
            (
                "case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 255 end",
                "truth",
            ),
            (
                "cast(case when event_id % 5 <> 0 and event_type <> 'error' then case event_type when 'click' then 0"
                " when 'view' then 1 when 'purchase' then 2 else 3 end else event_id % 4 end as int)",
                "pred",
            ),
        ],
        "true",
    ),
    "mask": (
        "events",
        [
            ("event_id {d} 100", "row"),
            ("event_id % 100", "col"),
            ("case when value > 50 then 1 else 0 end", "v"),
            ("case when value + (event_id % 7) * 5 > 60 then 1 else 0 end", "w"),
        ],
        "true",
    ),
    "frames": (
        "events",
        [
            ("cast(0 as bigint)", "camera"),
            ("event_id {d} 100", "frame"),
            ("(event_id % 100) {d} 10", "row"),
            ("event_id % 10", "col"),
            ("value % 20 + ((event_id {d} 500) % 2) * 60", "grey"),
        ],
        "true",
    ),
    "stream_log": (
        "events",
        [
            ("user_id % 8", "stream_id"),
            ("ts", "ts"),
            ("case event_type when 'error' then 'error' when 'signup' then 'reconnect' else 'bytes' end", "kind"),
            ("case when event_type in ('error', 'signup') then 0 else 1024 end", "bytes"),
        ],
        "true",
    ),
    "items": (
        "orders",
        [
            ("o_orderkey", "id"),
            ("o_orderstatus", "collection"),
            ("cast(o_orderdate as date)", "dt"),
            ("cast(o_orderkey % 100 as double)", "minx"),
            ("cast(o_custkey % 50 as double)", "miny"),
            ("cast(o_orderkey % 100 + 3 as double)", "maxx"),
            ("cast(o_custkey % 50 + 3 as double)", "maxy"),
            ("case when o_orderkey % 11 = 0 then null else round(cast(o_totalprice as double), 2) % 100 end", "cloud"),
        ],
        "true",
    ),
    "samples": ("documents", [("doc_id", "id"), ("lang", "class")], "true"),
}


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, where = LAYERS[name]
    return table(spark, sf_dir, source).where(where).selectExpr(*[f"{e.format(d='div')} as `{n}`" for e, n in columns])


def cte(*names: str) -> str:
    """``WITH`` clause of the layers, in DuckDB's dialect."""
    parts = []
    for name in names:
        source, columns, where = LAYERS[name]
        parts.append(f'{name} AS (SELECT {", ".join(f"""{e.format(d="//")} AS {n}""" for e, n in columns)} FROM {source} WHERE {where})')
    return "WITH " + ", ".join(parts)


#: Corners of a slanted quadrilateral in a box: turned by its id's angle, three of them pushed in.
_TURN = "radians(cast((fid * 37) % 90 as double) + 0.3)"
_LOCAL = [
    ("-(x1 - x0) / 2", "-(y1 - y0) / 2"),
    ("(x1 - x0) / 2", "(-(y1 - y0) / 2 + (fid % 3) * (y1 - y0) / 12)"),
    ("((x1 - x0) / 2 - (fid % 5) * (x1 - x0) / 20)", "(y1 - y0) / 2"),
    ("-(x1 - x0) / 2", "((y1 - y0) / 2 - (fid % 4) * (y1 - y0) / 16)"),
]
QUAD_CORNERS = [(f"((x0 + x1) / 2 + {u} * cos({_TURN}) - {v} * sin({_TURN}))", f"((y0 + y1) / 2 + {u} * sin({_TURN}) + {v} * cos({_TURN}))") for u, v in _LOCAL]


def _as_polygons(df: DataFrame, corners: list[tuple[str, str]], key: str) -> DataFrame:
    points = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in [*corners, corners[0]])
    ring = df.selectExpr(key, f"array({points}) AS ring")
    return with_bounds(ring.withColumn("parts", as_parts(ring["ring"])))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted quadrilaterals: fid, ring, parts and box columns."""
    return _as_polygons(layer(spark, sf_dir, "boxes"), QUAD_CORNERS, "fid")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower left half of each zone: zid, ring, parts and box columns."""
    return _as_polygons(layer(spark, sf_dir, "zones"), [("x0", "y0"), ("x1", "y0"), ("x0", "y1")], "zid")
