"""Every registered query with an oracle gives DuckDB's rows on the small tables; the others run and give rows."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from fieldloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return repr(value) if not math.isfinite(value) else round(value, 5)
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


def ordered(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows or name == "merge_tile_features"
        return
    result = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(result.columns)
    assert ordered(rows, df.columns, names) == ordered(result.fetchall(), list(result.columns), names)
