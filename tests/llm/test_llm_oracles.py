"""Every query of the subpackage that SQL can express gives DuckDB's rows on the small tables."""

import glob
import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from fieldloom.llm import registry  # noqa: E402
from tests.test_oracles import ordered  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(result.columns)
    assert ordered(df.collect(), df.columns, names) == ordered(result.fetchall(), list(result.columns), names)
