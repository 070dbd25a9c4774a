"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from emberline.plans.adapters import BASE_TABLES
from emberline.plans.oracles import all_oracles
from emberline.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "null"
        return v if isinstance(v, str) else repr(float(v) + 0.0)

    names = sorted(df.columns)
    return sorted(tuple(value(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, database, name):
    found = contract.queries()[name](spark, SF_DIR).toPandas()
    expected = database.execute(contract.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found) == canonical(expected)


def test_contract_is_complete():
    assert set(QUERIES) - set(all_oracles()) == {"gbt_scores", "search_history"}
    assert set(all_oracles()) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
