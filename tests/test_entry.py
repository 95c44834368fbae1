"""The driver contract: every query runs, and those with SQL agree with it."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in __spark_entry__.queries() if n not in __spark_entry__.LLM_QUERIES)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def shown(frame) -> list[list[str]]:
    frame = frame[sorted(frame.columns)]
    cells = frame.map(lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v).astype(str).replace({"nan": "None", "<NA>": "None"})
    return sorted(cells.values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    if name not in __spark_entry__.oracle_sql():
        assert len(got)
        return
    want = tables.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
