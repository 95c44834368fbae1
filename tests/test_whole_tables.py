"""Registered queries do the whole table: equal to their SQL without its id filter, which keeps a part of the rows."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
#: Queries with the id filter of their SQL.
PARTS = dict.fromkeys(["a24_mask_moments", "a25_principal_axis", "a26_half_widths", "g08_near_spherical", "g11_mask_bbox", "g16_mask_iou"], " WHERE l_orderkey % 20 = 0")
PARTS |= {"g17_polygon_runs": " WHERE image % 50 = 0", "t01_natural_sort": " WHERE replicate = 'rep_1'"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def shown(frame) -> list[list[str]]:
    frame = frame[sorted(frame.columns)]
    return sorted(frame.map(lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v).astype(str).values.tolist())


@pytest.mark.parametrize("name", PARTS)
def test_query_is_whole(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = tables.sql(__spark_entry__.oracle_sql()[name].replace(PARTS[name], "")).df()
    assert len(got) == len(want) > 0
    assert shown(got) == shown(want)


def test_every_shape_has_a_mask(spark, tables):
    assert __spark_entry__.queries()["g11_mask_bbox"](spark, SF).count() == tables.execute("SELECT count(*) FROM lineitem").fetchone()[0]


def test_listing_is_by_extension_alone(spark, tables):
    urls = dict(tables.execute("SELECT page_id, url FROM pages").fetchall())
    want = sorted((i, u.rsplit("/", 1)[-1]) for i, u in urls.items() if u.lower().endswith((".jpg", ".jpeg", ".png", ".html")))
    assert sorted(map(tuple, __spark_entry__.queries()["s02_listing"](spark, SF).collect())) == want
