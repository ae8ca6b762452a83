from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from epistola import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    def text(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v).replace(" 00:00:00", "")

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    frame = catalog.QUERIES[name](spark, sf)
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(frame.columns) == sorted(sql.columns)
    assert plain(frame.toPandas()) == plain(sql.df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
