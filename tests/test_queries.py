"""Every query with SQL gives DuckDB's rows; the others run."""

import duckdb
import pytest

from agora.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(repr(v.item() if hasattr(v, "item") else v) for v in row) for row in rows.itertuples(index=False))


def test_every_query_has_rows_or_sql():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 70


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
