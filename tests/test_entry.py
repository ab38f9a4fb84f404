"""The registered queries, over the smallest tables and against their SQL where there is any."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
TABLES = sorted(p.stem for p in Path(DATA).glob("*.parquet"))


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else float(x) if isinstance(x, Decimal) else x


def test_entry_yields_rows(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(expected.columns)
    got = got.select(*expected.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)


def test_p1_keeps_every_copy_and_only_measurements(spark):
    got = [r.claim_id for r in e.queries()["p1_found"](spark, DATA).collect()]
    ids = {r.id for r in spark.read.parquet(f"{DATA}/claims.parquet").filter("claim_type = 'measurement'").collect()}
    assert len(got) == len(set(got)) and set(got) <= ids and len(got) > len(ids) // 2


def test_every_query_without_sql_yields_rows(spark):
    for name in sorted(set(e.queries()) - set(e.oracle_sql())):
        assert e.queries()[name](spark, DATA).columns
