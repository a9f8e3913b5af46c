"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert tidy(df.select(*columns).collect()) == tidy(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "shared", "coupling"]


def test_whole_catalog_is_registered():
    assert set(CORE) <= set(entry.queries()) and len(CORE) >= 36
