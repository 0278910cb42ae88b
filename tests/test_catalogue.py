"""Every analytics query with SQL, against DuckDB over the smallest tables."""

import duckdb
import pytest

from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    flat = frame[columns].astype(object)
    flat = flat.where(flat.notna(), None)
    return columns, sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in flat.values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_sample_is_bounded(spark):
    assert catalogue.QUERIES["q32_sample"](spark, SF, 500).count() == 100
    assert catalogue.QUERIES["q32_sample"](spark, SF, -1).count() == 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
