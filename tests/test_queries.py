"""Every query of the engine against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from rulemill.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in rel.fetchall()), key=str)
