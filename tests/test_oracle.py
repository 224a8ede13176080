"""Every registered query against its oracle SQL on the smallest tables; rows-only queries must run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted([tuple(clean(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(cols, cur.fetchall())


# the other rows-only queries are exercised with their own checks in test_models and test_series
@pytest.mark.parametrize("name", ["posts_from_pages", "growth_forecast", "price_lasso", "learning_curve"])
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
