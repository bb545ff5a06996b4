"""Every query with SQL gives the same rows in DuckDB; the others give a stable schema."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cytoframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", [n for n, q in catalogue.QUERIES.items() if q[1]])
def test_same_rows(spark, duck, data, name):
    run, sql = catalogue.QUERIES[name]
    got, want = ordered(run(spark, data).toPandas()), ordered(duck.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head(3).tolist(), want[c][~same].head(3).tolist())


@pytest.mark.parametrize("name", [n for n, q in catalogue.QUERIES.items() if not q[1]])
def test_rows_only(spark, data, name):
    df = catalogue.QUERIES[name][0](spark, data)
    assert df.columns == catalogue.QUERIES[name][0](spark, data).columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["part_no", "n_t", "n_n"]


def test_plans_push_down_and_prune(spark, data):
    from cytoframe.plans.read_queries import count_only

    plan = count_only(spark, data)._jdf.queryExecution().executedPlan().toString()
    # only the two columns that mapping quality is made of are read
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
    assert np.count_nonzero([p in plan for p in ("l_orderkey", "l_linenumber")]) == 2
