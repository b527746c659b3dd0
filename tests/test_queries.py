"""Every registered query against its SQL oracle on the smallest tables; those without one must give a stable schema."""

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(value, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return round(float(v), 9)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        cur = sql.execute(ORACLES[name])
        assert rows(df.columns, got) == rows([c[0] for c in cur.description], cur.fetchall())


def test_no_cartesian_product_nor_python_in_plans(spark):
    for name in ("facet_search", "jaccard_pairs", "interval_join", "smart_search_topic", "metrics_rollup"):
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name
