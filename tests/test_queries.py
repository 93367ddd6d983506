"""Every query against its SQL in DuckDB, on the driver's smallest tables."""

from __future__ import annotations

import os

import pytest

from notemill.plans import catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(columns, table):
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else list(v) if hasattr(v, "tolist") and hasattr(v, "__len__") else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in table))


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_neighbours_fill_quotas_once(spark, sf):
    got = catalogue.QUERIES["neighbour_fill"](spark, sf).collect()
    assert all(r["n"] == r["n_ids"] for r in got)
    assert all(r["n"] <= 4 for r in got)


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["include_semi"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(toxic,1)" in plan and "n_chars" not in plan
