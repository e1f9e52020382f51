"""Registered queries against their SQL in DuckDB, at the smallest size."""

import math
import os

import pytest

from lakeloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The document queries that are slow in DuckDB are compared by the driver.
NAMES = [n for n in catalog.ORACLES if n not in ("doc_char_shingles", "doc_sig_similarity", "doc_verify")]


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["graph_pagerank_converged", "ts_pacf_long", "ts_adf_lags", "ts_ar5", "ts_forecast", "km_fit", "forest_importance"])
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
