"""Every registered query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from ionweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"rescore_svm", "rescore_rf", "cascade_search", "similarity_features"}


def rows(df):
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(v)
        if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got.columns)
        return
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
