"""Every query of the catalogue against its DuckDB twin, on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"

from loomgraph.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_twin(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    result = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
