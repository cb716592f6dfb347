"""Every query with an oracle, against DuckDB on the small tables; the rest must run."""

import os

import duckdb
import pytest

from basalt.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def tidy(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(None if v is None or v != v else round(float(v), 4) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    ours, theirs = tidy(registry.QUERIES[name](spark, FOLDER).toPandas()), tidy(duck.sql(registry.ORACLES[name]).df())
    assert ours[0] == theirs[0] and len(ours[1]) == len(theirs[1])
    for a, b in zip(ours[1], theirs[1]):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-4 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    out = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert len(out) and len(set(out.columns)) == len(out.columns)
