"""Every query of the catalogue beside its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from driftlog.plans.every import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df) -> list[str]:
    """Rows as sorted texts, doubles to 6 digits."""
    columns = sorted(df.columns)

    def text(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{round(float(v), 6) + 0.0:.6f}"
        return f"{float(v):.6f}" if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__.startswith("int") else str(v)

    return sorted("|".join(text(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_only_the_seeded_bootstrap_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"bootstrap_seeded"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 240
    assert set(e.oracle_sql()) <= set(e.queries())
