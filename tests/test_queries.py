"""Every query of the catalog runs, and those with SQL agree with it."""

import duckdb
import pandas as pd
import pytest

from rankwright.plans import catalog
from rankwright.session import TABLES


def one(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    v = v.item() if hasattr(v, "item") else v
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def norm(df):
    df = pd.DataFrame({c: [one(v) for v in df[c].tolist()] for c in sorted(df.columns)})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, db, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(norm(got), norm(want))


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).collect()) == 10 * spark.read.parquet(f"{sf}/benchmark.parquet").count()
