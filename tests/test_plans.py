"""Every registered geospatial query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from deltagrid import plans

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (bool, np.bool_, int, np.integer, float, np.floating)):
        return int(v) if not isinstance(v, (float, np.floating)) and abs(int(v)) >= 1 << 50 else float(f"{float(v):.6g}")
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    found = rows(plans.QUERIES[name](spark, DIR).toPandas())
    assert found[1]
    assert found == rows(con.sql(plans.ORACLE_SQL[name]).df())
