"""Every query that SQL can express equals DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from flowguard.plans import catalog

TABLES = ("lineitem", "orders", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "None"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].apply(lambda c: c.map(plain)).sort_values(columns).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df())


def test_flagship(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert any(r["is_core"] for r in rows) and len(rows) > 1
