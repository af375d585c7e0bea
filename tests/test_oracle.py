"""Every registered query against another engine's answer on the same files."""

import math

import duckdb
import pytest

from haulage.plans import registry
from haulage.schemas import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows(it):
    return sorted((tuple(norm(v) for v in r) for r in it), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    rel = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = rows(rel.fetchall())
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
