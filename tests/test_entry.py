"""Driver contract and the oracle check at sf0.001 (every registered query)."""

import math

import duckdb
import pytest

from conftest import SF001
import __spark_entry__ as E
from tessera.sources.tables import TABLES, table_path


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "text_clean" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES) == {"measured_run"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    return con


def _canon(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else None
    return v


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted((tuple(_canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = E.oracle_sql()[name]
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    order = [dcols.index(c) for c in cols]
    want = sorted((tuple(_canon(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert got == want
