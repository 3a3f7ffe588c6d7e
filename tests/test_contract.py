"""Driver contract: entry smoke, registry coverage, and a sample of the
oracle comparisons at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from pipework.sources.tables import TABLES
from tests.conftest import SF001

from pipework.plans import catalog

ROWS_ONLY = set()   # every query of the reference's operators has an oracle


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "value" in df.columns


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows):
    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v
    return sorted((tuple(n(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["rt_dwell_p95", "alert_stage_errors", "history_replay", "history_replay_pointer",
                                  "spec_validate", "flow_fanout", "watch_events", "schema_resolve", "increase_10m"])
def test_oracle_sample(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = _norm(df.select(*cols).collect())
    sql = E.oracle_sql()[name]
    want = _norm(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall())
    assert got == want
