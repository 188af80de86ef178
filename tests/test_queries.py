"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from brindle.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, Decimal)):
        return f"{float(v):.10g}"
    return ("nan" if math.isnan(v) else f"{v:.10g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs_and_repeats(spark, name):
    once, twice = (sorted(map(str, QUERIES[name](spark, str(DATA)).collect())) for _ in range(2))
    assert once and once == twice


def test_nan_keys_are_joined_over_all_events(spark):
    ids = {r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").where("event_id % 3 <> 0").select("event_id").collect()}
    got = [r.event_id for r in QUERIES["join_nan_keys_whole"](spark, str(DATA)).collect()]
    assert len(got) == len(ids) and set(got) == ids


def test_whole_tables_are_united(spark):
    rows = sum(spark.read.parquet(f"{DATA}/{x}.parquet").count() for x in ("customer", "supplier"))
    assert QUERIES["union_by_name_whole"](spark, str(DATA)).count() == rows > 98
