"""Every query with an SQL twin gives the twin's rows on the smallest tables; the others run and are not null."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from casegrid.plans import registry

SQL = registry.SQL
#: Queries that find nothing in the smallest tables, and columns that may be null in all rows there.
MAY_BE_EMPTY = {"q8_newest", "q11_newest", "e5_name_similarity", "e8_duplicates", "e9_greedy_merges", "e11_bands"}
MAY_BE_NULL = {"unit", "state", "postal_code", "country", "street_number", "honorific", "diameter", "caller", "callee", "call_type"}
PLAIN = [k for k in registry.QUERIES if k not in SQL]


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat()
    if isinstance(v, datetime.date):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 5)
    return v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, data, db):
    got, want = registry.QUERIES[name](spark, data).toPandas(), db.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", PLAIN)
def test_runs(name, spark, data):
    frame = registry.QUERIES[name](spark, data)
    rows = frame.collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(map(repr, rows))) == len(rows), "repeated rows"
    assert not rows or all(any(r[c] is not None for r in rows) for c in frame.columns if c not in MAY_BE_NULL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["sender_digits", "start_ms", "end_ms", "n_messages"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
