"""Registered queries against the other engine, on the smallest test data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: Every how many-th query this run looks at; the driver compares all of them.
STEP = int(os.environ.get("QUERY_STEP", "6"))
NAMES = [n for n in sorted(entry.oracle_sql()) if not n.startswith(("op", "pipeline"))][::STEP]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def canonical(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return str(v) if isinstance(v, (str, bool)) or hasattr(v, "isoformat") else repr(round(float(v), 6))

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
