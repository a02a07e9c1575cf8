"""Clustered copies of a listing: the same pages as from the listing, from a few of its parts."""

import pytest

from tracklight.functions.scalars import Cursor
from tracklight.operators.library import page
from tracklight.sources.clustered import ClusteredCopy

SCHEMA = "track_id long, duration_ms long, part string"


def listing(spark):
    # a third has one duration, a fifth none
    rows = [(k, None if k % 5 == 0 else 7 if k % 3 == 0 else k * 37 % 400, f"p{k}") for k in range(600)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("sort_by", ["duration_desc", "duration_asc"])
def test_pages_are_those_of_the_listing(spark, tmp_path, sort_by):
    rows, copy = listing(spark), ClusteredCopy(spark, f"{tmp_path}/copy", sort_by)
    copy.put(rows, 24)
    want = [tuple(r) for r in page(rows, sort_by, 1000).collect()]
    assert copy.total() == 600 and [tuple(r) for r in copy.page(1000).collect()] == want
    for offset in (0, 1, 299, 450, 590, 600, 700):
        got = copy.page(20, offset)
        assert [tuple(r) for r in got.collect()] == want[offset : offset + 20], offset
        assert len(got.inputFiles()) <= 4
    for at in (0, 3, 130, 250, 400, 479, 480, 500, 598, 599):
        got = copy.page(20, after=Cursor("duration_ms", want[at][1], want[at][0]))
        assert [tuple(r) for r in got.collect()] == want[at + 1 : at + 21], at
        assert len(got.inputFiles()) <= 4
    assert got.columns == rows.columns


def test_versions(spark, tmp_path):
    rows, copy = listing(spark), ClusteredCopy(spark, f"{tmp_path}/copy", "duration_desc")
    with pytest.raises(ValueError, match="no copy"):
        copy.page()
    copy.put(rows.limit(0), 4)
    assert copy.total() == 0 and copy.page().count() == 0 and copy.page(after=Cursor("duration_ms", 3, 1)).columns == rows.columns
    copy.put(rows, 4)
    reader = copy.page(5)
    # one that broke off before its index isn't seen, and is no obstacle
    rows.limit(9).write.parquet(f"{tmp_path}/copy/v3/rows")
    assert copy.total() == 600
    copy.put(rows.where("track_id < 100"), 4)
    assert copy.total() == 100 and reader.count() == 5
