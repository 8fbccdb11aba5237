"""Queries that work on all rows of their tables, in whatever files and order these come."""

import os

import pyarrow.parquet as pq
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def test_math_covers_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert catalog.QUERIES["functions_math_whole"](spark, SF).count() == lines.count()


@pytest.fixture(scope="module")
def dealt(tmp_path_factory):
    """The events in forty-eight files, each of one span of time, the latest first."""
    root = tmp_path_factory.mktemp("dealt")
    rows, folder = pq.read_table(f"{SF}/events.parquet"), root / "events.parquet"
    folder.mkdir()
    size = -(-len(rows) // 48)
    for k in range(48):
        pq.write_table(rows.slice(k * size, size), folder / f"part-{k:02}.parquet")
        os.utime(folder / f"part-{k:02}.parquet", (1_700_000_000 - 60 * k,) * 2)
    return str(root)


@pytest.mark.parametrize("name", ["stream_distinct", "stream_follow_ups", "stream_tumbling", "stream_sessions"])
def test_streams_of_many_files_out_of_time_order(spark, dealt, name):
    whole, got = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (SF, dealt))
    assert got == whole and whole
