"""Large pages are cut by counts of times, and small blocks do not multiply the slices."""

from __future__ import annotations

import pytest

from fleetpulse.config import SENSORS
from fleetpulse.operators.layout import slice_count
from fleetpulse.sources import readings
from helpers import minute


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 20, 21, 500])
def test_large_page_ends_where_a_small_one_does(spark, monkeypatch, limit):
    rows = [("a", minute(i // 3) if i else None, float(i)) for i in range(20)]
    table = spark.createDataFrame(rows, "asset_id string, ts timestamp, vibration double")
    table = table.selectExpr("*", *[f"vibration AS {s}" for s in SENSORS if s != "vibration"])
    small = [sorted(r.vibration for r in page.collect()) for page in readings.read_pages(table, limit=limit)]
    raw = sorted(r.vibration for r in readings.whole_page(table, "ts", limit).collect())
    first_rows = type(table).limit

    def none_gathered(df, n):
        assert n <= 1  # no task gathers the first rows
        return first_rows(df, n)

    monkeypatch.setattr(readings, "TOP_ROWS", 0)
    monkeypatch.setattr(type(table), "limit", none_gathered)
    large = [sorted(r.vibration for r in page.collect()) for page in readings.read_pages(table, limit=limit)]
    assert small == large and sum(map(len, large)) == 19
    assert sorted(r.vibration for r in readings.whole_page(table, "ts", limit).collect()) == raw


def test_slices_grow_with_rows_not_with_small_blocks():
    assert slice_count(10_000, 400) == 25
    assert slice_count(6_000_000, 400) == 64
    assert slice_count(36_000_000, 400) == 138 == slice_count(36_000_000, 262_144)
    assert slice_count(0, 400) == 1
