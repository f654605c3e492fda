"""Incremental rebuilds of the feature table equal whole builds."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT, FEATURES
from fleetpulse.plans.building import build_features
from fleetpulse.sources.feature_cache import FeatureCache, Refresh, plan_days
from fleetpulse.sources.readings import READING_SCHEMA
from helpers import minute


def table(spark, rows):
    return spark.createDataFrame(rows, READING_SCHEMA)


def fleet_rows(days=12, per_day=20, assets=("a", "b", None)):
    rng = np.random.default_rng(1)
    return [
        (a, minute(d * 1440 + i * 7), *map(float, rng.normal(10, 2, 3)))
        for a in assets for d in range(days) for i in range(4 if a == "b" and 3 <= d <= 7 else per_day)
    ]


def same_as_whole(cache, df):
    want = build_features(df).select("asset_id", "ts", "tick", *FEATURES).toPandas()
    got = cache.read().select("asset_id", "ts", "tick", *FEATURES).toPandas()
    key = ["asset_id", "ts"]
    want, got = (x.sort_values(key).reset_index(drop=True) for x in (want, got))
    assert want[["asset_id", "ts", "tick"]].equals(got[["asset_id", "ts", "tick"]])
    np.testing.assert_allclose(want[list(FEATURES)], got[list(FEATURES)], rtol=1e-12)


def test_only_changed_days_and_the_readings_after_them_are_rebuilt(spark, tmp_path):
    rows = fleet_rows()
    cache = FeatureCache(spark, f"{tmp_path}/cache", most_segments=3)
    assert cache.refresh(table(spark, rows)) == Refresh(36, 36, 36, 36)
    same_as_whole(cache, table(spark, rows))
    assert cache.refresh(table(spark, rows[::-1])) == Refresh(36, 0, 0, 0)

    # One value: its day and the next one; the day before is read for the first windows.
    at = next(i for i, r in enumerate(rows) if r[0] == "a" and r[1] == minute(5 * 1440 + 7 * 19))
    rows[at] = (*rows[at][:2], 11.0, 11.0, 11.0)
    assert cache.refresh(table(spark, rows)) == Refresh(36, 1, 2, 3)
    same_as_whole(cache, table(spark, rows))

    # A short day of four readings: the next two days still look back on it.
    rows = [r for r in rows if not (r[0] == "b" and r[1] == minute(3 * 1440))]
    done = cache.refresh(table(spark, rows))
    assert (done.n_changed, done.n_rebuilt) == (1, 4) and done.n_read == 5
    same_as_whole(cache, table(spark, rows))

    # A day that goes moves every later tick; a new asset, a repeated and an impossible reading.
    rows = [r for r in rows if not (r[0] is None and minute(2 * 1440) <= r[1] < minute(3 * 1440))]
    rows += [("new", minute(i), 1.0 + i % 3, 2.0 + i % 5, 30.0 + i % 7) for i in range(30)]
    rows += [(*rows[0][:2], 99.0, 99.0, 99.0), ("a", minute(8 * 1440 + 3), -1.0, 1.0, 1.0)]
    done = cache.refresh(table(spark, rows))
    assert (done.n_days, done.n_changed, done.n_rebuilt) == (36, 2, 2)
    same_as_whole(cache, table(spark, rows))
    names = {p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")}
    assert len([n for n in names if n.startswith("segment=")]) <= 3 and len([n for n in names if n.startswith("features-")]) == 1


def test_another_feature_definition_and_a_refresh_that_stops(spark, tmp_path, monkeypatch):
    rows = fleet_rows(days=3, assets=("a",))
    cache = FeatureCache(spark, f"{tmp_path}/cache")
    cache.refresh(table(spark, rows))
    moved = [(a, t, v + 1, c, k) for a, t, v, c, k in rows]
    with monkeypatch.context() as m:
        m.setattr(cache.folder, "write", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            cache.refresh(table(spark, moved))
    same_as_whole(cache, table(spark, rows))
    assert cache.refresh(table(spark, moved)).n_rebuilt == 3
    same_as_whole(cache, table(spark, moved))
    other = FeatureCache(spark, f"{tmp_path}/cache", replace(DEFAULT, window_rows=8))
    assert other.refresh(table(spark, moved)).n_rebuilt == 3
    assert other.read().count() == build_features(table(spark, moved), replace(DEFAULT, window_rows=8)).count()


def test_planned_days(spark):
    """Counts decide how far a change reaches, over gaps and short days."""
    kind = "asset_id string, day date, n long, digest_sum string, digest_xor long"
    day = lambda d, n, x: ("a", np.datetime64("2024-01-01") + d, n, x, 0)
    rows = lambda items: spark.createDataFrame([(a, d.item(), n, x, z) for a, d, n, x, z in items], kind)
    stored = rows([day(0, 3, "s"), day(1, 3, "s"), day(2, 3, "s"), day(5, 2, "s"), day(6, 20, "s"), day(7, 20, "s")]).withColumn("segment", F.lit(1))
    now = rows([day(0, 3, "s"), day(1, 3, "new"), day(2, 3, "s"), day(5, 2, "s"), day(6, 20, "s"), day(7, 20, "s")])
    got = {str(r.day)[8:]: (r.changed, r.rebuild, r.needed) for r in plan_days(now, stored, 9).collect()}
    off, reads, builds = (False, False, False), (False, False, True), (False, True, True)
    assert got == {"01": reads, "02": (True, True, True), "03": builds, "06": builds, "07": builds, "08": off}


def test_empty(spark, tmp_path):
    cache = FeatureCache(spark, f"{tmp_path}/cache")
    assert cache.refresh(table(spark, [])) == Refresh(0, 0, 0, 0)
    with pytest.raises(ValueError, match="refresh first"):
        cache.read()
