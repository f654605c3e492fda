from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT, FEATURES
from fleetpulse.plans.building import build_features
from fleetpulse.streaming.kernel import rolling_features
from helpers import readings

KNOWN = [1, 2, 3, 4, 5, 6, 7, 8, 9, 20]


def test_known_window(spark):
    df = readings(spark, {"a": [(float(v), 1.0 + 0.1 * (i % 3), 20.0 + i) for i, v in enumerate(KNOWN)]})
    (row,) = build_features(df).collect()
    expected = {
        "mean": 6.5, "std": 5.400617249, "rms": 8.276472679, "skew": 1.904544205, "kurtosis": 4.583510204,
        "crest_factor": 2.416488373, "trend_slope": 1.545454545, "max": 20.0, "min": 1.0,
    }
    for stat, value in expected.items():
        assert row[f"vibration_{stat}"] == pytest.approx(value, abs=1e-8)
    assert row["temperature_trend_slope"] == pytest.approx(1.0)
    assert row["tick"] == 10


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.column_stack([rng.exponential(2, 60), rng.normal(4, 0.3, 60), rng.normal(35, 5, 60)])
    got = build_features(readings(spark, {"a": values.tolist()}), clean=False).orderBy("tick").toPandas()
    want, usable = rolling_features(values, 10)
    assert usable.all() and len(got) == 51
    np.testing.assert_allclose(got[list(FEATURES)].to_numpy(), want, atol=1e-11)
    corr = [np.corrcoef(values[i : i + 10, 0], values[i : i + 10, 1])[0, 1] for i in range(51)]
    np.testing.assert_allclose(got["vibration_current_corr"], corr, atol=1e-12)
    slope = [np.polyfit(np.arange(10), values[i : i + 10, 2], 1)[0] for i in range(51)]
    np.testing.assert_allclose(got["temperature_trend_slope"], slope, atol=1e-11)


def test_incomplete_flat_and_missing_windows(spark):
    ramp = [(i * 0.1, 1.0 + i * 0.2, 20.0 + i % 3) for i in range(10)]
    gap = [(0.1 * (i % 4), 1.0 + i * 0.2, 20.0 + i % 3) for i in range(12)]
    gap[11] = (float("nan"), 1.0, 20.0)
    df = readings(spark, {"nine": ramp[:9], "ten": ramp, "flat": [(1.0, 2.0, 30.0)] * 30, "gap": gap})
    rows = build_features(df, clean=False).groupBy("asset_id").agg(F.collect_list("tick").alias("t")).collect()
    assert {r[0]: sorted(r[1]) for r in rows} == {"ten": [10], "gap": [10, 11]}
    zero = readings(spark, {"z": [(0.0, 1.0 + i * 0.2, 20.0 + i % 3) for i in range(10)]})
    assert build_features(zero).count() == 0


def test_filter_before_or_after_windows(spark):
    """A rated-only window bridges an excursion; filtering the result does not."""
    values = [(1.0 + 0.1 * (i % 5), 2.0 + 0.1 * (i % 3), 30.0 + i % 4) for i in range(30)]
    values[15] = (9.0, 2.0, 30.0)
    df = readings(spark, {"a": values})
    whole = build_features(df).filter("vibration <= 3")
    bridged = build_features(df, rated_only=True)
    assert bridged.count() == 20 and whole.count() == 20
    assert bridged.agg(F.max("vibration_max")).first()[0] < 3 < whole.agg(F.max("vibration_max")).first()[0]


def test_one_exchange(spark):
    plan = build_features(readings(spark, {"a": [(1.0, 2.0, 3.0)]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_row_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    df = readings(spark, {k: rng.uniform(0.1, 9, (40, 3)).tolist() for k in "abc"})
    a = build_features(df.coalesce(1)).collect()
    b = build_features(df.repartition(7).orderBy(F.rand(1))).collect()
    assert sorted(a) == sorted(b)
    assert DEFAULT.window_rows == 10
