from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT
from fleetpulse.functions.columns import normal_cdf
from fleetpulse.operators import forecast
from fleetpulse.operators.smooth import smooth_health


def series(spark, assets: dict[str, list[float]]):
    rows = [(a, i, i + i // 7, float(h)) for a, hs in assets.items() for i, h in enumerate(hs, 1)]
    return spark.createDataFrame(rows, "asset_id string, emission long, tick long, health_raw double")


def kalman_loop(health, cfg=DEFAULT):
    level, variance = float(np.mean(health[: cfg.seed_readings])), cfg.measurement_var
    out = [level]
    for m in health[cfg.seed_readings :]:
        p = variance + cfg.process_var
        k = p / (p + cfg.measurement_var)
        level, variance = level + k * (m - level), (1 - k) * p
        out.append(level)
    return out


def test_level_known_values(spark):
    rows = smooth_health(series(spark, {"a": [50.0] * 15 + [60.0, 60.0], "short": [1.0] * 14})).orderBy("output").collect()
    assert [r["level"] for r in rows] == pytest.approx([50.0, 55.002776235, 56.671599001], abs=1e-8)


@pytest.mark.parametrize("cfg", [DEFAULT, replace(DEFAULT, process_var=2.0, measurement_var=4.0, seed_readings=3)])
def test_level_equals_loop(spark, cfg):
    rng = np.random.default_rng(1)
    data = {"a": rng.uniform(0, 100, 3000), "b": np.clip(100 - np.arange(2500) * 0.05 + rng.normal(0, 5, 2500), 0, 100), "c": [100.0] * 700}
    got = smooth_health(series(spark, data), cfg=cfg).toPandas()
    for name, hs in data.items():
        levels = got[got.asset_id == name].sort_values("output")["level"].to_numpy()
        np.testing.assert_allclose(levels, kalman_loop(list(hs), cfg), atol=1e-9)


def test_trend_equals_polyfit(spark):
    rng = np.random.default_rng(2)
    n = 2300
    levels = {"a": 80 - np.arange(n) * 0.01 + np.cumsum(rng.normal(0, 0.05, n)), "flat": np.full(800, 100.0)}
    rows = [(k, i, i + i // 7, float(v)) for k, vs in levels.items() for i, v in enumerate(vs, 1)]
    df = spark.createDataFrame(rows, "asset_id string, output long, tick long, level double")
    got = forecast.fit_trend(df).toPandas().set_index(["asset_id", "output"])
    ticks = np.array([i + i // 7 for i in range(1, n + 1)], dtype=float)
    for end in (59, 60, 300, 719, 720, 721, 1440, 1441, 1800, 2300):
        row = got.loc[("a", end)]
        if end < 60:
            assert np.isnan(row["slope"])
            continue
        x, y = ticks[max(0, end - 720) : end], levels["a"][max(0, end - 720) : end]
        slope, intercept = np.polyfit(x, y, 1)
        assert row["slope"] == pytest.approx(slope, abs=1e-11)
        assert row["intercept"] == pytest.approx(intercept, abs=1e-7)
        assert row["residual"] == pytest.approx(np.std(y - slope * x - intercept), abs=1e-10)
        assert row["n_fit"] == min(end, 720)
    assert (got.loc["flat"].loc[60:, "residual"] == 1e-6).all() and (got.loc["flat"].loc[60:, "slope"] == 0).all()


def test_days_probability_significance(spark):
    df = spark.createDataFrame(
        [(50.0, -0.01), (50.0, -1e-7), (20.0, -1.0), (50.0, -10.0), (50.0, 0.5), (99.0, -1e-5)], "level double, slope double"
    )
    days = [r[0] for r in df.select(forecast.remaining_days(F.col("level"), F.col("slope"))).collect()]
    assert days == [2, 90, 0, 1, 90, 90]
    z = {h: forecast.crossing_score(F.lit(50.0), F.lit(-0.02), F.lit(0.5), h).alias(f"z{i}") for i, h in enumerate((1.0, 0.25))}
    p = spark.range(1).select(*z.values()).select(F.round(normal_cdf("z0"), 4), F.round(normal_cdf("z1"), 4)).first()
    assert tuple(p) == (0.4748, 0.0081)
    fits = [(2, 1.0, 1.0, 1.0), (100, 0.1, 1.0, 400.0), (100, 0.01, 1.0, 400.0), (100, 1.0, 1.0, 0.0), (59, None, None, 4.0)]
    sig = spark.createDataFrame(fits, "n_fit long, slope double, residual double, sxx double").select(forecast.slope_significant())
    expected = [False, 0.1 / (math.sqrt(100 / 98) / 20) >= 2, False, False, False]
    assert [r[0] for r in sig.collect()] == expected


def test_before_first_fit(spark):
    df = spark.createDataFrame([(5, 10.0, None, None, None, 5)], "output long, level double, slope double, residual double, sxx double, n_fit long")
    row = forecast.add_forecast(df).first()
    assert (row["trend_trusted"], row["remaining_days"], row["fail_prob_1d"], row["trend_slope_per_day"]) == (True, 90, 0.0, 0.0)
