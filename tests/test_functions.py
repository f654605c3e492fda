from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT, FEATURES, EngineConfig
from fleetpulse.functions.columns import nan_to_null, normal_cdf, normal_cdf_values, sensor_label, sensor_of
from fleetpulse.operators.smooth import gain_table


def test_normal_cdf_matches_erfc(spark):
    zs = [-40.0, -38.0, -9.0, -7.08, -7.07, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.96, 5.0, 7.5, 37.5]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf("z").alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), abs=1e-15)


def test_sensor_names(spark):
    assert sensor_of("current_rms") == "current"
    assert sensor_of("vibration_temperature_corr") == "vibration & temperature"
    assert sensor_of("other") == "other"
    rows = spark.createDataFrame([(f,) for f in (*FEATURES, "other")], "f string")
    assert all(r[1] == sensor_of(r[0]) for r in rows.select("f", sensor_label(F.col("f"))).collect())


def test_nan_becomes_null(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double").select(nan_to_null(F.col("x")))
    assert [r[0] for r in rows.collect()] == [None, 1.0, None]


def test_config():
    assert len(FEATURES) == 30
    gains = gain_table(DEFAULT)
    assert gains[0] == pytest.approx(9.01 / 18.01)
    assert gains[-1] == pytest.approx(DEFAULT.steady_gain, abs=1e-12)
    assert DEFAULT.filter_span == 512
    with pytest.raises(ValueError):
        EngineConfig(confirm_ticks=20)
    assert EngineConfig(window_rows=12).feature_hash() != DEFAULT.feature_hash()
    assert EngineConfig(seed=1).feature_hash() == DEFAULT.feature_hash()


def test_filter_settings_are_checked():
    with pytest.raises(ValueError, match="above 0"):
        replace(DEFAULT, process_var=0.0)
    with pytest.raises(ValueError, match="not steady"):
        gain_table(replace(DEFAULT, process_var=1e-12))


def test_normal_cdf_is_one_formula(spark):
    z = np.linspace(-40.0, 9.0, 400)
    rows = spark.createDataFrame([(float(v),) for v in z], "z double").select(normal_cdf("z").alias("p")).collect()
    np.testing.assert_allclose([r["p"] for r in rows], normal_cdf_values(z), rtol=1e-13)
