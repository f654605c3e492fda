from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT, FEATURES
from fleetpulse.operators import layout
from fleetpulse.operators.features import feature_columns
from fleetpulse.plans import evaluation, training
from fleetpulse.plans.building import build_features
from fleetpulse.plans.monitoring import decisions, flatten_predictions, monitor_batch, monitor_features, write_predictions
from helpers import readings, stand_in

# Short memories, so that small fixtures reach every stage and cross blocks.
QUICK = replace(
    DEFAULT, process_var=1.0, measurement_var=4.0, lookback=40, min_points=10, settle_fits=5, horizons=(0.01, 1.0), slope_z=1.0
)


def fleet(spark, n=900):
    """One asset holds most rows; another is short; all wear down and recover."""
    rng = np.random.default_rng(7)
    t = np.arange(n)
    wear = 1.5 + 1.3 * np.sin(t / 60.0) + rng.exponential(0.3, n)
    big = np.column_stack([wear, 2 + rng.random(n), 30 + 5 * rng.random(n)])
    big[100:112] = big[100]  # flat stretch: ticks pass, nothing is emitted
    return readings(spark, {"big": big.tolist(), "small": big[:120].tolist(), "tiny": big[:12].tolist()})


def scorer(features):
    return features.withColumn("score", -0.44 - 0.07 * F.greatest(F.lit(0.0), F.col("vibration_mean")))


def test_blocks_equal_whole_assets(spark):
    df, model = fleet(spark), stand_in(spark)
    hot = replace(QUICK, hot_rows=200, block_rows=150)
    whole = flatten_predictions(monitor_batch(df, model, QUICK, scorer=scorer), QUICK)
    cut = flatten_predictions(monitor_batch(df, model, hot, scorer=scorer), hot).select(*whole.columns)
    a, b = sorted(whole.collect(), key=str), sorted(cut.collect(), key=str)
    assert a == b
    assert {r["maintenance_level"] for r in a} == {"OK", "WARN", "CRITICAL"}
    assert {r["maintenance_trigger"] for r in a} >= {"trend_probability", "health_threshold", "none"}
    assert {r["asset_id"] for r in a} == {"big", "small"}
    assert all((r["top_contributors"] == "") == (r["maintenance_level"] == "OK") for r in a)


@pytest.mark.parametrize("cfg", [QUICK, replace(QUICK, hot_rows=100, block_rows=150)])
def test_stored_features_give_the_same_predictions(spark, tmp_path, cfg):
    df, model = fleet(spark, 300), stand_in(spark)
    build_features(df, cfg).write.parquet(f"{tmp_path}/features")
    stored = spark.read.parquet(f"{tmp_path}/features")
    whole = flatten_predictions(monitor_batch(df, model, cfg, scorer=scorer), cfg)
    again = flatten_predictions(monitor_features(stored, model, cfg, scorer=scorer), cfg).select(*whole.columns)
    assert sorted(whole.collect(), key=str) == sorted(again.collect(), key=str)


def test_features_are_found_in_a_table(spark):
    table = build_features(fleet(spark, 200))
    assert feature_columns(table) == list(FEATURES)
    odd = table.withColumn("extra", F.lit(1.0))
    assert feature_columns(odd.select(*reversed(odd.columns))) == [*FEATURES, "extra"]
    with pytest.raises(ValueError, match="current_rms"):
        training.fit(table.drop("current_rms"), "m")


def test_prediction_log(spark, tmp_path):
    flat = flatten_predictions(monitor_batch(fleet(spark, 200), stand_in(spark), QUICK, scorer=scorer), QUICK)
    for run in ("one", "two", "two"):
        write_predictions(flat, str(tmp_path), run)
    log = spark.read.parquet(str(tmp_path))
    assert {r["run_id"]: r["count"] for r in log.groupBy("run_id").count().collect()} == {"one": flat.count(), "two": flat.count()}
    assert log.filter("processed_at IS NULL OR ts IS NULL").isEmpty()


def test_warm_up_and_ticks(spark):
    rows = decisions(fleet(spark), stand_in(spark), QUICK, scorer=scorer).filter("asset_id = 'big'").orderBy("output").collect()
    assert rows[0]["tick"] == 24 and rows[0]["output"] == 1
    ticks = [r["tick"] for r in rows]
    assert 110 not in ticks and 111 not in ticks and len(rows) == max(r["output"] for r in rows)


def test_index_rows_in_slices(spark):
    df = fleet(spark).select("asset_id", "ts")
    order = [F.col("ts")]
    a = layout.index_rows(df, order, "i")
    b = layout.index_rows(df, order, "i", replace(QUICK, hot_rows=100, block_rows=64)).select(*a.columns)
    assert sorted(a.collect()) == sorted(b.collect())


def test_evaluation_report(spark):
    labelled = fleet(spark).withColumn("health_status", F.when(F.col("vibration") > 3, "critical").when(F.col("vibration") > 2.5, "warning").otherwise("normal"))
    flat = evaluation.replay(labelled, stand_in(spark), QUICK, scorer=scorer)
    m = {(r["section"], r["metric"]): r["value"] for r in evaluation.evaluate(flat, labelled, QUICK).collect()}
    assert m["dataset", "n_raw"] == 1032 and m["dataset", "n_emitted"] == flat.count()
    assert 0.5 < m["health", "roc_auc"] <= 1
    per = evaluation.per_asset_metrics(flat, labelled, QUICK).collect()
    assert sum(r["tp"] for r in per) == m["health", "tp"]
    with pytest.raises(ValueError, match="warm-up"):
        evaluation.replay(labelled.filter("asset_id = 'tiny'"), stand_in(spark), QUICK, scorer=scorer)
