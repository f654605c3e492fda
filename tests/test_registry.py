from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT
from fleetpulse.operators import diagnostics
from fleetpulse.plans import recalibration, training
from fleetpulse.plans.building import build_features
from fleetpulse.plans.monitoring import monitor_batch, score
from fleetpulse.sources import registry, signature
from fleetpulse.sources.readings import write_features
from helpers import readings

SMALL = replace(DEFAULT, n_trees=20, tree_sample=64, min_calibration_rows=100)


def fleet(spark, shift=0.0):
    rng = np.random.default_rng(11)
    make = lambda n: np.column_stack([rng.exponential(0.8, n) + shift, 3 + rng.random(n), 30 + 5 * rng.random(n)]).tolist()
    return readings(spark, {"a": make(300), "b": make(250), "c": make(40)})


def test_train_save_load_recalibrate(spark, tmp_path):
    root, df = str(tmp_path), fleet(spark)
    model = training.train(df, "m", SMALL, root)
    loaded = registry.load_model(spark, root, "m", SMALL)
    assert loaded.n_reference_rows == model.n_reference_rows == loaded.reference.count() > 300
    assert loaded.local is None and loaded.features == model.features
    features = build_features(df, SMALL)
    a = score(features, model, SMALL).select("asset_id", "ts", "score").collect()
    b = score(features, loaded, SMALL).select("asset_id", "ts", "score").collect()
    assert sorted(a) == sorted(b)

    local = recalibration.recalibrate(df, loaded, SMALL)
    assert sorted(r["scope"] for r in local.select("scope").collect()) == ["a", "b"]
    eligible = {r["asset_id"]: r["eligible"] for r in recalibration.eligibility(df, SMALL).collect()}
    assert eligible == {"a": True, "b": True, "c": False}
    with pytest.raises(ValueError, match="need 100"):
        recalibration.recalibrate_one(df, "c", loaded, SMALL)
    registry.save_local_calibration(root, "m", local)
    registry.save_local_calibration(root, "m", local.filter("scope = 'a'").withColumn("baseline_mean", F.lit(-0.123)))
    again = registry.load_model(spark, root, "m", SMALL)
    means = {r["scope"]: r["baseline_mean"] for r in again.local.collect()}
    assert means["a"] == -0.123 and set(means) == {"a", "b"}
    sources = monitor_batch(df, again, SMALL).groupBy("asset_id").agg(F.min("calibration_source")).collect()
    assert dict(map(tuple, sources)) == {"a": "local", "b": "local", "c": "pooled (no local)"}

    rows = diagnostics.reference_features(features, again.reference)
    importances = diagnostics.permutation_importance(rows, again.nodes, again.n_reference_rows, repeats=2, cfg=SMALL)
    assert importances.count() == 30 and importances.agg(F.min("importance")).first()[0] >= 0
    assert diagnostics.importance_by_sensor(importances).agg(F.sum("percent")).first()[0] == pytest.approx(100)
    assert diagnostics.top_features(importances).count() == 10


def test_drift_and_missing_model(spark, tmp_path):
    root = str(tmp_path)
    training.train(fleet(spark), "m", SMALL, root)
    with pytest.raises(registry.DriftError):
        registry.load_model(spark, root, "m", replace(SMALL, window_rows=12))
    with pytest.raises(FileNotFoundError):
        registry.load_model(spark, root, "other", SMALL)
    model = registry.load_model(spark, root, "m", SMALL)
    write_features(build_features(fleet(spark)), f"{root}/old", replace(SMALL, window_rows=12))
    with pytest.raises(Exception, match="drift"):
        score(spark.read.parquet(f"{root}/old"), model, SMALL).collect()


def test_reference_is_membership(spark):
    from fleetpulse.operators import clean

    df = fleet(spark)
    features = build_features(df)
    ref, rest = training.reference_rows(features)
    semi, anti = clean.split_by_membership(features, clean.spec_normal(clean.clean_readings(df)))
    assert sorted(ref.select("asset_id", "ts").collect()) == sorted(semi.select("asset_id", "ts").collect())
    assert rest.count() == anti.count() > 0


def test_signature_and_cache(spark, tmp_path):
    root, df = str(tmp_path), fleet(spark)
    sig = signature.source_signature(df)
    assert sig == signature.source_signature(df.repartition(5))
    assert sig != signature.source_signature(df.filter("asset_id <> 'c'"))
    assert sig != signature.source_signature(df, replace(DEFAULT, window_rows=12))
    calls = []

    def build(r):
        calls.append(1)
        return build_features(r)

    assert signature.is_stale(spark, root, sig)
    n = signature.get_or_build(spark, root, df, build).count()
    assert signature.get_or_build(spark, root, df, build).count() == n and len(calls) == 1
    signature.get_or_build(spark, root, fleet(spark, 0.5), build)
    assert len(calls) == 2
