from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.config import DEFAULT
from fleetpulse.operators import diagnostics, evaluate
from helpers import minute

Y = (0, 0, 1, 1, 0, 1)
P = (0.1, 0.3, 0.3, 0.8, 0.6, 0.9)


def rows(spark, y=Y, p=P):
    return spark.createDataFrame(list(zip(y, map(float, p))), "y int, p double")


def test_known_metrics(spark):
    df = rows(spark)
    auc, ap = evaluate.ranking_metrics(df, "y", "p").first()
    assert (auc, ap) == pytest.approx((0.8333333, 0.8666667), abs=1e-6)
    assert evaluate.brier(df, "y", "p").first()[0] == pytest.approx(1 / 6)
    assert evaluate.expected_calibration_error(df, "y", "p").first()[0] == pytest.approx(0.2333333, abs=1e-6)
    assert [r[0] for r in df.select(evaluate.ece_bin(F.col("p"))).collect()] == [1, 2, 2, 8, 5, 9]
    edges = spark.createDataFrame([(0.0,), (0.7,), (1.0,)], "p double").select(evaluate.ece_bin(F.col("p")))
    assert [r[0] for r in edges.collect()] == [0, 6, 9]


def test_repeated_label_fails_and_columns_stay(spark):
    at = minute(1)
    flat = spark.createDataFrame([("a", at, 1.0)], "asset_id string, ts timestamp, x double")
    schema = "asset_id string, ts timestamp, health_status string, next_critical timestamp"
    labels = spark.createDataFrame([("a", at, "normal", at), ("b", at, "normal", at)], schema)
    assert evaluate.align_labels(flat, labels).first()["next_critical"] == at
    twice = labels.unionByName(labels.filter("asset_id = 'a'"))
    with pytest.raises(Exception, match="not one to one"):
        evaluate.align_labels(flat, twice).collect()


def test_ranking_beyond_the_reach(spark):
    y, p = [1, 0, 1, 0, 1, 0], [900.0, 800.0, 3.5, -70.0, -80.0, -90.0]
    got = evaluate.ranking_metrics(rows(spark, y, p), "y", "p").first()
    pairs = [(a > b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    assert got["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_ranking_by_pairs(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    got = evaluate.ranking_metrics(rows(spark, y.tolist(), p.tolist()), "y", "p").first()
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)


def test_one_class_and_empty_denominators(spark):
    assert tuple(evaluate.ranking_metrics(rows(spark, (1, 1), (0.1, 0.2)), "y", "p").first()) == (None, None)
    df = spark.createDataFrame([(0, 0)], "y int, p int")
    m = evaluate.binary_metrics(evaluate.confusion(df, "y", "p")).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert m["false_alarm_rate"] == 0.0 and m["miss_rate"] is None


def labels(spark, n=300, seed=0):
    kinds = np.random.default_rng(seed).choice(["normal", "warning", "critical"], n, p=[0.9, 0.07, 0.03])
    data = [(a, minute(i), k) for a, off in (("a", 0), ("b", 1)) for i, k in enumerate(np.roll(kinds, off * 50).tolist())]
    return spark.createDataFrame(data, "asset_id string, ts timestamp, health_status string")


def test_next_critical_in_slices(spark):
    df = labels(spark)
    hot = replace(DEFAULT, hot_rows=50, block_rows=40)
    whole, cut = evaluate.next_critical_time(df), evaluate.next_critical_time(df, hot)
    assert sorted(whole.collect(), key=str) == sorted(cut.select(*whole.columns).collect(), key=str)
    all_rows = df.collect()
    for r in whole.filter("asset_id = 'a'").collect():
        later = [x["ts"] for x in all_rows if x["asset_id"] == "a" and x["health_status"] == "critical" and x["ts"] >= r["ts"]]
        assert r["next_critical"] == (min(later) if later else None)


def test_horizon_is_inclusive(spark):
    df = spark.createDataFrame([(minute(0), minute(1440)), (minute(0), minute(1441)), (minute(0), None)], "ts timestamp, next_critical timestamp")
    assert [r[0] for r in df.select(evaluate.fails_within(1.0)).collect()] == [True, False, False]


def test_alignment_is_checked(spark):
    known = labels(spark, 10)
    predictions = known.select("asset_id", "ts")
    assert evaluate.align_labels(predictions, known).count() == 20
    with pytest.raises(Exception, match="not one to one"):
        evaluate.align_labels(predictions, known.union(known.limit(1))).collect()
    with pytest.raises(Exception, match="no label"):
        evaluate.align_labels(predictions, known.filter("asset_id = 'a'")).collect()


def test_redundant_pairs(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    data = np.column_stack([a, a * 2 + 0.01 * rng.normal(size=200), rng.normal(size=200), np.ones(200)])
    names = ["vibration_mean", "vibration_rms", "vibration_skew", "vibration_max"]
    df = spark.createDataFrame(data.tolist(), ", ".join(f"{n} double" for n in names))
    got = diagnostics.redundant_pairs(df, names).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in got] == [("vibration_mean", "vibration_rms")]
    assert got[0]["corr"] == pytest.approx(abs(np.corrcoef(data[:, 0], data[:, 1])[0, 1]))
