"""Every operator as a named query over the test tables.

The readings are the ``events`` table (see ``readings_from_events``); duplicate
timestamps and bad sensors come from ``lineitem``. Where a check in plain SQL
must not depend on a random forest, a fixed score formula stands in for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetpulse.config import DEFAULT, FEATURES, SENSORS, EngineConfig
from fleetpulse.functions.columns import rounded, sensor_label
from fleetpulse.operators import clean, diagnostics, evaluate, explain, layout, policy
from fleetpulse.operators.features import drop_counts
from fleetpulse.operators.forecast import horizon_column, slope_significant
from fleetpulse.operators.forest import score_rows
from fleetpulse.operators.health import CALIBRATION_SCHEMA, calibrate, health_summary, pick_calibration
from fleetpulse.plans import evaluation, monitoring, recalibration, training
from fleetpulse.plans.building import build_features
from fleetpulse.session import materialize, scratch_folder, ship, tune
from fleetpulse.sources.readings import READING_SCHEMA, read_new_rows, read_pages, readings_from_events, stream_table
from fleetpulse.sources.registry import Model
from fleetpulse.sources.signature import table_signature
from fleetpulse.streaming import monitor as streaming
from fleetpulse.streaming.sink import BatchLog

# The stand-in score and its calibration; oracles.py states the same formula.
SCORE_BASE, SCORE_STEP = -0.44, 0.0653719
MEAN, STD = -0.44, 0.05
COMMISSIONING_ROWS = 500
LONG_COMMISSIONING_ROWS = 1500
MIN_CALIBRATION_ROWS = 1000
STREAM_CUTS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
# Every asset counts as hot and is cut into many blocks; the results are the same.
HOT = replace(DEFAULT, hot_rows=500, block_rows=400)
REDUNDANT_ABOVE = 0.6
NEW_ROWS_AFTER = "2024-01-10 00:00:00"
DIGITS = 6

# Five small trees, as (tree, node, feature, threshold, left, right, rows, depth).
FIXED_TREES = [
    (0, 0, "vibration_mean", 2.00001, 1, 2, 16, 0),
    (0, 1, "temperature_std", 11.0, 3, 4, 9, 1),
    (0, 2, None, 0.0, -1, -1, 7, 1),
    (0, 3, None, 0.0, -1, -1, 4, 2),
    (0, 4, None, 0.0, -1, -1, 5, 2),
    (1, 0, "current_rms", 3.0, 1, 2, 16, 0),
    (1, 1, None, 0.0, -1, -1, 12, 1),
    (1, 2, "current_skew", 0.1, 3, 4, 4, 1),
    (1, 3, None, 0.0, -1, -1, 2, 2),
    (1, 4, None, 0.0, -1, -1, 2, 2),
    (2, 0, "vibration_crest_factor", 2.2, 1, 2, 16, 0),
    (2, 1, "vibration_min", 0.2, 3, 4, 15, 1),
    (2, 2, None, 0.0, -1, -1, 1, 1),
    (2, 3, None, 0.0, -1, -1, 14, 2),
    (2, 4, None, 0.0, -1, -1, 1, 2),
    (3, 0, "temperature_trend_slope", 0.0137, 1, 2, 16, 0),
    (3, 1, None, 0.0, -1, -1, 8, 1),
    (3, 2, "vibration_current_corr", 0.05, 3, 4, 8, 1),
    (3, 3, None, 0.0, -1, -1, 3, 2),
    (3, 4, None, 0.0, -1, -1, 5, 2),
    (4, 0, "vibration_kurtosis", 1.5, 1, 2, 16, 0),
    (4, 1, None, 0.0, -1, -1, 10, 1),
    (4, 2, "temperature_max", 55.5, 3, 4, 6, 1),
    (4, 3, None, 0.0, -1, -1, 5, 2),
    (4, 4, None, 0.0, -1, -1, 1, 2),
]


def fixed_nodes() -> pd.DataFrame:
    rows = [(t, n, -1 if f is None else FEATURES.index(f), thr, l, r, k, d) for t, n, f, thr, l, r, k, d in FIXED_TREES]
    return pd.DataFrame(
        rows, columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "n_samples", "depth"]
    )


def stamp() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")


def six(name: str) -> Column:
    return rounded(F.col(name), DIGITS).alias(name)


def _events(spark: SparkSession, sf: str, labelled: bool = False) -> DataFrame:
    return readings_from_events(ship(tune(spark)), sf, labelled)


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with repeated timestamps, missing and impossible values."""
    return tune(spark).read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("asset_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_quantity") - 5).alias("vibration"),
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_discount") * 100).alias("current"),
        (F.col("l_tax") * 5000 - 60).alias("temperature"),
    )


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return build_features(_events(spark, sf))


def _with_score(features: DataFrame) -> DataFrame:
    return features.withColumn("score", F.lit(SCORE_BASE) - F.lit(SCORE_STEP) * F.greatest(F.lit(0.0), F.col("vibration_mean")))


def _stand_in(spark: SparkSession, sf: str | None = None, local: DataFrame | None = None, features: DataFrame | None = None) -> Model:
    """Model of the stand-in score; feature baselines come from the features, those given or those of ``sf``."""
    pooled = spark.createDataFrame([("pooled", 0, MEAN, STD, {}, {})], CALIBRATION_SCHEMA)
    if sf is not None:
        row = calibrate(_with_score(_features(spark, sf) if features is None else features)).first()
        pooled = spark.createDataFrame([("pooled", row[1], MEAN, STD, row["feat_mean"], row["feat_std"])], CALIBRATION_SCHEMA)
    return Model("stand-in", pd.DataFrame(), pooled, DEFAULT.feature_hash(), 0, local=local)


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return monitoring.decisions(_events(spark, sf), _stand_in(spark), scorer=_with_score)


def _policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Made-to-vary inputs of the rules, computed from each event."""
    user, event = F.col("user_id"), F.col("event_id")
    base = tune(spark).read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("asset_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(user % 97 == 0, F.lit(15.0)).when(user % 50 == 0, F.lit(25.0)).otherwise(F.lit(60.0)).alias("level"),
        (user % 91).cast("int").alias("remaining_days"),
        (user % 211 != 0).alias("trend_trusted"),
        ((F.floor(event / 150) * 37) % 101 / 100.0).alias(horizon_column(1.0)),
    )
    return policy.add_recommendation(layout.index_rows(base, [F.col("ts")], "output"))


def _metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Truths and scores with many ties, computed from each event."""
    labelled = _events(spark, sf, labelled=True)
    return labelled.select(
        "asset_id",
        (F.col("health_status") != "normal").cast("int").alias("y"),
        (F.col("current") >= 3).cast("int").alias("predicted"),
        (F.round(F.col("current") * 20) / 100).alias("risk"),
    )


def _trained(spark: SparkSession, sf: str) -> tuple[Model, DataFrame]:
    features = materialize(_features(spark, sf), "features")
    return training.fit(features, "catalog"), features


# -- cleaning and selection ------------------------------------------------


def clean_readings(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_readings(_dirty(spark, sf)).select("asset_id", stamp(), *[six(s) for s in SENSORS])


def clean_counters(spark: SparkSession, sf: str) -> DataFrame:
    return clean.cleaning_counters(_dirty(spark, sf))


def spec_normal_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.spec_normal(_events(spark, sf)).select("asset_id", stamp(), *[six(s) for s in SENSORS])


def spec_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = clean.spec_pass_rate(_events(spark, sf))
    return rates.select("asset_id", "n_rows", "n_normal", six("pass_rate"), F.col("is_empty").cast("int").alias("is_empty"))


def reference_split(spark: SparkSession, sf: str, rows: int = COMMISSIONING_ROWS) -> DataFrame:
    first, rest = clean.split_commissioning(
        clean.clean_readings(_events(spark, sf)), replace(DEFAULT, commissioning_rows=rows)
    )
    both = first.withColumn("part", F.lit("reference")).unionByName(rest.withColumn("part", F.lit("rest")))
    return both.select("asset_id", stamp(), "part")


def label_problems(spark: SparkSession, sf: str) -> DataFrame:
    raw = _events(spark, sf, labelled=True)
    padded = F.concat(F.lit("  "), F.upper("health_status"), F.lit(" "))
    odd = F.when(F.col("temperature") > 58, F.lit("Unknown ")).otherwise(padded)
    return clean.label_problems(raw.withColumn("health_status", odd))


def label_normalized(spark: SparkSession, sf: str) -> DataFrame:
    raw = _events(spark, sf, labelled=True)
    padded = F.concat(F.lit("  "), F.upper("health_status"), F.lit(" "))
    rows = clean.validate_labels(raw.withColumn("health_status", padded))
    return rows.groupBy("asset_id", "health_status").agg(F.count("*").alias("n_rows"))


def incremental_rows(spark: SparkSession, sf: str) -> DataFrame:
    newer = read_new_rows(_events(spark, sf), F.to_timestamp(F.lit(NEW_ROWS_AFTER)))
    return newer.select("asset_id", stamp(), *[six(s) for s in SENSORS])


def incremental_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table read in pages, on times that many assets share."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("asset_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").cast("double").alias("vibration"), F.lit(0.0).alias("current"), F.lit(0.0).alias("temperature"),
    )
    pages = read_pages(rows, limit=rows.count() // 3 + 1)
    every = reduce(DataFrame.unionByName, pages)
    return every.groupBy("asset_id", stamp()).agg(F.count("*").alias("n_rows"), F.sum("vibration").alias("total"))


def source_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table_signature(_events(spark, sf))


# -- features --------------------------------------------------------------


def _feature_query(*stats: str, cfg: EngineConfig = DEFAULT) -> Callable[[SparkSession, str], DataFrame]:
    names = [f for f in FEATURES if any(f.endswith("_" + s) for s in stats)]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return build_features(_events(spark, sf), cfg).select("asset_id", stamp(), "tick", *[six(n) for n in names])

    return query


def feature_drop_counts(spark: SparkSession, sf: str) -> DataFrame:
    readings = _events(spark, sf)
    return drop_counts(readings, build_features(readings))


def _membership(index: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        readings = clean.clean_readings(_events(spark, sf))
        parts = clean.split_by_membership(_features(spark, sf), clean.spec_normal(readings))
        return parts[index].select("asset_id", stamp(), six("vibration_mean"), six("vibration_current_corr"))

    return query


def recalibration_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Filter first, then window: windows bridge the rows taken out."""
    rows = build_features(_events(spark, sf), rated_only=True)
    return rows.select("asset_id", stamp(), "tick", six("vibration_mean"), six("temperature_skew"), six("current_trend_slope"))


# -- labels ----------------------------------------------------------------


def next_critical(spark: SparkSession, sf: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    rows = evaluate.next_critical_time(_events(spark, sf, labelled=True).select("asset_id", "ts", "health_status"), cfg)
    text = F.date_format("next_critical", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("next_critical")
    return rows.select("asset_id", stamp(), "health_status", text)


def failure_within_horizon(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.next_critical_time(_events(spark, sf, labelled=True).select("asset_id", "ts", "health_status"))
    flags = [evaluate.fails_within(h).cast("int").alias(n) for h, n in ((0.25, "within_6h"), (0.5, "within_12h"), (1.0, "within_1d"))]
    return rows.select("asset_id", stamp(), *flags)


def label_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = _events(spark, sf, labelled=True).select("asset_id", "ts", "health_status")
    joined = evaluate.align_labels(_features(spark, sf).select("asset_id", "ts", "vibration_mean"), labels)
    return joined.select("asset_id", stamp(), six("vibration_mean"), "health_status")


# -- score, health, calibration --------------------------------------------


def _calibration_rows(rows: DataFrame) -> DataFrame:
    long = rows.select("*", F.explode("feat_mean").alias("feature", "feat_mean_value"))
    return long.select(
        "scope",
        "n_rows",
        six("baseline_mean"),
        six("baseline_std"),
        "feature",
        rounded(F.col("feat_mean_value"), DIGITS).alias("feat_mean"),
        rounded(F.col("feat_std")[F.col("feature")], DIGITS).alias("feat_std"),
    )


def calibrate_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return _calibration_rows(calibrate(_with_score(_features(spark, sf))))


def calibrate_local(spark: SparkSession, sf: str) -> DataFrame:
    return _calibration_rows(calibrate(_with_score(_features(spark, sf)), by_asset=True))


def calibration_pick(spark: SparkSession, sf: str) -> DataFrame:
    scored = _with_score(_features(spark, sf))
    local = calibrate(scored, by_asset=True).filter(F.col("scope") < "q")
    picked = pick_calibration(scored, _stand_in(spark).pooled, local)
    return picked.select("asset_id", stamp(), "calibration_source", six("baseline_mean"), six("baseline_std"))


def health_from_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = monitoring.score(_features(spark, sf), _stand_in(spark), scorer=_with_score)
    return rows.select("asset_id", stamp(), six("score"), rounded(F.col("health_raw"), 9).alias("health_raw"))


def health_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = health_summary(monitoring.score(_features(spark, sf), _stand_in(spark), scorer=_with_score))
    return rows.select("asset_id", "n_rows", *[rounded(F.col(c), 9).alias(c) for c in ("health_min", "health_max")], six("health_mean"))


def forest_score_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return score_rows(_features(spark, sf), fixed_nodes()).select("asset_id", stamp(), six("score"))


def sensor_labels(spark: SparkSession, sf: str) -> DataFrame:
    means = _features(spark, sf).groupBy("asset_id").agg(*[F.avg(f).alias(f) for f in FEATURES])
    long = means.unpivot(["asset_id"], list(FEATURES), "feature", "mean_value")
    return long.select("asset_id", "feature", sensor_label(F.col("feature")).alias("sensor"), six("mean_value"))


def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = pick_calibration(_features(spark, sf), _stand_in(spark, sf).pooled, None)
    return rows.select("asset_id", stamp(), *[rounded(F.expr(explain.z_score(f)), DIGITS).alias(f"z_{f}") for f in FEATURES])


def top_contributors(spark: SparkSession, sf: str) -> DataFrame:
    rows = pick_calibration(_features(spark, sf), _stand_in(spark, sf).pooled, None)
    long = rows.select("asset_id", "ts", F.posexplode(explain.top_contributors()).alias("place", "c"))
    return long.select(
        "asset_id",
        stamp(),
        (F.col("place") + 1).cast("int").alias("place"),
        F.col("c.feature").alias("feature"),
        F.col("c.sensor").alias("sensor"),
        rounded(F.col("c.z"), DIGITS).alias("z"),
    )


def redundant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = diagnostics.redundant_pairs(_features(spark, sf), threshold=REDUNDANT_ABOVE)
    return rows.select("sensor", "feature_a", "feature_b", six("corr"))


# -- smoothing, trend, policy ----------------------------------------------


def kalman_level(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("asset_id", stamp(), "output", six("level"))


def trend_fit(spark: SparkSession, sf: str) -> DataFrame:
    fits = _decisions(spark, sf).select("asset_id", stamp(), "n_fit", six("slope"), six("residual"))
    return fits.filter(F.col("slope").isNotNull())


def trend_significance(spark: SparkSession, sf: str) -> DataFrame:
    d = _decisions(spark, sf)
    return d.select(
        "asset_id",
        stamp(),
        slope_significant().cast("int").alias("significant"),
        F.col("trend_trusted").cast("int").alias("trusted"),
    )


def remaining_days(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("asset_id", stamp(), "remaining_days", "trend_slope_per_day")


def failure_probability(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("asset_id", stamp(), *[horizon_column(h) for h in DEFAULT.horizons])


def recommend(spark: SparkSession, sf: str) -> DataFrame:
    return _policy_rows(spark, sf).select("asset_id", stamp(), "raw_level", "raw_trigger", "raw_reason")


def debounce(spark: SparkSession, sf: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    rows = monitoring.debounce_levels(_policy_rows(spark, sf), cfg)
    return rows.select("asset_id", stamp(), "output", "maintenance_level", "maintenance_trigger", "maintenance_reason")


def _log_form(flat: DataFrame) -> DataFrame:
    dropped = ("asset_id", "ts", "calibration_source", "run_id", "batch_id", "processed_at", *SENSORS)
    return flat.select("asset_id", stamp(), *[c for c in flat.columns if c not in dropped])


def _monitored(spark: SparkSession, sf: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    # Features are built once, for the baselines and for the monitor.
    features = materialize(build_features(_events(spark, sf), cfg), "features")
    model = _stand_in(spark, sf, features=features)
    return monitoring.flatten_predictions(monitoring.monitor_features(features, model, cfg, scorer=_with_score))


def monitor_flat(spark: SparkSession, sf: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The whole batch monitor with the stand-in score, in log form."""
    return _log_form(_monitored(spark, sf, cfg))


# -- evaluation ------------------------------------------------------------


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(_metric_rows(spark, sf), "y", "predicted", by=["asset_id"])


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rates = evaluate.binary_metrics(evaluate.confusion(_metric_rows(spark, sf), "y", "predicted", by=["asset_id"]))
    names = ("precision", "recall", "accuracy", "f1", "false_alarm_rate", "miss_rate")
    return rates.select("asset_id", *[six(n) for n in names])


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ranking_metrics(_metric_rows(spark, sf), "y", "risk").select(six("roc_auc"))


def roc_auc_raw(spark: SparkSession, sf: str) -> DataFrame:
    """On a score far outside [0, 1]: only its order counts."""
    rows = _metric_rows(spark, sf).withColumn("risk", F.col("risk") * 50 - 10)
    return evaluate.ranking_metrics(rows, "y", "risk").select(six("roc_auc"))


def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ranking_metrics(_metric_rows(spark, sf), "y", "risk").select(six("average_precision"))


def brier(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.brier(_metric_rows(spark, sf), "y", "risk").select(six("brier"))


def ece(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.expected_calibration_error(_metric_rows(spark, sf), "y", "risk").select(six("ece"))


def eval_counts(spark: SparkSession, sf: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    labelled = _events(spark, sf, labelled=True)
    flat = evaluation.replay(labelled, _stand_in(spark), cfg, scorer=_with_score)
    return evaluate.dataset_counts(labelled, evaluate.targets(flat, labelled, cfg))


def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The full report of the stand-in monitor."""
    labelled = _events(spark, sf, labelled=True)
    flat = evaluation.replay(labelled, _stand_in(spark), scorer=_with_score)
    return evaluation.evaluate(flat, labelled).select("section", "metric", six("value"))


# -- with the fitted forest ------------------------------------------------


def forest_fit_score(spark: SparkSession, sf: str) -> DataFrame:
    model, features = _trained(spark, sf)
    return monitoring.score(features, model).select("asset_id", stamp(), six("score"), six("health_raw"))


def training_summary(spark: SparkSession, sf: str) -> DataFrame:
    model, features = _trained(spark, sf)
    rows = health_summary(monitoring.score(features, model))
    return rows.select("asset_id", "n_rows", *[rounded(F.col(c), 9).alias(c) for c in ("health_min", "health_max")], six("health_mean"))


def monitor_batch(spark: SparkSession, sf: str) -> DataFrame:
    model, features = _trained(spark, sf)
    return _log_form(monitoring.flatten_predictions(monitoring.monitor_features(features, model)))


def recalibrate_rated(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of every asset with the stand-in score; assets with too few rated rows stay, without anchors."""
    cfg = replace(DEFAULT, min_calibration_rows=MIN_CALIBRATION_ROWS)
    few = F.when(F.col("asset_id") == "view", F.col("vibration") + 2).otherwise(F.col("vibration"))
    report = recalibration.recalibration_report(_events(spark, sf).withColumn("vibration", few), _stand_in(spark), cfg, _with_score)
    return report.select(
        F.col("scope").alias("asset_id"), "n_clean", "n_normal", F.col("eligible").cast("int").alias("eligible"),
        "n_rows", six("baseline_mean"), six("baseline_std"),
        rounded(F.col("feat_mean")["current_rms"], DIGITS).alias("current_rms_mean"),
        rounded(F.col("feat_std")["current_rms"], DIGITS).alias("current_rms_std"),
    )


def recalibrate_fleet(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _trained(spark, sf)
    return _calibration_rows(recalibration.recalibrate(_events(spark, sf), model))


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _trained(spark, sf)
    labelled = _events(spark, sf, labelled=True)
    return evaluation.evaluate(evaluation.replay(labelled, model), labelled).select("section", "metric", six("value"))


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    model, features = _trained(spark, sf)
    rows = diagnostics.reference_features(features, model.reference)
    return diagnostics.permutation_importance(rows, model.nodes, model.n_reference_rows)


def importance_by_sensor(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.importance_by_sensor(permutation_importance(spark, sf))


def top_features(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.top_features(permutation_importance(spark, sf))


def monitor_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events through the stateful monitor, as files arriving in time order.

    A last reading of an asset of its own, a day later, moves the watermark past
    every event; it is too short a history to be predicted itself.
    """
    model, _ = _trained(spark, sf)
    folder = scratch_folder(spark, "stream")
    readings = _events(spark, sf)
    readings.repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    closing = readings.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), *[F.max(s).alias(s) for s in SENSORS])
    closing = closing.select(F.lit("end of input").alias("asset_id"), "ts", *SENSORS)
    closing.write.mode("append").parquet(f"{folder}/in")
    query = streaming.start(
        stream_table(spark, f"{folder}/in", max_files=2),
        model,
        f"{folder}/out",
        f"{folder}/checkpoint",
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return streaming.read_output(spark, f"{folder}/out", "predictions").drop("processed_at").withColumn("ts", stamp())


def _streamed(spark: SparkSession, sf: str, parts: list[DataFrame]) -> str:
    """Folder of the stand-in monitor's output: one run of the stream for each part, all from one checkpoint.

    The last part gets a reading of an asset of its own, a day later, which
    moves the watermark past everything before it.
    """
    folder = scratch_folder(spark, "stream")
    last = _events(spark, sf).agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    closing = last.select(F.lit("end of input").alias("asset_id"), "ts", *[F.lit(1.0).alias(s) for s in SENSORS])
    base, step = SCORE_BASE, SCORE_STEP
    model = _stand_in(spark, sf)
    for part in [*parts[:-1], parts[-1].unionByName(closing)]:
        part.write.mode("append").parquet(f"{folder}/in")
        streaming.start(
            stream_table(spark, f"{folder}/in", max_files=1_000),
            model,
            f"{folder}/out",
            f"{folder}/checkpoint",
            trigger={"availableNow": True},
            scorer=lambda x: base - step * np.maximum(0.0, x[:, FEATURES.index("vibration_mean")]),
        ).awaitTermination()
    return f"{folder}/out"


def _by_time(rows: DataFrame) -> list[DataFrame]:
    """The rows before, between and after two times."""
    first, second = (F.to_timestamp(F.lit(t)) for t in STREAM_CUTS)
    at = F.col("ts")
    return [rows.filter(at < first), rows.filter((at >= first) & (at < second)), rows.filter(at >= second)]


def stream_flat(spark: SparkSession, sf: str) -> DataFrame:
    """All events through the stateful monitor in three runs; equals the batch monitor."""
    out = _streamed(spark, sf, _by_time(_events(spark, sf)))
    return _log_form(streaming.read_output(spark, out, "predictions"))


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that come again in the third run, long after their time."""
    first, second, third = _by_time(_events(spark, sf))
    again = first.filter(F.col("temperature") > 50)
    out = _streamed(spark, sf, [first, second, third.unionByName(again)])
    return streaming.read_output(spark, out, "late").select("asset_id", stamp(), *[six(s) for s in SENSORS], "reason")


def stream_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without an asset, a time or a sensor value, and impossible ones, each with its reason."""
    t = F.col("temperature")
    odd = _events(spark, sf).select(
        F.when(t != 21, F.col("asset_id")).alias("asset_id"),
        F.when(t != 22, F.col("ts")).alias("ts"),
        F.when(t == 23, -1.0).otherwise(F.col("vibration")).alias("vibration"),
        F.when(t != 24, F.col("current")).alias("current"),
        "temperature",
    )
    parts = _by_time(odd)
    parts[0] = parts[0].unionByName(odd.filter(F.col("ts").isNull()))
    out = _streamed(spark, sf, parts)
    return streaming.read_output(spark, out, "invalid").select("asset_id", stamp(), *[six(s) for s in SENSORS], "reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_readings": clean_readings,
    "clean_counters": clean_counters,
    "spec_normal_rows": spec_normal_rows,
    "spec_pass_rate": spec_pass_rate,
    "reference_split": reference_split,
    "label_problems": label_problems,
    "label_normalized": label_normalized,
    "incremental_rows": incremental_rows,
    "incremental_pages": incremental_pages,
    "source_signature": source_signature,
    "reference_split_1500": partial(reference_split, rows=LONG_COMMISSIONING_ROWS),
    "features_all_hot": _feature_query(*{f.split("_", 1)[1] for f in FEATURES}, cfg=HOT),
    "next_critical_hot": partial(next_critical, cfg=HOT),
    "debounce_hot": partial(debounce, cfg=HOT),
    "monitor_flat_hot": partial(monitor_flat, cfg=HOT),
    "eval_counts_hot": partial(eval_counts, cfg=HOT),
    "roc_auc_raw": roc_auc_raw,
    "recalibrate_rated": recalibrate_rated,
    "stream_flat": stream_flat,
    "stream_late": stream_late,
    "stream_invalid": stream_invalid,
    "features_basic": _feature_query("mean", "std", "max", "min", "rms"),
    "features_shape": _feature_query("kurtosis", "skew", "crest_factor"),
    "features_slope": _feature_query("trend_slope"),
    "features_corr": _feature_query("corr"),
    "features_all": _feature_query(*{f.split("_", 1)[1] for f in FEATURES}),
    "feature_drop_counts": feature_drop_counts,
    "recalibration_windows": recalibration_windows,
    "ref_semi": _membership(0),
    "ref_anti": _membership(1),
    "next_critical": next_critical,
    "failure_within_horizon": failure_within_horizon,
    "label_join": label_join,
    "calibrate_pooled": calibrate_pooled,
    "calibrate_local": calibrate_local,
    "calibration_pick": calibration_pick,
    "health_from_score": health_from_score,
    "health_summary": health_summary_query,
    "forest_score_fixed": forest_score_fixed,
    "sensor_labels": sensor_labels,
    "z_scores": z_scores,
    "top_contributors": top_contributors,
    "redundant_pairs": redundant_pairs,
    "kalman_level": kalman_level,
    "trend_fit": trend_fit,
    "trend_significance": trend_significance,
    "remaining_days": remaining_days,
    "failure_probability": failure_probability,
    "recommend": recommend,
    "debounce": debounce,
    "monitor_flat": monitor_flat,
    "confusion": confusion,
    "binary_metrics": binary_metrics,
    "roc_auc": roc_auc,
    "avg_precision": avg_precision,
    "brier": brier,
    "ece": ece,
    "eval_counts": eval_counts,
    "evaluation_metrics": evaluation_metrics,
    "forest_fit_score": forest_fit_score,
    "training_summary": training_summary,
    "monitor_batch": monitor_batch,
    "monitor_stream": monitor_stream,
    "recalibrate_fleet": recalibrate_fleet,
    "evaluation_report": evaluation_report,
    "permutation_importance": permutation_importance,
    "importance_by_sensor": importance_by_sensor,
    "top_features": top_features,
}


def stream_log_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Readings in forty micro-batches, every third repeated as after a failure, merged four at a time."""
    events, folder = _events(spark, sf), scratch_folder(spark, "log")
    parts = F.pmod(F.unix_micros("ts"), F.lit(40))
    events = materialize(events.withColumn("part", parts.cast("int")), "events")
    log = BatchLog(spark, folder, READING_SCHEMA, every=4)
    for i in range(40):
        rows = events.filter(F.col("part") == i).drop("part")
        for _ in range(2 if i % 3 == 0 else 1):
            log.write(rows, i)
    return log.read().select("asset_id", stamp(), *[six(s) for s in SENSORS])


QUERIES["stream_log_merged"] = stream_log_merged
