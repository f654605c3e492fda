"""Readings to predictions in batch: score, smooth, forecast, decide, explain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fleetpulse.config import DEFAULT, EngineConfig
from fleetpulse.functions.columns import rounded
from fleetpulse.operators import explain, layout, policy
from fleetpulse.operators.forecast import add_forecast, fit_trend, horizon_column
from fleetpulse.operators.forest import score_rows
from fleetpulse.operators.health import health_from_score, pick_calibration
from fleetpulse.operators.layout import ASSET
from fleetpulse.operators.smooth import smooth_health
from fleetpulse.plans.building import BLOCK, feature_parts
from fleetpulse.session import materialize, spread
from fleetpulse.sources.readings import check_feature_hash
from fleetpulse.sources.registry import Model

Scorer = Callable[[DataFrame], DataFrame]


def score(features: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, calibration: str = "auto", scorer: Scorer | None = None) -> DataFrame:
    """Add score, health_raw (unrounded) and calibration_source to feature rows."""
    features = check_feature_hash(features, model.feature_hash)
    scored = scorer(features) if scorer else score_rows(features, model.nodes, model.features)
    picked = pick_calibration(scored, model.pooled_row, model.local, calibration)
    health = health_from_score(F.col("score"), F.col("baseline_mean"), F.col("baseline_std"), cfg)
    return picked.select(*scored.columns, health.alias("health_raw"), "calibration_source")


def narrowed(scored: DataFrame, model: Model, cfg: EngineConfig, calibration: str) -> DataFrame:
    """Scored rows without their features: what explains an alert is picked here, before any exchange."""
    rows = pick_calibration(scored.drop("calibration_source"), model.pooled_row, model.local, calibration)
    rows = explain.with_places(rows, "contributors", model.features, cfg)
    kept = [c for c in scored.columns if c not in model.features]
    return rows.select(*kept, "contributors")


def _with_names(decided: DataFrame, model: Model) -> DataFrame:
    """Contributors travel as positions; they get their names behind the last exchange."""
    return decided.withColumn("contributors", explain.named_places(F.col("contributors"), model.features))


def _decide(scored: DataFrame, keys: list[str], cfg: EngineConfig) -> DataFrame:
    """From emissions to raw recommendations and streaks, per window partition."""
    d = smooth_health(scored, keys, "emission", "health_raw", cfg)
    d = add_forecast(fit_trend(d, keys, "tick", "level", "output", cfg), "output", cfg)
    return policy.streaks(policy.add_recommendation(d, cfg), keys, "output", cfg)


def _cold(features: DataFrame, add_score: Scorer, cfg: EngineConfig) -> DataFrame:
    # A Python stage forgets how rows were partitioned, so assets are exchanged
    # once more behind it; every window after that shares the one exchange. The
    # narrow scored rows are written once: what follows plans and recovers alone.
    scored = materialize(add_score(features), "scored")
    d = layout.number_rows(spread(scored, ASSET), [ASSET], [F.col("tick")], "emission")
    return policy.report_levels(_decide(d, [ASSET], cfg), cfg)


def _hot(features: DataFrame, add_score: Scorer, cfg: EngineConfig) -> DataFrame:
    scored = materialize(add_score(features), "scored")
    per_block = scored.groupBy(ASSET, BLOCK).agg(F.count("*").alias("n"))
    offsets = layout.running_offsets(per_block, BLOCK, "n", "before")
    d = layout.number_rows(scored, [ASSET, BLOCK], [F.col("tick")], "nth").join(offsets, [ASSET, BLOCK])
    d = d.withColumn("emission", F.col("before") + F.col("nth")).drop("before", "nth", BLOCK)
    d = layout.with_halo(d, "emission", cfg.history_rows, cfg.block_rows)
    d = layout.drop_halo(_decide(spread(d, ASSET, BLOCK), [ASSET, BLOCK], cfg))
    decided = materialize(d, "decided")
    return policy.report_levels(policy.carry_events(decided, BLOCK), cfg).drop(BLOCK)


def decisions(
    readings: DataFrame,
    model: Model,
    cfg: EngineConfig = DEFAULT,
    clean: bool = True,
    calibration: str = "auto",
    scorer: Scorer | None = None,
) -> DataFrame:
    """Every output with its intermediate values, unrounded where they were, and its ``contributors``; no features.

    ``scorer`` replaces the forest by any function adding a ``score`` column.
    """

    def add_score(features: DataFrame) -> DataFrame:
        return narrowed(score(features, model, cfg, calibration, scorer), model, cfg, calibration)

    cold, hot, _ = feature_parts(readings, cfg, clean)
    decided = _cold(cold, add_score, cfg)
    return _with_names(decided if hot is None else decided.unionByName(_hot(hot, add_score, cfg)), model)


def decisions_from_features(
    features: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, calibration: str = "auto", scorer: Scorer | None = None
) -> DataFrame:
    """``decisions`` of a stored feature table: nothing is cleaned or built again.

    The table has ``tick``, the number of each reading within its asset, as
    ``build_features`` and the feature cache give it.
    """

    def add_score(rows: DataFrame) -> DataFrame:
        return narrowed(score(rows, model, cfg, calibration, scorer), model, cfg, calibration)

    split = layout.split_by_heat(features, cfg)
    decided = _cold(split.cold, add_score, cfg)
    if split.hot is None:
        return _with_names(decided, model)
    block = F.floor((F.col("tick") - 1) / F.lit(cfg.block_rows)).cast("long")
    return _with_names(decided.unionByName(_hot(split.hot.withColumn(BLOCK, block), add_score, cfg)), model)


def monitor_features(
    features: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, calibration: str = "auto", scorer: Scorer | None = None
) -> DataFrame:
    """``monitor_batch`` of a stored feature table."""
    return present(decisions_from_features(features, model, cfg, calibration, scorer), model, cfg, calibration)


def monitor_batch(
    readings: DataFrame,
    model: Model,
    cfg: EngineConfig = DEFAULT,
    clean: bool = True,
    calibration: str = "auto",
    scorer: Scorer | None = None,
) -> DataFrame:
    """Predictions for every reading after warm-up, one row per output."""
    return present(decisions(readings, model, cfg, clean, calibration, scorer), model, cfg, calibration)


def debounce_levels(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Hysteresis for rows that already have ``output`` and raw levels."""
    split = layout.split_by_heat(df, cfg)
    cold = policy.debounce(split.cold, [ASSET], "output", cfg)
    if split.hot is None:
        return cold
    d = spread(layout.with_halo(split.hot, "output", cfg.clear_ticks, cfg.block_rows), ASSET, BLOCK)
    d = materialize(layout.drop_halo(policy.streaks(d, [ASSET, BLOCK], "output", cfg)), "streaks")
    hot = policy.report_levels(policy.carry_events(d, BLOCK), cfg)
    return cold.unionByName(hot.drop(BLOCK))


def present(decided: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, calibration: str = "auto") -> DataFrame:
    """Rounded output row with nested probability, maintenance and contributors.

    Rows that carry features instead of ``contributors`` (those of a stream)
    get their baselines here; only alerting rows need them.
    """
    d, why = decided, F.when(F.col("maintenance_level") != "OK", F.col("contributors"))
    if "contributors" not in decided.columns:
        d = pick_calibration(decided.drop("calibration_source"), model.pooled_row, model.local, calibration)
        why = explain.contributors_when_alerting(model.features, cfg)
    risks = [x for h in cfg.horizons for x in (F.lit(float(h)), F.col(horizon_column(h)))]
    return d.select(
        ASSET,
        "ts",
        "tick",
        "vibration",
        "temperature",
        "current",
        rounded(F.col("score"), 5).alias("anomaly_score"),
        rounded(F.col("health_raw"), 2).alias("health_raw"),
        rounded(F.col("level"), 2).alias("health_state"),
        "trend_slope_per_day",
        "remaining_days",
        F.create_map(*risks).alias("failure_probability"),
        F.struct(
            F.col("maintenance_level").alias("level"),
            F.col("maintenance_reason").alias("reason"),
            F.col("maintenance_trigger").alias("trigger"),
        ).alias("maintenance"),
        why.alias("top_contributors"),
        "calibration_source",
    )


def flatten_predictions(predictions: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Log form of predictions: one plain column per nested value."""
    plain = [c for c in predictions.columns if c not in ("failure_probability", "maintenance", "top_contributors")]
    return predictions.select(
        *plain,
        F.col("maintenance.level").alias("maintenance_level"),
        F.col("maintenance.reason").alias("maintenance_reason"),
        F.col("maintenance.trigger").alias("maintenance_trigger"),
        *[F.col("failure_probability")[F.lit(float(h))].alias(horizon_column(h)) for h in cfg.horizons],
        explain.joined_contributors(F.col("top_contributors")).alias("top_contributors"),
    )


def write_predictions(flat: DataFrame, output: str, run_id: str) -> str:
    """Prediction log of one run: a repeated run replaces its own rows only."""
    path = f"{output}/run_id={run_id}"
    flat.withColumn("processed_at", F.current_timestamp()).write.mode("overwrite").parquet(path)
    return path
