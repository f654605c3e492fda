"""Re-anchor the health scale of each asset while keeping the shared forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetpulse.config import DEFAULT, EngineConfig
from fleetpulse.operators.clean import clean_readings, within_rating
from fleetpulse.operators.forest import score_rows
from fleetpulse.operators.health import calibrate
from fleetpulse.operators.layout import ASSET
from fleetpulse.plans.building import build_features
from fleetpulse.plans.monitoring import Scorer
from fleetpulse.session import materialize
from fleetpulse.sources.registry import Model


def eligibility(readings: DataFrame, cfg: EngineConfig = DEFAULT, clean: bool = True) -> DataFrame:
    """Per asset: clean rows, rated rows, and whether they suffice."""
    counts = (clean_readings(readings) if clean else readings).groupBy(ASSET).agg(
        F.count("*").alias("n_clean"), F.count_if(within_rating(cfg)).alias("n_normal")
    )
    return counts.withColumn("eligible", F.col("n_normal") >= cfg.min_calibration_rows)


def recalibration_report(readings: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, scorer: Scorer | None = None) -> DataFrame:
    """Every asset with its clean and rated rows, ``eligible``, and the new anchors where it is.

    Readings are cleaned once and written, filtered, and windows formed from
    what is left. Assets with too few rated readings stay in the result with
    NULL anchors.
    """
    cleaned = materialize(clean_readings(readings), "cleaned")
    features = build_features(cleaned, cfg, clean=False, rated_only=True)
    scored = scorer(features) if scorer else score_rows(features, model.nodes, model.features)
    local = calibrate(scored, by_asset=True, features=model.features)
    assets = eligibility(cleaned, cfg, clean=False).withColumnRenamed(ASSET, "scope")
    joined = assets.join(local, "scope", "left")
    anchors = [F.when(F.col("eligible"), F.col(c)).alias(c) for c in local.columns if c != "scope"]
    return joined.select(*assets.columns, *anchors)


def recalibrate(readings: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, scorer: Scorer | None = None) -> DataFrame:
    """Local calibrations of all assets with enough rated readings, in one job."""
    report = recalibration_report(readings, model, cfg, scorer)
    return report.filter(F.col("eligible") & F.col("n_rows").isNotNull()).drop("n_clean", "n_normal", "eligible")


def recalibrate_one(readings: DataFrame, asset_id: str, model: Model, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The same for one asset; too few rated readings is an error."""
    own = readings.filter(F.col(ASSET) == asset_id)
    row = eligibility(own, cfg).first()
    found = 0 if row is None else row["n_normal"]
    if found < cfg.min_calibration_rows:
        raise ValueError(f"{asset_id}: {found} rated readings, need {cfg.min_calibration_rows}")
    return recalibrate(own, model, cfg)
