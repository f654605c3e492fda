"""Calibration of scores and the health percentage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from fleetpulse.config import DEFAULT, FEATURES, EngineConfig
from fleetpulse.functions.columns import clip
from fleetpulse.operators.layout import ASSET

POOLED = "pooled"
ZERO_SPREAD = 1e-6

CALIBRATION_SCHEMA = (
    "scope string, n_rows long, baseline_mean double, baseline_std double, "
    "feat_mean map<string,double>, feat_std map<string,double>"
)


def calibrate(scored: DataFrame, by_asset: bool = False, features: Sequence[str] = FEATURES) -> DataFrame:
    """Anchor of the health scale, and each feature's own mean and spread.

    Scores use the population deviation (0 becomes a tiny spread), features the
    sample deviation (0 becomes missing).  One partially aggregated pass.
    """
    names = F.array(*[F.lit(f) for f in features])
    grouped = scored.groupBy(F.col(ASSET).alias("scope")) if by_asset else scored.groupBy(F.lit(POOLED).alias("scope"))
    spread = F.stddev_pop("score")
    moments = grouped.agg(
        F.count("*").alias("n_rows"),
        F.avg("score").alias("baseline_mean"),
        F.when(spread == 0, F.lit(ZERO_SPREAD)).otherwise(spread).alias("baseline_std"),
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.nullif(F.stddev_samp(f), F.lit(0.0)).alias(f"s_{f}") for f in features],
    )
    return moments.select(
        "scope",
        "n_rows",
        "baseline_mean",
        "baseline_std",
        F.map_from_arrays(names, F.array(*[F.col(f"m_{f}") for f in features])).alias("feat_mean"),
        F.map_from_arrays(names, F.array(*[F.col(f"s_{f}") for f in features])).alias("feat_std"),
    )


def pick_calibration(
    df: DataFrame, pooled: DataFrame | Row, local: DataFrame | None, mode: str = "auto"
) -> DataFrame:
    """Add baseline_mean, baseline_std, feat_mean, feat_std, calibration_source.

    mode ``auto``: the asset's own calibration where there is one, else pooled;
    ``local``: required, a row without one fails the job; ``pooled``: forced.
    The pooled calibration is one row.  Local rows are joined on the asset; the
    join needs no extra shuffle where rows are already partitioned by it.
    """
    if mode not in ("auto", "local", "pooled"):
        raise ValueError(f"unknown calibration mode {mode!r}")
    values = ["baseline_mean", "baseline_std", "feat_mean", "feat_std"]
    row = pooled.select(*values).first() if isinstance(pooled, DataFrame) else pooled
    if row is None:
        raise ValueError("no pooled calibration")
    default = {
        "baseline_mean": F.lit(row["baseline_mean"]).cast("double"),
        "baseline_std": F.lit(row["baseline_std"]).cast("double"),
        "feat_mean": _literal_map(row["feat_mean"]),
        "feat_std": _literal_map(row["feat_std"]),
    }
    if mode == "pooled" or (local is None and mode == "auto"):
        source = "pooled (forced)" if mode == "pooled" else "pooled (no local)"
        return df.select("*", *[default[v].alias(v) for v in values], F.lit(source).alias("calibration_source"))
    if local is None:
        raise ValueError("mode 'local' needs local calibrations")
    own = local.select(F.col("scope").alias(ASSET), *[F.col(v).alias(f"own_{v}") for v in values])
    joined = df.join(own, ASSET, "left")
    has_own = F.col("own_baseline_mean").isNotNull()
    if mode == "local":
        problem = F.concat(F.lit("no local calibration for "), F.col(ASSET))
        source = F.when(has_own, F.lit("local")).otherwise(F.raise_error(problem))
    else:
        source = F.when(has_own, F.lit("local")).otherwise(F.lit("pooled (no local)"))
    return joined.select(
        *df.columns,
        *[F.when(has_own, F.col(f"own_{v}")).otherwise(default[v]).alias(v) for v in values],
        source.alias("calibration_source"),
    )


def _literal_map(values: dict[str, float] | None) -> Column:
    if not values:
        return F.lit(None).cast("map<string,double>")
    pairs = ", ".join(f"'{k}', double('{v!r}')" if v is not None else f"'{k}', double(NULL)" for k, v in values.items())
    return F.expr(f"map({pairs})")


def health_from_score(score: Column, mean: Column, std: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """100 at or above the baseline mean, 0 at ``health_spread`` deviations below."""
    return (1 - clip((mean - score) / (std * cfg.health_spread), 0.0, 1.0)) * 100.0


def health_summary(df: DataFrame, health: str = "health_raw", by: Sequence[str] = (ASSET,)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min(health).alias("health_min"),
        F.max(health).alias("health_max"),
        F.avg(health).alias("health_mean"),
    )
