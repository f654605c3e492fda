"""Trend of the smoothed health, remaining days, failure probability.

The line is fitted to the last ``lookback`` outputs of every row.  Re-adding 720
values per row would cost 720 times the data, and differences of ever-growing
sums lose digits.  Instead the outputs are cut into chunks of ``lookback`` rows:
any window is the tail of one chunk plus the head of the next, both available
as running sums taken from the boundary between the two chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, MINUTES_PER_DAY, EngineConfig
from fleetpulse.functions.columns import clip, normal_cdf, rounded

PARTS = ("n", "x", "y", "xx", "xy", "yy")
TINY_RESIDUAL = 1e-9
MIN_RESIDUAL = 1e-6
FLAT_SLOPE = -1e-6
NO_RISK = -1e9


def _running_sums(d: DataFrame, w, prefix: str, x: str, y: str) -> DataFrame:
    """Running sums over ``w``, measured from the first row of ``w``."""
    d = d.withColumn(f"{prefix}_x0", F.first(x).over(w)).withColumn(f"{prefix}_y0", F.first(y).over(w))
    dx = (F.col(x) - F.col(f"{prefix}_x0")).cast("double")
    dy = F.col(y) - F.col(f"{prefix}_y0")
    terms = {"n": F.lit(1.0), "x": dx, "y": dy, "xx": dx * dx, "xy": dx * dy, "yy": dy * dy}
    return d.select("*", *[F.sum(t).over(w).alias(f"{prefix}_{k}") for k, t in terms.items()])


def fit_trend(
    df: DataFrame,
    keys: Sequence[str] = ("asset_id",),
    x: str = "tick",
    y: str = "level",
    index: str = "output",
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Add n_fit, slope, intercept, residual (population std) and sxx.

    All are NULL until ``min_points`` outputs exist.
    """
    keys, size = list(keys), cfg.lookback
    base = df.columns
    d = df.withColumn("chunk", F.floor((F.col(index) - 1) / F.lit(size)).cast("long"))
    chunk = W.partitionBy(*keys, "chunk")
    grow = (W.unboundedPreceding, 0)
    d = _running_sums(d, chunk.orderBy(F.desc(index)).rowsBetween(*grow), "tail", x, y)
    tail = F.struct(*[F.col(f"tail_{k}").alias(k) for k in (*PARTS, "x0", "y0")])
    d = d.select(*base, "chunk", tail.alias("tail"))
    d = _running_sums(d, chunk.orderBy(index).rowsBetween(*grow), "head", x, y)
    ordered = W.partitionBy(*keys).orderBy("chunk", index)
    d = d.withColumn("past", F.lag("tail", size - 1).over(ordered))

    # tail of the previous chunk, moved to the origin of this chunk's head
    sx, sy = "(past.x0 - head_x0)", "(past.y0 - head_y0)"
    moved = {
        "n": "past.n",
        "x": f"past.x + past.n * {sx}",
        "y": f"past.y + past.n * {sy}",
        "xx": f"past.xx + 2 * {sx} * past.x + past.n * {sx} * {sx}",
        "xy": f"past.xy + {sx} * past.y + {sy} * past.x + past.n * {sx} * {sy}",
        "yy": f"past.yy + 2 * {sy} * past.y + past.n * {sy} * {sy}",
    }
    from_past = f"past IS NOT NULL AND head_n < {size}"
    d = d.selectExpr(
        *base,
        "double(head_x0) AS x0",
        "head_y0 AS y0",
        *[f"head_{k} + CASE WHEN {from_past} THEN {moved[k]} ELSE 0.0D END AS s_{k}" for k in PARTS],
    )
    d = d.selectExpr(
        *base,
        "bigint(s_n) AS n_fit",
        "x0 + s_x / s_n AS x_mean",
        "y0 + s_y / s_n AS y_mean",
        "s_xx - s_x * s_x / s_n AS sxx",
        "s_xy - s_x * s_y / s_n AS sxy",
        "s_yy - s_y * s_y / s_n AS syy",
    )
    fitted = F.col("n_fit") >= cfg.min_points
    d = d.withColumn("slope", F.when(fitted, F.try_divide("sxy", "sxx")))
    spread = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.col("n_fit"))
    residual = F.when(spread < TINY_RESIDUAL, F.lit(MIN_RESIDUAL)).otherwise(spread)
    d = d.withColumn("residual", F.when(F.col("slope").isNotNull(), residual))
    d = d.withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
    return d.select(*base, "n_fit", "slope", "intercept", "residual", "sxx")


def slope_significant(cfg: EngineConfig = DEFAULT) -> Column:
    """|slope| is at least ``slope_z`` of its standard errors; degenerate: no."""
    n = F.col("n_fit")
    error = F.col("residual") * F.sqrt(n / F.greatest(n - 2, F.lit(1))) / F.sqrt(F.col("sxx"))
    z = F.abs(F.try_divide(F.col("slope"), error))
    usable = F.col("slope").isNotNull() & (n > 2) & (F.col("sxx") > 0)
    return F.coalesce(F.when(usable, z >= cfg.slope_z), F.lit(False))


def remaining_days(level: Column, slope: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Whole days until the level crosses the failed threshold at this slope."""
    days = F.try_divide(F.lit(cfg.health_failed) - level, slope) / MINUTES_PER_DAY
    falling = clip(days, 1.0, float(cfg.max_days)).cast("int")
    return (
        F.when(level <= cfg.health_failed, F.lit(0))
        .when(slope >= FLAT_SLOPE, F.lit(cfg.max_days))
        .otherwise(falling)
    )


def crossing_score(level: Column, slope: Column, residual: Column, days: float, cfg: EngineConfig = DEFAULT) -> Column:
    """Standardised distance of the expected level below the failed threshold.

    Random walk with drift: uncertainty grows with the square root of time. The
    normal distribution function of it is the failure probability.
    """
    minutes = days * MINUTES_PER_DAY
    expected = level + slope * minutes
    return F.try_divide(F.lit(cfg.health_failed) - expected, residual * max(minutes, 1.0) ** 0.5)


def horizon_column(days: float) -> str:
    """Column name of one horizon; no dots, which Spark reads as nesting."""
    return "fail_prob_" + f"{days:g}".replace(".", "_") + "d"


def add_forecast(df: DataFrame, index: str = "output", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """From the fit: trend_trusted, remaining_days and one column per horizon.

    Before the first fit the values are inert: trusted, no risk, maximum days.
    """
    has_fit = F.col("slope").isNotNull()
    settled = (F.col(index) - (cfg.min_points - 1)) >= cfg.settle_fits
    level, slope, residual = F.col("level"), F.col("slope"), F.col("residual")
    names = [horizon_column(h) for h in cfg.horizons]
    # The distribution function names its argument many times: give it a column.
    d = df.select(
        "*",
        F.when(has_fit, settled & slope_significant(cfg)).otherwise(F.lit(True)).alias("trend_trusted"),
        F.when(has_fit, remaining_days(level, slope, cfg)).otherwise(F.lit(cfg.max_days)).alias("remaining_days"),
        F.coalesce(rounded(slope * MINUTES_PER_DAY, 4), F.lit(0.0)).alias("trend_slope_per_day"),
        *[
            F.coalesce(crossing_score(level, slope, residual, h, cfg), F.lit(NO_RISK)).alias(f"z_{name}")
            for h, name in zip(cfg.horizons, names)
        ],
    )
    risks = [rounded(normal_cdf(f"z_{name}"), 4).alias(name) for name in names]
    return d.select("*", *risks).drop(*[f"z_{name}" for name in names])
