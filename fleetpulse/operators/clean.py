"""Cleaning, filters, splits and label checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, LABELS, SENSORS, EngineConfig
from fleetpulse.functions.columns import all_of, nan_to_null, normal_label
from fleetpulse.operators.layout import ASSET

# Range of physically possible readings.
MIN_VIBRATION = 0.0
MIN_CURRENT = 0.0
TEMPERATURE_ABOVE = -50.0
TEMPERATURE_BELOW = 300.0


def reading_order() -> list[Column]:
    """Time, then sensor values: a total order even for repeated timestamps."""
    return [F.asc_nulls_last("ts")] + [F.asc_nulls_last(s) for s in SENSORS]


def parse_time(col: Column, fmt: str | None = None) -> Column:
    """Text to timestamp; what does not parse becomes NULL."""
    return F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)


def sensors_present() -> Column:
    return all_of(F.col(s).isNotNull() & ~F.isnan(s) for s in SENSORS)


def physically_possible() -> Column:
    return (
        (F.col("vibration") >= MIN_VIBRATION)
        & (F.col("current") >= MIN_CURRENT)
        & (F.col("temperature") > TEMPERATURE_ABOVE)
        & (F.col("temperature") < TEMPERATURE_BELOW)
    )


def within_rating(cfg: EngineConfig = DEFAULT) -> Column:
    return all_of(F.col(s) <= limit for s, limit in cfg.sensor_limits.items())


def first_per_timestamp(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Keep one reading per asset and timestamp: the smallest by sensor order.

    A minimum combines before the shuffle, so many copies of one timestamp do
    not meet in one task.  Missing values sort last.
    """
    ranked = F.struct(*[x for s in SENSORS for x in (F.col(s).isNull().alias(f"no_{s}"), F.col(s))])
    counted = [F.count("*").alias(copies)] if copies else []
    best = df.groupBy(ASSET, "ts").agg(F.min(ranked).alias("best"), *counted)
    return best.select(ASSET, "ts", *[F.col(f"best.{s}").alias(s) for s in SENSORS], *([copies] if copies else []))


def clean_readings(readings: DataFrame) -> DataFrame:
    """De-duplicate, drop rows with a missing sensor, drop impossible rows."""
    kept = readings.select(ASSET, "ts", *[nan_to_null(F.col(s)).alias(s) for s in SENSORS])
    return first_per_timestamp(kept).filter(sensors_present() & physically_possible())


def clean_sorted(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``clean_readings`` for rows already partitioned by ``keys``.

    The first row of each timestamp is found by looking one row back in the
    order the following windows need anyway: no shuffle of its own.
    """
    back = F.lag("ts").over(W.partitionBy(*keys).orderBy(*reading_order()))
    seen = W.partitionBy(*keys).orderBy(*reading_order())
    marked = readings.withColumn("nth", F.row_number().over(seen)).withColumn("prev_ts", back)
    first = (F.col("nth") == 1) | ~F.col("ts").eqNullSafe(F.col("prev_ts"))
    return marked.filter(first).drop("nth", "prev_ts").filter(sensors_present() & physically_possible())


def cleaning_counters(readings: DataFrame) -> DataFrame:
    """How many rows each cleaning step removes, as one row."""
    values = readings.select(ASSET, "ts", *[nan_to_null(F.col(s)).alias(s) for s in SENSORS])
    unique = first_per_timestamp(values, copies="copies")
    return unique.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_raw"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicate"),
        F.count_if(~sensors_present()).alias("n_missing_sensor"),
        F.count_if(sensors_present() & ~physically_possible()).alias("n_impossible"),
        F.count_if(sensors_present() & physically_possible()).alias("n_clean"),
    )


def split_commissioning(df: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """First ``commissioning_rows`` readings of each asset, and all others.

    Readings are counted by asset and hour, combined before the shuffle; only
    the hour in which an asset reaches the limit is ever sorted.  The time of
    the last kept reading divides the rest, so every row is in one part: rows
    that share that time stay together, rows without a time are in the rest.
    An asset may be NULL; one with fewer readings is kept whole.
    """
    hour = F.date_trunc("hour", F.col("ts"))
    own = [F.col(ASSET).eqNullSafe(F.col("limited")), F.col("at") == F.col("hour")]
    per_hour = df.filter(F.col("ts").isNotNull()).groupBy(F.col(ASSET).alias("limited"), hour.alias("hour")).agg(F.count("*").alias("n"))
    earlier = W.partitionBy("limited").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    per_hour = per_hour.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    full = (F.col("before") < cfg.commissioning_rows) & (F.col("before") + F.col("n") >= cfg.commissioning_rows)
    inside = df.select(ASSET, "ts", hour.alias("at")).join(per_hour.filter(full), own)
    nth = F.row_number().over(W.partitionBy("limited").orderBy("ts"))
    last = inside.withColumn("nth", nth).filter(F.col("before") + F.col("nth") == cfg.commissioning_rows)
    ends = last.select("limited", F.col("ts").alias("until"))
    placed = df.join(ends, own[0], "left")
    kept = F.col("ts").isNotNull() & (F.col("until").isNull() | (F.col("ts") <= F.col("until")))
    return placed.filter(kept).select(*df.columns), placed.filter(~kept).select(*df.columns)


def split_by_membership(features: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature rows whose (asset, time) is, and is not, among ``members``."""
    keys = members.select(ASSET, "ts")
    return features.join(keys, [ASSET, "ts"], "left_semi"), features.join(keys, [ASSET, "ts"], "left_anti")


def spec_normal(readings: DataFrame, cfg: EngineConfig = DEFAULT, limits: DataFrame | None = None) -> DataFrame:
    """Readings inside the rated range, bounds included.

    ``limits(asset_id, vibration_limit, current_limit, temperature_limit)``
    overrides the constants per asset; Spark chooses the join.
    """
    if limits is None:
        return readings.filter(within_rating(cfg))
    joined = readings.join(limits, ASSET, "left")
    ok = all_of(
        F.col(s) <= F.coalesce(F.col(f"{s}_limit"), F.lit(limit)) for s, limit in cfg.sensor_limits.items()
    )
    return joined.filter(ok).select(*readings.columns)


def spec_pass_rate(readings: DataFrame, cfg: EngineConfig = DEFAULT, by: Sequence[str] = (ASSET,)) -> DataFrame:
    """Share of readings inside the rated range, and whether none is."""
    ok = F.coalesce(within_rating(cfg), F.lit(False))
    return readings.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(ok).alias("n_normal"),
        F.avg(ok.cast("double")).alias("pass_rate"),
        (F.count_if(ok) == 0).alias("is_empty"),
    )


def validate_labels(labelled: DataFrame) -> DataFrame:
    """Check columns and label domain; return the rows with normalised labels.

    The domain is checked inside the plan: a label outside it fails the job.
    """
    needed = [ASSET, "ts", *SENSORS, "health_status"]
    missing = [c for c in needed if c not in labelled.columns]
    if missing:
        raise ValueError(f"evaluation needs columns {needed}; missing {missing}")
    label = normal_label(F.col("health_status"))
    problem = F.concat(F.lit("unsupported health_status: "), F.coalesce(label, F.lit("<null>")))
    checked = F.when(label.isin(*LABELS), label).otherwise(F.raise_error(problem))
    return labelled.withColumn("health_status", checked)


def label_problems(labelled: DataFrame) -> DataFrame:
    """Distinct labels outside the allowed set, with their row counts."""
    label = F.coalesce(normal_label(F.col("health_status")), F.lit("<null>"))
    counts = labelled.groupBy(label.alias("label")).agg(F.count("*").alias("n_rows"))
    return counts.filter(~F.col("label").isin(*LABELS))
