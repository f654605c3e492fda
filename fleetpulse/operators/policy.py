"""Maintenance rules and their hysteresis.

A health trigger is reported at once.  A trend trigger must repeat
``confirm_ticks`` times in a row to raise the reported level and
``clear_ticks`` times to lower it.

With levels 0, 1, 2 a streak of ``clear_ticks`` sets the reported level and one
of ``confirm_ticks`` raises it to at least its own.  So the reported level is at
least v exactly when the last event raising to v or more came after the last
event setting it below v: two running maxima per level, and for an asset cut
into blocks the same maxima over the blocks before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, EngineConfig
from fleetpulse.operators.forecast import horizon_column
from fleetpulse.operators.layout import ASSET

# Names and texts of the maintenance report.
OK, WARN, CRITICAL = "OK", "WARN", "CRITICAL"
LEVEL_NAMES = (OK, WARN, CRITICAL)
HEALTH_THRESHOLD, HEALTH_INSPECT = "health_threshold", "health_inspect"
TREND_PROBABILITY, NO_TRIGGER = "trend_probability", "none"
TEXT_OK = "No action needed."
TEXT_FAILED = "Health at or below failure threshold now."
TEXT_URGENT = "Failure probability within %sd is %d%% (est. %dd remaining at current trend)."
TEXT_PLAN = "Failure probability within %sd is %d%% (est. %dd remaining at current trend) — schedule maintenance."
TEXT_INSPECT = "Health (%.1f%%) below inspection threshold."
TEXT_HOLDING = "Holding at %s (trend-based) — latest tick reads %s, needs %d more consecutive tick(s) to %s."

EVENTS = ("raise1", "raise2", "below1", "below2")


def policy_probability(probabilities: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Value of a horizon map at the policy horizon, else at the closest one."""
    wanted = F.lit(float(cfg.policy_horizon))
    closest = F.array_min(
        F.transform(
            F.map_entries(probabilities),
            lambda e: F.struct(F.abs(e["key"] - wanted).alias("away"), e["key"].alias("days"), e["value"].alias("p")),
        )
    )
    return closest["p"]


def policy_column(cfg: EngineConfig = DEFAULT) -> Column:
    """The same choice among fixed horizon columns."""
    return F.col(horizon_column(min(cfg.horizons, key=lambda h: abs(h - cfg.policy_horizon))))


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVEL_NAMES]), (level + 1).cast("int"))


def add_recommendation(df: DataFrame, cfg: EngineConfig = DEFAULT, probability: Column | None = None) -> DataFrame:
    """Add raw_level (0..2), raw_trigger and raw_reason; the first rule wins."""
    p = policy_column(cfg) if probability is None else probability
    level, days = F.col("level"), F.col("remaining_days")
    horizon = f"{cfg.policy_horizon:g}"
    percent = F.bround(p * 100, 0).cast("int")
    trusted = F.col("trend_trusted")
    rules = [
        (level <= cfg.health_failed, 2, HEALTH_THRESHOLD, F.lit(TEXT_FAILED)),
        (trusted & (p >= cfg.prob_urgent), 2, TREND_PROBABILITY, F.format_string(TEXT_URGENT, F.lit(horizon), percent, days)),
        (trusted & (p >= cfg.prob_plan), 1, TREND_PROBABILITY, F.format_string(TEXT_PLAN, F.lit(horizon), percent, days)),
        (level <= cfg.health_inspect, 1, HEALTH_INSPECT, F.format_string(TEXT_INSPECT, level)),
    ]

    def chain(pick, default):
        out = None
        for rule in rules:
            out = F.when(rule[0], pick(rule)) if out is None else out.when(rule[0], pick(rule))
        return out.otherwise(default)

    return df.select(
        "*",
        chain(lambda r: F.lit(r[1]), F.lit(0)).alias("raw_level"),
        chain(lambda r: F.lit(r[2]), F.lit(NO_TRIGGER)).alias("raw_trigger"),
        chain(lambda r: r[3], F.lit(TEXT_OK)).alias("raw_reason"),
    )


def streaks(df: DataFrame, keys: Sequence[str], index: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add by_health, streak and the running event positions of ``EVENTS``.

    A streak starts where the level changes and at every health trigger; the
    very first level is compared with OK.
    """
    ordered = W.partitionBy(*keys).orderBy(index)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    level, i = F.col("raw_level"), F.col(index)
    health = F.col("raw_trigger").isin(HEALTH_THRESHOLD, HEALTH_INSPECT)
    d = df.withColumn("by_health", health).withColumn("prev_level", F.coalesce(F.lag("raw_level").over(ordered), F.lit(0)))
    starts = F.col("by_health") | (level != F.col("prev_level"))
    began = F.coalesce(F.max(F.when(starts, i)).over(so_far), F.min(index).over(so_far))
    d = d.withColumn("streak", (i - began + 1).cast("int")).drop("prev_level")
    # Rows before a block only feed the streak; their own block reports their events.
    trend = ~F.col("by_health") & (~F.col("is_halo") if "is_halo" in df.columns else F.lit(True))
    raises, sets = trend & (F.col("streak") >= cfg.confirm_ticks), trend & (F.col("streak") >= cfg.clear_ticks)
    events = {
        "raise1": raises & (level >= 1),
        "raise2": raises & (level >= 2),
        "below1": sets & (level < 1),
        "below2": sets & (level < 2),
    }
    return d.select(
        "*", *[F.coalesce(F.max(F.when(on, i)).over(so_far), F.lit(0)).alias(name) for name, on in events.items()]
    )


def carry_events(df: DataFrame, block: str = "block") -> DataFrame:
    """Take event positions of earlier blocks of the asset into account.

    One row per block is exchanged, not the readings.
    """
    before = W.partitionBy(ASSET).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    last = df.groupBy(ASSET, block).agg(*[F.max(e).alias(e) for e in EVENTS])
    earlier = last.select(ASSET, block, *[F.coalesce(F.max(e).over(before), F.lit(0)).alias(f"{e}_before") for e in EVENTS])
    joined = df.join(earlier, [ASSET, block])
    return joined.select(
        *[c for c in df.columns if c not in EVENTS],
        *[F.greatest(F.col(e), F.col(f"{e}_before")).alias(e) for e in EVENTS],
    )


def held_level() -> Column:
    """Reported trend level from the event positions of ``EVENTS``."""
    return (F.col("raise1") > F.col("below1")).cast("int") + (F.col("raise2") > F.col("below2")).cast("int")


def report_levels(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add maintenance_level, _reason and _trigger from held, streak, by_health.

    ``held`` (the reported trend level) is derived from the event columns where
    the input has those; a stream brings it along instead.
    """
    d = df.withColumn("held", held_level()) if EVENTS[0] in df.columns else df
    raw, held, streak = F.col("raw_level"), F.col("held"), F.col("streak")
    instant, agrees = F.col("by_health"), held == raw
    escalating = raw > held
    required = F.when(escalating, F.lit(cfg.confirm_ticks)).otherwise(F.lit(cfg.clear_ticks))
    holding = F.format_string(
        TEXT_HOLDING,
        level_name(held),
        level_name(raw),
        required - streak,
        F.when(escalating, F.lit("confirm")).otherwise(F.lit("clear")),
    )

    def outcome(direct: Column, quiet: Column, hold: Column) -> Column:
        return F.when(instant, direct).when(held == 0, quiet).when(agrees, direct).otherwise(hold)

    d = d.select(
        "*",
        level_name(F.when(instant, raw).otherwise(held)).alias("maintenance_level"),
        outcome(F.col("raw_reason"), F.lit(TEXT_OK), holding).alias("maintenance_reason"),
        outcome(F.col("raw_trigger"), F.lit(NO_TRIGGER), F.lit(TREND_PROBABILITY)).alias("maintenance_trigger"),
    )
    return d.drop("held", "by_health", "streak", *EVENTS)


def debounce(df: DataFrame, keys: Sequence[str] = (ASSET,), index: str = "output", cfg: EngineConfig = DEFAULT) -> DataFrame:
    return report_levels(streaks(df, keys, index, cfg), cfg)
