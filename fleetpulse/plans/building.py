"""Readings to feature rows, the same for training, monitoring, recalibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetpulse.config import DEFAULT, SENSORS, EngineConfig
from fleetpulse.functions.columns import nan_to_null
from fleetpulse.operators import layout
from fleetpulse.operators.clean import (
    clean_sorted,
    first_per_timestamp,
    physically_possible,
    reading_order,
    sensors_present,
    within_rating,
)
from fleetpulse.operators.features import create_features
from fleetpulse.operators.layout import ASSET
from fleetpulse.session import spread

BLOCK = "block"


def _prepared(readings: DataFrame) -> DataFrame:
    """Projected readings with missing values as NULL; rows need a time."""
    values = [nan_to_null(F.col(s)).alias(s) for s in SENSORS]
    return readings.select(ASSET, "ts", *values).filter(F.col("ts").isNotNull())


def cold_features(readings: DataFrame, cfg: EngineConfig, clean: bool, rated_only: bool) -> DataFrame:
    """One exchange: clean, number and window whole assets side by side."""
    d = spread(readings, ASSET)
    if clean:
        d = clean_sorted(d, [ASSET])
    if rated_only:
        d = d.filter(within_rating(cfg))
    d = layout.number_rows(d, [ASSET], reading_order(), "tick")
    return create_features(d, [ASSET], ["tick"], cfg)


def hot_features(readings: DataFrame, slices: int, cfg: EngineConfig, clean: bool, rated_only: bool) -> DataFrame:
    """Assets cut into blocks: numbered by slice counts, windowed with a halo."""
    d = readings
    if clean:
        d = first_per_timestamp(d).filter(sensors_present() & physically_possible())
    if rated_only:
        d = d.filter(within_rating(cfg))
    d = layout.sliced(d, reading_order(), slices, "readings")
    d = layout.number_slices(d, reading_order(), "tick")
    d = layout.with_halo(d, "tick", cfg.window_rows - 1, cfg.block_rows)
    d = create_features(spread(d, ASSET, BLOCK), [ASSET, BLOCK], ["tick"], cfg)
    return layout.drop_halo(d)


def feature_parts(
    readings: DataFrame, cfg: EngineConfig = DEFAULT, clean: bool = True, rated_only: bool = False
) -> tuple[DataFrame, DataFrame | None, int]:
    """Features of cold and of hot assets (with ``block``), and the slice count."""
    split = layout.split_by_heat(_prepared(readings), cfg)
    cold = cold_features(split.cold, cfg, clean, rated_only)
    hot = None if split.hot is None else hot_features(split.hot, split.hot_slices, cfg, clean, rated_only)
    return cold, hot, split.hot_slices


def build_features(
    readings: DataFrame, cfg: EngineConfig = DEFAULT, clean: bool = True, rated_only: bool = False
) -> DataFrame:
    """asset_id, ts, sensors, tick and the thirty features.

    ``rated_only`` filters readings before windows are formed, so a window
    bridges the removed rows; filtering the result keeps only whole windows.
    """
    cold, hot, _ = feature_parts(readings, cfg, clean, rated_only)
    return cold if hot is None else cold.unionByName(hot.drop(BLOCK))
