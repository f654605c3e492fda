from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.config import DEFAULT
from fleetpulse.operators.health import CALIBRATION_SCHEMA
from fleetpulse.sources.readings import READING_SCHEMA
from fleetpulse.sources.registry import Model

START = datetime(2024, 1, 1)


def minute(i: float) -> datetime:
    return START + timedelta(minutes=i)


def readings(spark: SparkSession, assets: dict[str, list]) -> DataFrame:
    rows = [(a, minute(i), *map(float, v)) for a, values in assets.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, READING_SCHEMA)


def stand_in(spark: SparkSession) -> Model:
    means = {"vibration_mean": 2.0, "current_mean": 2.0}
    pooled = spark.createDataFrame([("pooled", 1, -0.44, 0.05, means, {k: 1.0 for k in means})], CALIBRATION_SCHEMA)
    return Model("stand-in", None, pooled, DEFAULT.feature_hash(), 0)
