"""Model tables: nodes, calibrations, reference rows, one registry row."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from fleetpulse.config import DEFAULT, FEATURES, EngineConfig
from fleetpulse.operators.forest import NODE_SCHEMA
from fleetpulse.operators.health import CALIBRATION_SCHEMA

REGISTRY_SCHEMA = (
    "model_id string, trained_at timestamp, n_features int, feature_columns array<string>, "
    "feature_hash string, config string, commissioning_rows int, n_reference_rows long, has_reference_rows boolean"
)


@dataclass
class Model:
    """A fitted forest (bounded node table) and the tables that go with it."""

    model_id: str
    nodes: pd.DataFrame
    pooled: DataFrame
    feature_hash: str
    n_reference_rows: int
    features: tuple[str, ...] = FEATURES
    local: DataFrame | None = None
    reference: DataFrame | None = None
    trained_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    @cached_property
    def pooled_row(self) -> Row:
        """The one row of the pooled calibration."""
        row = self.pooled.first()
        if row is None:
            raise ValueError(f"model {self.model_id!r} has no pooled calibration")
        return row


class DriftError(ValueError):
    """The model was trained with another feature definition."""


def save_model(spark: SparkSession, root: str, model: Model, cfg: EngineConfig = DEFAULT) -> str:
    base = f"{root}/{model.model_id}"
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/forest_nodes")
    model.pooled.coalesce(1).write.mode("overwrite").parquet(f"{base}/calibration")
    if model.reference is not None:
        rows = model.reference.select(F.lit(model.model_id).alias("model_id"), "asset_id", "ts")
        rows.write.mode("overwrite").parquet(f"{base}/reference_rows")
    row = (
        model.model_id,
        model.trained_at,
        len(model.features),
        list(model.features),
        model.feature_hash,
        cfg.as_json(),
        cfg.commissioning_rows,
        model.n_reference_rows,
        model.reference is not None,
    )
    spark.createDataFrame([row], REGISTRY_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/model_registry")
    return base


def save_local_calibration(root: str, model_id: str, calibration: DataFrame) -> str:
    """Append calibrations of assets; the newest per asset counts."""
    path = f"{root}/{model_id}/calibration_local"
    calibration.withColumn("calibrated_at", F.current_timestamp()).write.mode("append").parquet(path)
    return path


def load_local_calibration(spark: SparkSession, root: str, model_id: str) -> DataFrame | None:
    """Newest calibration per asset, or None where none was ever saved."""
    rows = _read_or_none(spark, f"{root}/{model_id}/calibration_local", CALIBRATION_SCHEMA + ", calibrated_at timestamp")
    if rows is None:
        return None
    names = [c for c in rows.columns if c not in ("scope", "calibrated_at")]
    newest = rows.groupBy("scope").agg(F.max_by(F.struct(*names), F.col("calibrated_at")).alias("newest"))
    return newest.select("scope", *[F.col(f"newest.{c}").alias(c) for c in names])


def load_reference_rows(spark: SparkSession, root: str, model_id: str) -> DataFrame | None:
    return _read_or_none(spark, f"{root}/{model_id}/reference_rows", "model_id string, asset_id string, ts timestamp")


def load_model(spark: SparkSession, root: str, model_id: str, cfg: EngineConfig = DEFAULT) -> Model:
    """Read a model; refuse one trained with another feature definition."""
    base = f"{root}/{model_id}"
    registry = _read_or_none(spark, f"{base}/model_registry", REGISTRY_SCHEMA)
    row = None if registry is None else registry.first()
    if row is None:
        raise FileNotFoundError(f"no model {model_id!r} under {root}; train one first")
    if row["feature_hash"] != cfg.feature_hash():
        raise DriftError(
            f"model {model_id!r} has feature hash {row['feature_hash']}, current settings give {cfg.feature_hash()}; "
            "retrain or revert the change"
        )
    return Model(
        model_id=model_id,
        nodes=spark.read.schema(NODE_SCHEMA).parquet(f"{base}/forest_nodes").toPandas(),
        pooled=spark.read.schema(CALIBRATION_SCHEMA).parquet(f"{base}/calibration"),
        feature_hash=row["feature_hash"],
        n_reference_rows=row["n_reference_rows"],
        features=tuple(row["feature_columns"]),
        local=load_local_calibration(spark, root, model_id),
        reference=load_reference_rows(spark, root, model_id),
        trained_at=row["trained_at"],
    )


def _read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None
