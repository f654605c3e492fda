"""Content signature of a readings table and the feature cache guarded by it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from fleetpulse.config import DEFAULT, SENSORS, EngineConfig

HEX_DIGITS = 15  # 60 bits of each row's digest fit a signed long


def row_digest():
    """60-bit digest of one reading from a text form any engine can rebuild."""
    micros = F.coalesce(F.unix_micros("ts").cast("string"), F.lit("null"))
    values = [
        F.coalesce(F.round(F.col(s) * 1e6, 0).cast("decimal(38,0)").cast("string"), F.lit("null")) for s in SENSORS
    ]
    text = F.concat_ws("|", F.coalesce("asset_id", F.lit("null")), micros, *values)
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def table_signature(readings: DataFrame) -> DataFrame:
    """One row: count, sum and xor of row digests. Row order does not matter."""
    digests = readings.select(row_digest().alias("d"))
    return digests.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("d"), F.lit(0)).alias("digest_xor"),
    )


def source_signature(readings: DataFrame, cfg: EngineConfig = DEFAULT) -> str:
    row = table_signature(readings).first()
    text = f"{row['n_rows']}|{row['digest_sum']}|{row['digest_xor']}|{cfg.feature_hash()}"
    return hashlib.sha256(text.encode()).hexdigest()


def save_signature(spark: SparkSession, root: str, signature: str) -> None:
    spark.createDataFrame([(signature,)], "signature string").coalesce(1).write.mode("overwrite").json(f"{root}/signature")


def is_stale(spark: SparkSession, root: str, signature: str) -> bool:
    """True unless the cached features under ``root`` carry this signature."""
    try:
        spark.read.parquet(f"{root}/features")
        saved = spark.read.schema("signature string").json(f"{root}/signature").first()
    except AnalysisException:
        return True
    return saved is None or saved["signature"] != signature


def get_or_build(
    spark: SparkSession,
    root: str,
    readings: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Load the feature table, rebuilding it when readings or settings changed.

    The old signature goes first and the new one last, so a rebuild that dies
    half way leaves a stale cache rather than a wrong one.
    """
    signature = source_signature(readings, cfg)
    if is_stale(spark, root, signature):
        save_signature(spark, root, "rebuilding")
        features = build(readings).withColumn("feature_hash", F.lit(cfg.feature_hash()))
        features.write.mode("overwrite").parquet(f"{root}/features")
        save_signature(spark, root, signature)
    return spark.read.parquet(f"{root}/features")
