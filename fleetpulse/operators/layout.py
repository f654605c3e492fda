"""How the rows of one asset are spread over tasks.

Most assets are *cold*: few enough rows for one task.  Their whole ordered
history is one window partition and every ordered operator runs after a single
shuffle by ``asset_id``.

A *hot* asset may hold a large share of all rows.  Its rows are range-sorted by
time into balanced slices, numbered from per-slice counts, and cut into blocks
of ``block_rows``; each block also receives the rows before it (the halo) that
its first rows look back on.  Window functions then run per (asset, block), and
the halo rows are dropped.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, EngineConfig
from fleetpulse.session import materialize

ASSET = "asset_id"
# A slice is a task and a file: small blocks do not ask for more of them than these.
SMALL_SLICES = 64
SLICE_ROWS = 262_144


@dataclass
class Split:
    """``cold`` and ``hot`` cover the input exactly once; ``hot`` may be None."""

    cold: DataFrame
    hot: DataFrame | None
    hot_slices: int = 0


def split_by_heat(df: DataFrame, cfg: EngineConfig = DEFAULT, count_from: DataFrame | None = None) -> Split:
    """Separate assets with more than ``hot_rows`` rows.

    One narrow aggregate (asset_id only) finds them.  There can be at most
    total_rows / hot_rows of them; up to ``max_listed_hot`` ids are sent to the
    tasks as a broadcast list, beyond that Spark picks the join.
    """
    spark = df.sparkSession
    source = df if count_from is None else count_from
    counts = source.groupBy(ASSET).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > cfg.hot_rows)
    listed = counts.limit(cfg.max_listed_hot + 1).collect()
    if not listed:
        return Split(df, None)
    if len(listed) <= cfg.max_listed_hot:
        ids = spark.createDataFrame([(r[ASSET],) for r in listed], f"{ASSET} string")
        ids = F.broadcast(ids)
        n_hot = sum(r["n_rows"] for r in listed)
    else:
        ids = counts.select(ASSET)
        n_hot = counts.agg(F.sum("n_rows")).first()[0]
    return Split(
        cold=df.join(ids, ASSET, "left_anti"),
        hot=df.join(ids, ASSET, "left_semi"),
        hot_slices=slice_count(n_hot, cfg.block_rows),
    )


def slice_count(n_rows: int, block_rows: int) -> int:
    """Slices of about ``block_rows`` rows, of SLICE_ROWS once there are more than SMALL_SLICES of smaller ones."""
    return max(1, min(ceil(n_rows / block_rows), max(SMALL_SLICES, ceil(n_rows / SLICE_ROWS))))


def sliced(df: DataFrame, order: Sequence[Column], slices: int, label: str) -> DataFrame:
    """Range-sort by (asset, order) into balanced slices and write them.

    Range partitioning cuts a hot asset at as many places as its size asks for.
    Writing pins the slice of every row, so the counts taken from the table and
    the rows numbered with them cannot disagree after a retry.
    """
    ranged = df.repartitionByRange(slices, F.col(ASSET), *order).withColumn("slice", F.spark_partition_id())
    return materialize(ranged, label)


def running_offsets(per_part: DataFrame, part: str, count: str, alias: str) -> DataFrame:
    """Exclusive running sum of ``count`` over the parts of each asset."""
    before = W.partitionBy(ASSET).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return per_part.select(ASSET, part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(alias))


def number_slices(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows 1..n per asset from slice counts; no asset is sorted whole."""
    per_slice = df.groupBy(ASSET, "slice").agg(F.count("*").alias("n"))
    offsets = running_offsets(per_slice, "slice", "n", "before")
    within = F.row_number().over(W.partitionBy(ASSET, "slice").orderBy(*order))
    numbered = df.join(offsets, [ASSET, "slice"]).withColumn(name, (F.col("before") + within).cast("long"))
    return numbered.drop("before", "slice")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, within.cast("long"))


def index_rows(df: DataFrame, order: Sequence[Column], name: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Number the rows of each asset 1..n, whatever the asset's size."""
    split = split_by_heat(df, cfg)
    cold = number_rows(split.cold, [ASSET], order, name)
    if split.hot is None:
        return cold
    return cold.unionByName(number_slices(sliced(split.hot, order, split.hot_slices, "index"), order, name))


def with_halo(df: DataFrame, index: str, halo: int, block_rows: int) -> DataFrame:
    """Give each block the ``halo`` rows before it; they carry ``is_halo``."""
    own = F.floor((F.col(index) - 1) / F.lit(block_rows)).cast("long")
    last = F.floor((F.col(index) - 1 + halo) / F.lit(block_rows)).cast("long")
    return (
        df.withColumn("own_block", own)
        .withColumn("block", F.explode(F.sequence(own, last)))
        .withColumn("is_halo", F.col("block") > F.col("own_block"))
        .drop("own_block")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_halo")).drop("is_halo")
