"""Where readings come from and where tables go."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from fleetpulse.config import DEFAULT, SENSORS, EngineConfig
from fleetpulse.functions.columns import nan_to_null
from fleetpulse.operators.clean import parse_time
from fleetpulse.session import discard, materialize

READING_SCHEMA = T.StructType(
    [T.StructField("asset_id", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(s, T.DoubleType()) for s in SENSORS]
)
LABELLED_SCHEMA = T.StructType([*READING_SCHEMA.fields, T.StructField("health_status", T.StringType())])

# Column names of raw sensor files.
RAW_TIME = "timestamp"
RAW_SENSORS = {"vibration": "vibration_mps2", "current": "current_ampere", "temperature": "temperature_c"}
RAW_LABEL = "health_status"
DEFAULT_ASSET = "unit"
TOP_ROWS = 100_000


def _project(raw: DataFrame, asset_id: str | None, label: bool, fmt: str | None = None) -> DataFrame:
    """Select by name, so no other column is ever read; names must exist."""
    needed = [RAW_TIME, *RAW_SENSORS.values()] + ([RAW_LABEL] if label else [])
    missing = [c for c in needed if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {raw.columns}")
    asset = F.col("asset_id").cast("string") if asset_id is None and "asset_id" in raw.columns else F.lit(asset_id or DEFAULT_ASSET)
    time = parse_time(F.col(RAW_TIME), fmt) if dict(raw.dtypes)[RAW_TIME] == "string" else F.col(RAW_TIME).cast("timestamp")
    values = [nan_to_null(F.col(c).try_cast("double")).alias(s) for s, c in RAW_SENSORS.items()]
    return raw.select(asset.alias("asset_id"), time.alias("ts"), *values, *([F.col(RAW_LABEL)] if label else []))


def read_csv(spark: SparkSession, path: str, asset_id: str | None = None, fmt: str | None = None) -> DataFrame:
    """Timestamp and three sensors of a CSV file; text that is no number or time is NULL.

    ``fmt`` is the pattern of the timestamps, ISO 8601 if it is not given.
    """
    return _project(spark.read.option("header", True).csv(path), asset_id, False, fmt)


def read_labelled_csv(spark: SparkSession, path: str, asset_id: str | None = None, fmt: str | None = None) -> DataFrame:
    """The same plus the label, for evaluation only; rows are not cleaned."""
    return _project(spark.read.option("header", True).csv(path), asset_id, True, fmt)


BAD_LINE = "_line"


def read_csv_checked(
    spark: SparkSession, path: str, asset_id: str | None = None, fmt: str | None = None, label: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(readings, rejected): every line of the files is in exactly one of the two.

    A line is rejected if it has another number of fields than the header, or if
    a needed field holds text that is no time or no number; an empty field is a
    missing value, not a rejected one. Rejected lines keep what was read: the
    ``reasons``, the raw text of the fields that could not be read (``raw``), the
    whole line where its fields do not fit (``line``), and where it stands:
    ``file`` with ``block_start``, the byte at which the scanned block begins.
    """
    header = spark.read.option("header", True).csv(path).columns
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD_LINE]])
    # Only whole lines show that their fields do not fit, so no column is pruned.
    scan = spark.read.schema(fields).option("header", True).option("columnNameOfCorruptRecord", BAD_LINE).option("columnPruning", False).csv(path)
    text = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block_start"))
    good = _project(text, asset_id, label, fmt)  # checks the names
    time = parse_time(F.col(RAW_TIME), fmt)

    def unread(column: str, parsed) -> Column:
        return F.col(column).isNotNull() & (F.trim(F.col(column)) != "") & parsed.isNull()

    unreadable = {RAW_TIME: ("no time", unread(RAW_TIME, time))}
    unreadable |= {c: ("no number", unread(c, F.col(c).try_cast("double"))) for c in RAW_SENSORS.values()}
    # A plain test for NULL would be pushed into the scan, which fills this column after its filters.
    short = F.length(F.coalesce(BAD_LINE, F.lit(""))) > 0
    reasons = F.array_compact(F.array(
        *[F.when(~short & bad, F.lit(f"{why}: {c}")) for c, (why, bad) in unreadable.items()], F.when(short, F.lit("wrong number of fields"))
    ))
    raw = F.map_from_entries(F.array_compact(F.array(
        *[F.when(~short & bad, F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c, (_, bad) in unreadable.items()]
    )))
    judged = text.withColumn("_reasons", reasons).withColumn("_raw", raw)
    asset = F.col("asset_id") if asset_id is None and "asset_id" in header else F.lit(asset_id or DEFAULT_ASSET)
    rejected = judged.filter(F.size("_reasons") > 0).select(
        asset.alias("asset_id"), F.when(~short, time).alias("ts"), F.col("_reasons").alias("reasons"), F.col("_raw").alias("raw"),
        F.col(BAD_LINE).alias("line"), F.col("_file").alias("file"), F.col("_block_start").alias("block_start"),
    )
    return _project(judged.filter(F.size("_reasons") == 0), asset_id, label, fmt).select(*good.columns), rejected


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def time_of_nth(rows: DataFrame, time: str, nth: int) -> datetime | None:
    """Time of the ``nth`` row in the order of time, of the last row if there are fewer.

    Rows are counted by time, times cut into slices of the order; the row's
    slice follows from one total per slice, and only that slice is numbered.
    """
    counts = rows.groupBy(time).agg(F.count("*").alias("n")).repartitionByRange(F.col(time))
    counts = materialize(counts.withColumn("slice", F.spark_partition_id()), "times")
    before, last = 0, None
    for s in counts.groupBy("slice").agg(F.sum("n").alias("n"), F.max(time).alias("last")).orderBy("slice").collect():
        last = s["last"]
        if before + s["n"] >= nth:
            so_far = F.sum("n").over(W.partitionBy("slice").orderBy(time).rowsBetween(W.unboundedPreceding, 0))
            numbered = counts.filter(F.col("slice") == s["slice"]).withColumn("so_far", so_far)
            last = numbered.filter(F.col("so_far") >= nth - before).orderBy(time).first()[time]
            break
        before += s["n"]
    discard(counts)
    return last


def whole_page(newer: DataFrame, time: str, limit: int | None) -> DataFrame:
    """Rows up to the time of the ``limit``-th one, all rows of that time included.

    A page never ends inside a timestamp, so the last time of a page is a
    lossless cursor even if a whole fleet shares its timestamps. A task holds
    the first ``limit`` times of its rows only where these are few.
    """
    if limit is None:
        return newer
    if limit > TOP_ROWS:
        last = time_of_nth(newer, time, limit)
    else:
        last = newer.select(time).orderBy(time).limit(limit).agg(F.max(time)).first()[0]
    return newer.filter(F.col(time) <= F.lit(last)).orderBy(time) if last is not None else newer.limit(0)


def read_new_rows(table: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """Readings strictly after ``since``; with a ``limit``, one page of them."""
    newer = table if since is None else table.filter(F.col("ts") > F.lit(since))
    return whole_page(newer.filter(F.col("ts").isNotNull()).select("asset_id", "ts", *SENSORS), "ts", limit)


def read_pages(table: DataFrame, since=None, limit: int = 5000) -> Iterator[DataFrame]:
    """All readings after ``since`` page by page; the cursor is the last time of a page."""
    while True:
        page = read_new_rows(table, since, limit)
        since = page.agg(F.max("ts")).first()[0]
        if since is None:
            return
        yield page


def read_jdbc_new_rows(
    spark: SparkSession,
    url: str,
    table: str,
    since: str | None = None,
    limit: int | None = None,
    asset_id: str | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """New rows of a database table; projection, filter and the page's end are pushed down."""
    df = spark.read.jdbc(url, table, properties=properties or {})
    names = {c.lower(): c for c in df.columns}
    df = df.select(*[F.col(names[c]).alias(c) for c in (RAW_TIME, *RAW_SENSORS.values(), "asset_id") if c in names])
    if since is not None:
        df = df.filter(F.col(RAW_TIME) > F.to_timestamp(F.lit(since)))
    return _project(whole_page(df, RAW_TIME, limit), asset_id, label=False)


def stream_table(spark: SparkSession, path: str, max_files: int = 1, schema: T.StructType = READING_SCHEMA) -> DataFrame:
    """Readings arriving as parquet files; the backlog per batch is bounded in files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def readings_from_events(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """The ``events`` test table seen as sensor readings of five assets."""
    value = F.col("value")
    label = F.when(value > 150, "critical").when(value > 100, "warning").otherwise("normal")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("asset_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (value / 25).alias("vibration"),
        (F.get_json_object("props", "$.k").cast("double") / 20).alias("current"),
        (F.lit(20.0) + F.col("user_id") % 40).alias("temperature"),
        *([label.alias("health_status")] if labelled else []),
    )


def write_cleaned(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Cleaned readings, one directory per asset.

    A fleet with very many assets gives ``buckets``: directories then hold
    assets by hash, so their number does not grow with the fleet.
    """
    if buckets is None:
        df.write.mode("overwrite").partitionBy("asset_id").parquet(path)
        return
    bucket = F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int")
    df.withColumn("asset_bucket", bucket).write.mode("overwrite").partitionBy("asset_bucket").parquet(path)


def write_features(df: DataFrame, path: str, cfg: EngineConfig = DEFAULT) -> None:
    """Feature table; every row names the feature definition it was built with."""
    df.withColumn("feature_hash", F.lit(cfg.feature_hash())).write.mode("overwrite").parquet(path)


def check_feature_hash(features: DataFrame, expected: str) -> DataFrame:
    """Fail the job on rows built with another feature definition."""
    if "feature_hash" not in features.columns:
        return features
    ok = F.col("feature_hash") == expected
    problem = F.concat(F.lit("feature definition drift: table has "), F.col("feature_hash"), F.lit(f", model has {expected}"))
    checked = F.when(ok, F.col("asset_id")).otherwise(F.raise_error(problem))
    return features.withColumn("asset_id", checked).drop("feature_hash")
