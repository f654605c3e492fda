"""What is written and read again, as queries: files, sinks, logs, models, caches, quarantine."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetpulse.catalog import queries as Q
from fleetpulse.config import FEATURES, SENSORS
from fleetpulse.operators import clean, diagnostics
from fleetpulse.operators.forest import finite_features, score_rows
from fleetpulse.operators.health import calibrate
from fleetpulse.plans import evaluation, monitoring
from fleetpulse.plans.building import build_features
from fleetpulse.session import materialize, scratch_folder
from fleetpulse.sources.feature_cache import FeatureCache
from fleetpulse.sources import polling, readings as sources, registry, signature

DAY_FIRST = "dd.MM.yyyy HH:mm:ss.SSSSSS"


def csv_day_first(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled CSV with day-first times; text that is no number and no time is NULL."""
    folder, rows = scratch_folder(spark, "csv"), Q._events(spark, sf, labelled=True)
    hot = F.col("temperature") > 58
    rows.select(
        F.col("asset_id"),
        F.when(F.col("temperature") == 57, F.lit("soon")).otherwise(F.date_format("ts", DAY_FIRST)).alias(sources.RAW_TIME),
        F.col("vibration").alias(sources.RAW_SENSORS["vibration"]),
        F.when(hot, F.lit("n/a")).otherwise(F.col("current").cast("string")).alias(sources.RAW_SENSORS["current"]),
        F.col("temperature").alias(sources.RAW_SENSORS["temperature"]),
        F.col("health_status"),
        F.lit("x").alias("unused"),
    ).write.option("header", True).csv(folder)
    read = sources.read_labelled_csv(spark, folder, fmt=DAY_FIRST)
    return read.select("asset_id", Q.stamp(), *[Q.six(s) for s in SENSORS], "health_status")


def csv_iso(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled CSV with ISO times, one folder for each asset, which names it."""
    folder = scratch_folder(spark, "csv")
    Q._events(spark, sf).select(
        "asset_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(sources.RAW_TIME), *[F.col(s).alias(c) for s, c in sources.RAW_SENSORS.items()]
    ).write.option("header", True).partitionBy("asset_id").csv(folder)
    return sources.read_csv(spark, folder).select("asset_id", Q.stamp(), *[Q.six(s) for s in SENSORS])


def csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a damaged CSV, read or rejected: its outcome and the raw text that could not be read."""
    folder, t = scratch_folder(spark, "csv"), F.col("temperature")
    header = ["asset_id", sources.RAW_TIME, *sources.RAW_SENSORS.values()]
    fields = [
        F.col("asset_id"),
        F.when(t == 57, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.col("vibration").cast("string"), F.when(t > 58, F.lit("n/a")).otherwise(F.col("current").cast("string")), t.cast("string"),
    ]
    lines = F.concat_ws(",", *fields, F.when(t == 30, F.lit("one field more")))
    Q._events(spark, sf).select(lines.alias(",".join(header))).write.option("header", True).option("sep", "\u0001").csv(folder)
    read, rejected = sources.read_csv_checked(spark, folder)
    outcomes = read.select("asset_id", "ts", F.lit("read").alias("outcome"), F.lit(None).cast("string").alias("raw_time"), F.lit(None).cast("string").alias("raw_current"))
    put_aside = rejected.select(
        "asset_id", "ts", F.array_join("reasons", ", ").alias("outcome"),
        F.col("raw")[sources.RAW_TIME].alias("raw_time"), F.col("raw")[sources.RAW_SENSORS["current"]].alias("raw_current"),
    )
    both = outcomes.unionByName(put_aside)
    return both.groupBy("asset_id", Q.stamp(), "outcome", "raw_time", "raw_current").agg(F.count("*").alias("n_rows"))


def _insert(rows: DataFrame, table: polling.Table, columns: tuple[str, ...]) -> None:
    """Rows into a database table, each task with a connection of its own."""
    marks = ", ".join("?" for _ in columns)

    def write(part) -> None:
        connection = table.connection()
        while some := list(islice(part, 10_000)):
            connection.cursor().executemany(f"INSERT INTO {table.table} ({', '.join(columns)}) VALUES ({marks})", [tuple(r) for r in some])
            connection.commit()
        connection.close()

    rows.select(*columns).foreachPartition(write)


def stream_table_poll(spark: SparkSession, sf: str) -> DataFrame:
    """A growing database table, polled in three runs of one stream, each stopped and started again.

    A page is a twentieth of the table at most, so every run takes several.
    """
    events = Q._events(spark, sf)
    folder = scratch_folder(spark, "polled")
    place = Path(folder.removeprefix("file:"))
    place.mkdir(parents=True)
    table = polling.Table("sqlite3:connect", json.dumps({"database": f"{place}/readings.db", "timeout": 120}), "readings", time="taken_at", asset="unit")
    connection = table.connection()
    connection.execute("CREATE TABLE readings (unit TEXT, taken_at TEXT, vibration REAL, current REAL, temperature REAL)")
    connection.execute("CREATE INDEX by_key ON readings (taken_at, coalesce(unit, ''))")
    connection.commit()
    connection.close()
    page = events.count() // 20 + 1
    for part in Q._by_time(events):
        named = part.select(F.col("asset_id").alias("unit"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("taken_at"), *SENSORS)
        _insert(named, table, ("unit", "taken_at", *SENSORS))
        rows = polling.poll_table(spark, table, f"{place}/cursor.json", page, tasks=4)
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        query = writer.trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(f"{folder}/out").select("asset_id", Q.stamp(), *[Q.six(s) for s in SENSORS])


def evaluation_by_asset(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report of the stand-in monitor for every asset and for the fleet."""
    labelled = Q._events(spark, sf, labelled=True)
    flat = evaluation.replay(labelled, Q._stand_in(spark), scorer=Q._with_score)
    return evaluation.evaluate_by_asset(flat, labelled).select("scope", "section", "metric", Q.six("value"))


def cleaned_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned readings written by hashed asset and read again."""
    folder = scratch_folder(spark, "cleaned")
    sources.write_cleaned(clean.clean_readings(Q._dirty(spark, sf)), folder, buckets=16)
    return sources.read_table(spark, folder).select("asset_id", Q.stamp(), *[Q.six(s) for s in SENSORS])


def feature_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Feature table written, read again and held against the feature definition."""
    folder = scratch_folder(spark, "features")
    sources.write_features(Q._features(spark, sf), folder)
    features = sources.check_feature_hash(sources.read_table(spark, folder), Q.DEFAULT.feature_hash())
    names = [f for f in FEATURES if f.endswith("_corr")]
    return features.select("asset_id", Q.stamp(), "tick", *[Q.six(n) for n in names])


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """A run that is written twice is in the log once."""
    folder = scratch_folder(spark, "log")
    flat = Q._monitored(spark, sf)
    for _ in range(2):
        monitoring.write_predictions(flat, folder, "first")
    return Q._log_form(spark.read.parquet(folder))


def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A saved model scores as before; its tables are read by schema."""
    root, features = scratch_folder(spark, "models"), Q._features(spark, sf)
    model = replace(Q._stand_in(spark), model_id="fixed", nodes=Q.fixed_nodes(), reference=features.select("asset_id", "ts"))
    registry.save_model(spark, root, model)
    loaded = registry.load_model(spark, root, "fixed")
    rows = diagnostics.reference_features(features, loaded.reference)
    return score_rows(rows, loaded.nodes, loaded.features).select("asset_id", Q.stamp(), Q.six("score"))


def calibration_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors are saved twice, first wrong ones; the newest of each asset counts."""
    root = scratch_folder(spark, "models")
    local = calibrate(Q._with_score(Q._features(spark, sf)), by_asset=True)
    registry.save_local_calibration(root, "fixed", local.withColumn("baseline_mean", F.lit(7.0)))
    registry.save_local_calibration(root, "fixed", local)
    return Q._calibration_rows(registry.load_local_calibration(spark, root, "fixed"))


def feature_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Built once, loaded the second time; one changed reading makes it stale."""
    root, rows = scratch_folder(spark, "cache"), Q._events(spark, sf)
    signature.get_or_build(spark, root, rows, build_features)

    def refuse(_: DataFrame) -> DataFrame:
        raise AssertionError("a fresh table was built again")

    features = signature.get_or_build(spark, root, rows, refuse)
    moved = rows.withColumn("current", F.when(F.col("temperature") == 59, F.col("current") + 1).otherwise(F.col("current")))
    stale = signature.is_stale(spark, root, signature.source_signature(moved))
    names = [f for f in FEATURES if f.endswith("_trend_slope")]
    return features.select("asset_id", Q.stamp(), "tick", *[Q.six(n) for n in names], F.lit(int(stale)).alias("stale_after_change"))


def feature_cache_partial(spark: SparkSession, sf: str) -> DataFrame:
    """One asset's readings change on one day and lose a day: few days are built again, all features and ticks are right."""
    rows, cache = Q._events(spark, sf), FeatureCache(spark, scratch_folder(spark, "cache"))
    cache.refresh(rows)
    day, own = F.to_date("ts"), F.col("asset_id") == "view"
    changed = rows.filter(~(own & (day == F.lit("2024-01-20")))).withColumn(
        "current", F.when(own & (day == F.lit("2024-01-10")), F.col("current") + 1).otherwise(F.col("current"))
    )
    done = cache.refresh(changed)
    few = int(done.n_changed == 2 and done.n_rebuilt <= 20 and done.n_read <= 30 < done.n_days)
    names = [f for f in FEATURES if f.endswith(("_mean", "_corr"))]
    return cache.read().select("asset_id", Q.stamp(), "tick", *[Q.six(n) for n in names], F.lit(few).alias("few_rebuilt"))


def finite_split(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows with a NaN, an infinite or a missing value are set aside, not scored."""
    tick, x = F.col("tick") % 10, F.col("current_skew")
    odd = F.when(tick == 1, F.lit(float("nan"))).when(tick == 2, F.lit(float("inf"))).when(tick == 3, F.lit(None)).otherwise(x)
    rows = materialize(materialize(Q._features(spark, sf), "features").withColumn("current_skew", odd), "odd")
    ok = rows.groupBy("asset_id").agg(F.count_if(finite_features()).alias("n_scored"), F.count_if(~finite_features()).alias("n_aside"))
    scored = score_rows(rows.filter(finite_features()), Q.fixed_nodes()).groupBy("asset_id").agg(F.count("score").alias("n_scores"))
    return ok.join(scored, "asset_id", "left").select("asset_id", "n_scored", "n_aside", F.coalesce("n_scores", F.lit(0)).alias("n_scores"))


def _spreads(spark: SparkSession, sf: str) -> DataFrame:
    """An importance for every feature that SQL can repeat: its spread over the table."""
    spread = Q._features(spark, sf).agg(*[F.stddev_samp(f).alias(f) for f in FEATURES])
    return spread.unpivot([], list(FEATURES), "feature", "importance")


def permutation_importance_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Importance for the fixed trees, with donors that SQL can find."""
    features = materialize(Q._features(spark, sf), "features")
    found = diagnostics.permutation_importance(features, Q.fixed_nodes(), features.count())
    return found.select("feature", Q.rounded(F.col("importance"), 9).alias("importance"))


def importance_by_sensor_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.importance_by_sensor(_spreads(spark, sf)).select("sensor", Q.six("importance"), Q.six("percent"))


def top_features_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.top_features(_spreads(spark, sf)).select("feature", Q.six("importance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_day_first": csv_day_first,
    "csv_iso": csv_iso,
    "csv_rejects": csv_rejects,
    "stream_table_poll": stream_table_poll,
    "evaluation_by_asset": evaluation_by_asset,
    "cleaned_sink": cleaned_sink,
    "feature_sink": feature_sink,
    "prediction_log": prediction_log,
    "model_registry": model_registry,
    "calibration_tables": calibration_tables,
    "feature_cache": feature_cache,
    "feature_cache_partial": feature_cache_partial,
    "finite_split": finite_split,
    "permutation_importance_fixed": permutation_importance_fixed,
    "importance_by_sensor_fixed": importance_by_sensor_fixed,
    "top_features_fixed": top_features_fixed,
}
