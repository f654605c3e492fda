"""A feature table that is rebuilt only where its readings changed.

Readings are cleaned and signed by (asset, day).  A day has to be built again if
its signature differs from the stored one, or if one of the ``window_rows`` - 1
readings before it lies in such a day; the days are found from counts alone, by
running sums over one row for each asset and day.  Only the readings of these
days, and of the days before them that their first windows reach into, are read
again.

A refresh writes the rebuilt days as one more segment, then a table of days that
names the segment of each day, and last the manifest that points to both.  A
refresh that stops half way leaves the old table as it was.  Rows carry their
number within the day; their number within the asset (``tick``) is added on
reading from the counts of the days before, so it needs no rebuild when earlier
days gain or lose readings.  With more than ``most_segments`` the live rows are
written as one segment, and folders that nothing names are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fleetpulse.config import DEFAULT, FEATURES, SENSORS, EngineConfig
from fleetpulse.functions.columns import nan_to_null
from fleetpulse.operators.clean import clean_readings
from fleetpulse.operators.layout import ASSET
from fleetpulse.plans.building import build_features
from fleetpulse.session import discard, materialize
from fleetpulse.sources.folder import Folder
from fleetpulse.sources.signature import row_digest

DAY = "day"
KEY = [ASSET, DAY]
MANIFEST = "features-"
DAYS_SCHEMA = "asset_id string, day date, n long, digest_sum string, digest_xor long, segment int"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: numbers of (asset, day) pairs."""

    n_days: int
    n_changed: int
    n_rebuilt: int
    n_read: int


def sign_days(cleaned: DataFrame) -> DataFrame:
    """(asset_id, day, n, digest_sum, digest_xor) of cleaned readings."""
    return cleaned.select(ASSET, F.to_date("ts").alias(DAY), row_digest().alias("d")).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum(F.col("d").cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor("d").alias("digest_xor")
    )


def plan_days(now: DataFrame, stored: DataFrame, reach: int) -> DataFrame:
    """All days of both with ``changed``, ``rebuild`` and ``needed``; a day that is gone has no readings and no ``segment``.

    ``reach`` is the number of readings that a window looks back.
    """
    before = stored.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("n", "digest_sum", "digest_xor", "segment")])
    same = [now[c].eqNullSafe(before[c]) for c in KEY]
    both = now.join(before, same[0] & same[1], "full_outer").select(
        *[F.coalesce(now[c], before[c]).alias(c) for c in KEY], F.coalesce("n", F.lit(0)).alias("n"), "digest_sum", "digest_xor",
        F.col("old_segment").alias("segment"),
        (~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("digest_sum").eqNullSafe(F.col("old_digest_sum"))
           & F.col("digest_xor").eqNullSafe(F.col("old_digest_xor")))).alias("changed"),
    )
    order = W.partitionBy(ASSET).orderBy(DAY)
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(ASSET).orderBy(F.desc(DAY)).rowsBetween(W.unboundedPreceding, -1)
    d = both.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("upto") - F.col("n"))
    last_change = F.max(F.when(F.col("changed"), F.col("upto"))).over(earlier)
    d = d.withColumn("rebuild", (F.col("n") > 0) & (F.col("changed") | F.coalesce(F.col("start") - last_change < reach, F.lit(False))))
    next_rebuild = F.min(F.when(F.col("rebuild"), F.col("start"))).over(later)
    return d.withColumn("needed", F.col("rebuild") | ((F.col("n") > 0) & F.coalesce(next_rebuild - F.col("upto") < reach, F.lit(False))))


class FeatureCache:
    def __init__(self, spark: SparkSession, root: str, cfg: EngineConfig = DEFAULT, most_segments: int = 8):
        self.spark, self.cfg, self.most_segments = spark, cfg, most_segments
        self.folder = Folder(spark, root)

    def _manifest(self) -> dict:
        versions = [int(n.removeprefix(MANIFEST)) for n in self.folder.names() if n.startswith(MANIFEST)]
        held = json.loads(self.folder.read(f"{MANIFEST}{max(versions)}")) if versions else {"version": max(versions, default=0)}
        # Another feature definition shares nothing with this one.
        fresh = {"version": held["version"], "days": None, "segments": [], "feature_hash": self.cfg.feature_hash()}
        return held if held.get("feature_hash") == self.cfg.feature_hash() else fresh

    def _days(self, held: dict) -> DataFrame:
        if held["days"] is None:
            return self.spark.createDataFrame([], DAYS_SCHEMA)
        return self.spark.read.schema(DAYS_SCHEMA).parquet(f"{self.folder.path}/{held['days']}")

    def refresh(self, readings: DataFrame) -> Refresh:
        """Bring the table up to date with the readings."""
        held = self._manifest()
        cleaned = materialize(clean_readings(readings.select(ASSET, "ts", *[nan_to_null(F.col(s)).alias(s) for s in SENSORS]).filter("ts IS NOT NULL")), "cleaned")
        reach = self.cfg.window_rows - 1
        days = materialize(plan_days(sign_days(cleaned), self._days(held), reach), "days")
        counts = days.agg(*[F.count_if(c).alias(n) for n, c in (
            ("n_days", F.col("n") > 0), ("n_changed", F.col("changed")), ("n_rebuilt", F.col("rebuild")), ("n_read", F.col("needed")))]).first()
        done = Refresh(*counts)
        if done.n_changed:
            self._commit(held, cleaned, days, done)
        discard(cleaned)
        discard(days)
        return done

    def _commit(self, held: dict, cleaned: DataFrame, days: DataFrame, done: Refresh) -> None:
        version, segments = held["version"] + 1, list(held["segments"])
        placed = days.select(*KEY, "n", "digest_sum", "digest_xor", F.when(F.col("rebuild"), F.lit(version)).otherwise(F.col("segment")).cast("int").alias("segment"))
        if done.n_rebuilt:
            rows = cleaned.withColumn(DAY, F.to_date("ts"))
            needed, rebuild = (days.filter(c).select(*[F.col(k).alias(f"of_{k}") for k in KEY]) for c in ("needed", "rebuild"))
            built = build_features(self._among(rows, needed).drop(DAY), self.cfg, clean=False).withColumn(DAY, F.to_date("ts"))
            self._write(self._numbered(self._among(built, rebuild), rows), version)
            segments.append(version)
        placed.filter("n > 0").write.mode("overwrite").parquet(f"{self.folder.path}/days-{version}")
        after = {"version": version, "days": f"days-{version}", "segments": segments, "feature_hash": self.cfg.feature_hash()}
        self.folder.write(f"{MANIFEST}{version}", json.dumps(after))
        if len(segments) > self.most_segments:
            after = self._merge(after)
        self._tidy(after)

    @staticmethod
    def _among(rows: DataFrame, days: DataFrame) -> DataFrame:
        """Rows of some days; a missing asset equals itself."""
        return rows.join(days, rows[ASSET].eqNullSafe(days[f"of_{ASSET}"]) & (rows[DAY] == days[f"of_{DAY}"]), "left_semi")

    @staticmethod
    def _numbered(built: DataFrame, rows: DataFrame) -> DataFrame:
        """Features with ``nth``, the place of their reading among all of its day."""
        nth = F.row_number().over(W.partitionBy(*KEY).orderBy("ts")).cast("long")
        places = rows.select(F.col(ASSET).alias("of_asset"), F.col("ts").alias("of_ts"), DAY).withColumnRenamed("of_asset", ASSET).withColumnRenamed("of_ts", "ts")
        places = places.withColumn("nth", nth).select(F.col(ASSET).alias("of_asset"), F.col("ts").alias("of_ts"), "nth")
        joined = built.join(places, built[ASSET].eqNullSafe(places["of_asset"]) & (built["ts"] == places["of_ts"]))
        return joined.select(ASSET, DAY, "ts", *SENSORS, "nth", *FEATURES)

    def _write(self, rows: DataFrame, segment: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder.path}/segment={segment}")

    def _live(self, held: dict) -> DataFrame:
        """Rows of all segments that the table of days still names, with ``start``, the readings of the days before."""
        days = self._days(held)
        start = F.coalesce(F.sum("n").over(W.partitionBy(ASSET).orderBy(DAY).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        of = days.select(F.col(ASSET).alias("of_asset"), F.col(DAY).alias("of_day"), F.col("segment").alias("of_segment"), start.alias("start"))
        rows = None
        for s in held["segments"]:
            part = self.spark.read.parquet(f"{self.folder.path}/segment={s}").withColumn("segment", F.lit(s))
            rows = part if rows is None else rows.unionByName(part)
        return rows.join(of, rows[ASSET].eqNullSafe(of["of_asset"]) & (rows[DAY] == of["of_day"]) & (rows["segment"] == of["of_segment"]))

    def _merge(self, held: dict) -> dict:
        version = held["version"] + 1
        self._write(self._live(held).select(ASSET, DAY, "ts", *SENSORS, "nth", *FEATURES), version)
        self._days(held).withColumn("segment", F.lit(version)).write.mode("overwrite").parquet(f"{self.folder.path}/days-{version}")
        after = held | {"version": version, "days": f"days-{version}", "segments": [version]}
        self.folder.write(f"{MANIFEST}{version}", json.dumps(after))
        return after

    def _tidy(self, held: dict) -> None:
        keep = {held["days"], f"{MANIFEST}{held['version']}", *(f"segment={s}" for s in held["segments"])}
        for name in self.folder.names():
            if name not in keep and name.startswith(("days-", "segment=", MANIFEST)):
                self.folder.delete(name)

    def read(self) -> DataFrame:
        """asset_id, ts, sensors, tick and the features, as a whole build gives them."""
        held = self._manifest()
        if not held["segments"]:
            raise ValueError(f"no features in {self.folder.path}; refresh first")
        return self._live(held).select(ASSET, "ts", *SENSORS, (F.col("start") + F.col("nth")).alias("tick"), *FEATURES)
