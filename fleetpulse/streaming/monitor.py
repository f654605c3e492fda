"""The monitor as a stateful Structured Streaming query.

One state per asset: the last readings, the filter, the trend history and the
hysteresis. Readings that wait for the watermark lie in a map state of their
own, as runs in time order, cut into pages of whole spans of time (``SPAN``). A
page is written once and read once. When the watermark has passed their first
spans, the runs are merged page by page and handled span by span, so that a backlog of an asset
is never gathered: a task holds the arrivals of one run (``RUN_ROWS``), or a page of each
run and the readings of one span, and predicts ``PIECE_ROWS`` readings or more at a time. Jitter does not change the result; what arrives after its place was
taken is reported as late. Everything that needs one row only (forecast, texts,
explanation, rounding) is the batch code applied behind the stateful operator.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from fleetpulse.config import DEFAULT, FEATURES, SENSORS, EngineConfig
from fleetpulse.functions.columns import nan_to_null
from fleetpulse.operators import policy
from fleetpulse.operators.clean import MIN_CURRENT, MIN_VIBRATION, TEMPERATURE_ABOVE, TEMPERATURE_BELOW
from fleetpulse.operators.forecast import add_forecast
from fleetpulse.operators.forest import PackedForest
from fleetpulse.operators.health import pick_calibration
from fleetpulse.plans.monitoring import flatten_predictions, present
from fleetpulse.session import spread
from fleetpulse.sources.readings import READING_SCHEMA
from fleetpulse.sources.registry import Model
from fleetpulse.streaming import kernel
from fleetpulse.streaming.sink import BatchLog

PREDICTION, LATE, INVALID = "prediction", "late", "invalid"
SIDE_SCHEMA = StructType([*READING_SCHEMA.fields, StructField("reason", StringType())])

STATE_SCHEMA = (
    "last_ts long, tick long, emissions long, level double, variance double, "
    "recent array<double>, seeds array<double>, trend_x array<double>, trend_y array<double>, "
    "candidate int, streak int, held int, runs long"
)
EMPTY_STATE = (-(1 << 62), 0, 0, 0.0, 0.0, [], [], [], [], 0, 0, 0, 0)
#: Microseconds of a span: the waiting readings are handled in such pieces.
SPAN = 12 * 3600 * 1_000_000
#: Arrivals that are written as one run, readings of a page, and of one prediction; a page or a prediction may hold more.
RUN_ROWS, PAGE_ROWS, PIECE_ROWS = 262_144, 4_096, 16_384
OUTPUT_SCHEMA = (
    "asset_id string, ts timestamp, status string, reason string, vibration double, current double, temperature double, "
    "tick long, score double, health_raw double, output long, level double, n_fit long, slope double, "
    "residual double, sxx double, by_health boolean, streak int, held int, "
    + ", ".join(f"{f} double" for f in FEATURES)
)
OUTPUT_COLUMNS = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]
PENDING_COLUMNS = (*SENSORS, "baseline_mean", "baseline_std")


class MonitorProcessor(StatefulProcessor):
    """``scorer`` maps a (rows x features) array to scores."""

    def __init__(self, scorer: Any, cfg: EngineConfig, clean: bool):
        self.scorer, self.cfg, self.clean = scorer, cfg, clean
        self.ordered: list[tuple[np.ndarray, np.ndarray]] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("monitor", STATE_SCHEMA)
        self.waiting = handle.getMapState("waiting", "span long, run long", "readings binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s, arrived, n = self._load(), [], 0
        for batch in rows:
            no_place = batch["ts"].isna() | (key[0] is None)
            if no_place.any():
                yield from self._without_place(key[0], batch[no_place])
            batch = batch[~no_place]
            ts = batch["ts"].to_numpy("datetime64[us]").astype(np.int64)
            late = ts <= s["last_ts"]
            if late.any():
                yield self._side(key[0], batch[list(SENSORS)].to_numpy(float)[late], ts[late], LATE, "behind the last handled reading")
            arrived.append((batch[list(PENDING_COLUMNS)].to_numpy(float)[~late], ts[~late]))
            n += len(arrived[-1][1])
            if n >= RUN_ROWS:
                self._wait(s, *map(np.concatenate, zip(*arrived)))
                arrived, n = [], 0
        if n:
            self._wait(s, *map(np.concatenate, zip(*arrived)))
        yield from self._release(key[0], s, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._release(key[0], self._load(), timerValues.getCurrentWatermarkInMs() * 1000)

    # -- one asset ---------------------------------------------------------

    def _without_place(self, asset: str | None, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows without an asset or a time are set aside as they came."""
        side = self._side(asset, batch[list(SENSORS)].to_numpy(float), np.zeros(len(batch), np.int64), INVALID, "no asset")
        side["ts"] = batch["ts"].to_numpy()
        if asset is not None:
            side["reason"] = "no time"
        yield side

    def _load(self) -> dict:
        names = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
        return dict(zip(names, self.state.get() if self.state.exists() else EMPTY_STATE))

    def _wait(self, s: dict, values: np.ndarray, ts: np.ndarray) -> None:
        """Write readings as a run; each page begins with the first reading of a span."""
        order = np.argsort(ts, kind="stable")
        values, ts = values[order], ts[order]
        starts = _span_starts(ts)
        s["runs"], a = s["runs"] + 1, 0
        while a < len(ts):
            later = np.searchsorted(starts, a + PAGE_ROWS)
            b = int(starts[later]) if later < len(starts) else len(ts)
            self.waiting.updateValue((int(ts[a] // SPAN), s["runs"]), (ts[a:b].tobytes() + values[a:b].tobytes(),))
            a = b

    def _take(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The readings of a page, which leave the state."""
        page = bytes(self.waiting.getValue(key)[0])
        self.waiting.removeKey(key)
        n = len(page) // (8 + 8 * len(PENDING_COLUMNS))
        return np.frombuffer(page, offset=8 * n).reshape(n, -1), np.frombuffer(page, np.int64, n)

    def _release(self, asset: str, s: dict, watermark: int) -> Iterator[pd.DataFrame]:
        """Handle what the watermark has passed, one span after the other, and wake up for the rest."""
        next_time, runs = None, defaultdict(list)
        for span, run in self.waiting.keys():
            runs[span].append(run)
        first = sorted(runs)
        values, ts = np.zeros((0, len(PENDING_COLUMNS))), np.zeros(0, dtype=np.int64)
        for i, span in enumerate(first):
            if span * SPAN > watermark:
                next_time = span * SPAN
                break
            values, ts = map(np.concatenate, zip((values, ts), *(self._take((span, run)) for run in sorted(runs[span]))))
            order = np.argsort(ts, kind="stable")
            values, ts = values[order], ts[order]
            # Pages that are still to be read hold nothing before the next one's first span.
            until = watermark if i + 1 == len(first) else min(watermark, first[i + 1] * SPAN - 1)
            n = int(np.searchsorted(ts, until, "right"))
            starts = _span_starts(ts[:n])
            for a, b in zip(starts, [*starts[1:], n]):
                yield from self._in_order(asset, s, values[a:b], ts[a:b])
                if sum(len(x) for _, x in self.ordered) >= PIECE_ROWS:
                    yield from self._predict_ordered(asset, s)
            values, ts = values[n:], ts[n:]
        yield from self._predict_ordered(asset, s)
        if len(ts):
            next_time = int(ts[0]) if next_time is None else min(next_time, int(ts[0]))
            n = int(np.searchsorted(ts, (ts[0] // SPAN + 1) * SPAN))  # the span that is asked next has a page of its own
            for rest in (slice(0, n), slice(n, None)):
                self._wait(s, values[rest], ts[rest])
        self.state.update(tuple(s.values()))
        if next_time is not None:
            wanted = int(next_time // 1000) + 1
            timers = list(self.handle.listTimers())
            for timer in timers:
                if timer != wanted:
                    self.handle.deleteTimer(timer)
            if wanted not in timers:
                self.handle.registerTimer(wanted)

    def _in_order(self, asset: str, s: dict, values: np.ndarray, ts: np.ndarray) -> list[pd.DataFrame]:
        """Put the readings of a span in order and set aside what is not to be predicted."""
        order = np.lexsort((values[:, 2], values[:, 1], values[:, 0], ts))  # NaN sorts last
        values, ts = values[order], ts[order]
        s["last_ts"] = int(ts[-1])
        out = []
        if self.clean:
            first = np.concatenate([[True], ts[1:] != ts[:-1]])
            values, ts = values[first], ts[first]
            v, c, t = values[:, 0], values[:, 1], values[:, 2]
            ok = (v >= MIN_VIBRATION) & (c >= MIN_CURRENT) & (t > TEMPERATURE_ABOVE) & (t < TEMPERATURE_BELOW)
            if not ok.all():
                missing = np.isnan(values[~ok, :3]).any(axis=1)
                why = np.where(missing, "missing sensor", "impossible reading")
                out.append(self._side(asset, values[~ok, :3], ts[~ok], INVALID, why))
            values, ts = values[ok], ts[ok]
        if len(ts):
            self.ordered.append((values, ts))
        return out

    def _predict_ordered(self, asset: str, s: dict) -> Iterator[pd.DataFrame]:
        """Predict the readings of handled spans together."""
        if self.ordered:
            values, ts = map(np.concatenate, zip(*self.ordered))
            self.ordered = []
            pieces = max(1, len(ts) // PIECE_ROWS)
            for part in zip(np.array_split(values, pieces), np.array_split(ts, pieces)):
                yield from self._predict(asset, s, *part)

    def _predict(self, asset: str, s: dict, values: np.ndarray, ts: np.ndarray) -> list[pd.DataFrame]:
        cfg, n = self.cfg, self.cfg.window_rows
        ticks = s["tick"] + 1 + np.arange(len(ts))
        s["tick"] = int(ticks[-1])
        recent = np.array(s["recent"], dtype=float).reshape(-1, len(SENSORS))
        readings = np.concatenate([recent, values[:, : len(SENSORS)]])
        s["recent"] = readings[-(n - 1) :].ravel().tolist()
        if len(readings) < n:
            return []
        features, usable = kernel.rolling_features(readings, n)
        finite = np.isfinite(features).all(axis=1)  # others are never scored, never fatal to the stream
        rows = np.arange(len(ts))[-len(features) :]
        bad = rows[usable & ~finite]
        aside = [self._side(asset, values[bad, :3], ts[bad], INVALID, "non-finite feature")] if len(bad) else []
        usable &= finite
        rows, features = rows[usable], features[usable]
        if not len(rows):
            return aside
        score = self.scorer(features)
        mean, std = values[rows, 3], values[rows, 4]
        health = 100.0 * (1.0 - np.clip((mean - score) / (cfg.health_spread * std), 0.0, 1.0))

        # seed the level, then filter
        missing = max(0, cfg.seed_readings - s["emissions"])
        s["emissions"] += len(rows)
        seeds = s["seeds"] + health[:missing].tolist()
        s["seeds"] = seeds if len(seeds) < cfg.seed_readings else []
        if s["emissions"] < cfg.seed_readings:
            return aside
        levels: list[float] = []
        if missing:
            s["level"], s["variance"] = float(np.mean(seeds)), cfg.measurement_var
            levels.append(s["level"])
        more, s["variance"] = kernel.level_updates(s["level"], s["variance"], health[missing:].tolist(), cfg)
        levels += more
        s["level"] = levels[-1]

        kept = rows[-len(levels) :]
        level = np.array(levels)
        x = np.concatenate([s["trend_x"], ticks[kept].astype(float)])
        y = np.concatenate([s["trend_y"], level])
        fits = kernel.trend_fits(x, y, len(level), cfg)
        s["trend_x"], s["trend_y"] = x[-(cfg.lookback - 1) :].tolist(), y[-(cfg.lookback - 1) :].tolist()

        outputs = s["emissions"] - (cfg.seed_readings - 1) - len(level) + 1 + np.arange(len(level))
        severity, by_health = kernel.raw_levels(outputs, level, fits, cfg)
        held, state = kernel.hold((s["candidate"], s["streak"], s["held"]), severity.tolist(), by_health.tolist(), cfg)
        s["candidate"], s["streak"], s["held"] = state

        out = self._frame(asset, values[kept, :3], ts[kept], PREDICTION)
        out["tick"], out["output"] = ticks[kept], outputs
        out["score"], out["health_raw"], out["level"] = score[-len(level) :], health[-len(level) :], level
        out["n_fit"], out["slope"] = fits[:, 0].astype(np.int64), fits[:, 1]
        out["residual"], out["sxx"] = np.where(np.isnan(fits[:, 1]), np.nan, fits[:, 2]), fits[:, 3]
        out["by_health"] = by_health
        out["streak"], out["held"] = zip(*held)
        for j, name in enumerate(FEATURES):
            out[name] = features[-len(level) :, j]
        return [out[OUTPUT_COLUMNS], *aside]

    def _frame(self, asset: str | None, sensors: np.ndarray, ts: np.ndarray, status: str, reason=None) -> pd.DataFrame:
        out = pd.DataFrame(sensors, columns=list(SENSORS))
        out["asset_id"], out["ts"], out["status"], out["reason"] = asset, pd.to_datetime(ts, unit="us"), status, reason
        return out

    def _side(self, asset: str | None, sensors: np.ndarray, ts: np.ndarray, status: str, reason) -> pd.DataFrame:
        out = self._frame(asset, sensors, ts, status, reason).reindex(columns=OUTPUT_COLUMNS)
        for c in ("tick", "output", "n_fit", "streak", "held"):
            out[c] = out[c].astype("Int64" if c not in ("streak", "held") else "Int32")
        out["by_health"] = out["by_health"].astype("boolean")
        return out


def _span_starts(ts: np.ndarray) -> np.ndarray:
    """Places in ascending times at which another span begins."""
    spans = ts // SPAN
    return np.flatnonzero(np.concatenate([np.ones(min(len(ts), 1), dtype=bool), spans[1:] != spans[:-1]]))


def monitor_stream(
    readings: DataFrame,
    model: Model,
    cfg: EngineConfig = DEFAULT,
    delay: str = "10 minutes",
    clean: bool = True,
    calibration: str = "auto",
    scorer: Any = None,
) -> DataFrame:
    """Streaming rows with ``status``: prediction, late or invalid, the last two with a ``reason``.

    Needs the RocksDB state store provider (see ``state_store``). ``scorer``
    replaces the forest by any function on a feature array.
    """
    values = [nan_to_null(F.col(c)).alias(c) for c in SENSORS]
    anchored = pick_calibration(readings.select("asset_id", "ts", *values), model.pooled_row, model.local, calibration)
    # The operator gets a plain copy of the time: on the watermarked column
    # itself Spark drops late rows silently, and they are to be reported.
    anchored = anchored.withColumn("event_time", F.col("ts")).withWatermark("event_time", delay)
    anchored = anchored.select("asset_id", "ts", *PENDING_COLUMNS)
    if scorer is None:
        # About a megabyte whatever the fleet; the worker that plans stateful
        # queries cannot read broadcast variables, so it travels with the code.
        scorer = PackedForest(model.nodes).score
    return anchored.groupBy("asset_id").transformWithStateInPandas(
        MonitorProcessor(scorer, cfg, clean), OUTPUT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def finish(rows: DataFrame, model: Model, cfg: EngineConfig = DEFAULT, calibration: str = "auto") -> DataFrame:
    """Predictions of ``monitor_stream`` rows in the batch output form."""
    d = rows.filter(F.col("status") == PREDICTION).drop("status", "reason")
    d = d.withColumn("slope", nan_to_null(F.col("slope"))).withColumn("residual", nan_to_null(F.col("residual")))
    d = policy.add_recommendation(add_forecast(d, "output", cfg), cfg)
    decided = policy.report_levels(d, cfg)
    return present(decided.withColumn("calibration_source", F.lit("")), model, cfg, calibration)


def state_store(spark) -> None:
    """State lives in RocksDB on the executors, checkpointed to shared storage."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def output_log(spark, output: str, table: str, run_id: str = "run") -> BatchLog:
    """Predictions, late or invalid rows of one run."""
    return BatchLog(spark, f"{output}/{table}/run_id={run_id}", SIDE_SCHEMA if table in (LATE, INVALID) else None)


def read_output(spark, output: str, table: str, run_id: str = "run") -> DataFrame:
    return output_log(spark, output, table, run_id).read()


def start(
    readings: DataFrame,
    model: Model,
    output: str,
    checkpoint: str,
    cfg: EngineConfig = DEFAULT,
    run_id: str = "run",
    trigger: dict | None = None,
    **options,
):
    """Run the monitor into ``output``/predictions, /late and /invalid.

    Each is a ``BatchLog`` of the run: a batch repeated after a failure does not
    repeat its rows, batches without rows leave no files, and old batches are
    merged. ``read_output`` reads them. Event time and processing time are both
    kept. Default trigger: every 60 seconds.
    """
    spark = readings.sparkSession
    state_store(spark)
    rows = monitor_stream(readings, model, cfg, **options)
    mode = options.get("calibration", "auto")

    def write(batch: DataFrame, batch_id: int) -> None:
        # An asset's rows come from one task; what follows goes row by row and is spread over all.
        batch = spread(batch, "asset_id", "ts").persist()
        try:
            flat = flatten_predictions(finish(batch, model, cfg, mode), cfg)
            output_log(spark, output, "predictions", run_id).write(flat.withColumn("processed_at", F.current_timestamp()), batch_id)
            for status in (LATE, INVALID):
                side = batch.filter(F.col("status") == status).select("asset_id", "ts", *SENSORS, "reason")
                output_log(spark, output, status, run_id).write(side, batch_id)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()
