from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.plans.monitoring import flatten_predictions, monitor_batch
from fleetpulse.sources.readings import READING_SCHEMA, stream_table
from fleetpulse.streaming import monitor
from fleetpulse.streaming.monitor import start
from helpers import minute, readings, stand_in
from test_monitor import QUICK, fleet, scorer


def array_scorer():
    # made inside a function, so that it travels to workers by value
    return lambda x: -0.44 - 0.07 * np.maximum(0.0, x[:, 0])


def run(spark, folder, max_files=1):
    source = stream_table(spark, f"{folder}/in", max_files)
    start(
        source, stand_in(spark), f"{folder}/out", f"{folder}/checkpoint", QUICK, scorer=array_scorer(), trigger={"availableNow": True}
    ).awaitTermination()


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(1.1)  # files are taken in order of their whole-second times


def closing(spark):
    """A later reading moves the watermark past everything before it."""
    return spark.createDataFrame([("end", minute(10_000_000), 1.0, 1.0, 20.0)], READING_SCHEMA)


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_batch(spark, tmp_path, parts):
    """Files one by one, with a restart from the checkpoint half way."""
    folder, df = str(tmp_path), fleet(spark, 300)
    for i in range(parts):
        put(df.filter(F.expr(f"unix_timestamp(ts) - unix_timestamp(timestamp'2024-01-01') between {i * 18000 // parts} and {(i + 1) * 18000 // parts - 1}")), folder)
        if i == 0:
            run(spark, folder)
    put(closing(spark), folder)
    run(spark, folder)
    want = flatten_predictions(monitor_batch(df, stand_in(spark), QUICK, scorer=scorer), QUICK)
    got = monitor.read_output(spark, f"{folder}/out", "predictions").select(*want.columns)
    a, b = want.toPandas(), got.toPandas()
    key = ["asset_id", "ts"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) > 300
    for c in a.columns:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], atol=0.0101 if c in ("health_raw", "health_state") else 1.01e-4)
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_late_and_invalid_rows(spark, tmp_path):
    folder = str(tmp_path)
    first = readings(spark, {"a": [(1.0 + i % 3, 2.0, 30.0 + i % 2) for i in range(60)]})
    shuffled = first.withColumn("vibration", F.when(F.col("ts") == F.lit(minute(20)), -1.0).otherwise(F.col("vibration"))).orderBy(F.rand(3))
    put(shuffled, folder)
    run(spark, folder)
    put(spark.createDataFrame([("a", minute(5), 9.0, 9.0, 9.0), ("a", minute(70), 1.0, 2.0, 30.0)], READING_SCHEMA), folder)
    put(closing(spark), folder)
    run(spark, folder)
    late = monitor.read_output(spark, f"{folder}/out", "late").select("asset_id", "ts", "vibration").collect()
    assert [tuple(r) for r in late] == [("a", minute(5), 9.0)]
    invalid = monitor.read_output(spark, f"{folder}/out", "invalid").select("ts", "vibration").collect()
    assert [tuple(r) for r in invalid] == [(minute(20), -1.0)]


class Waiting(dict):
    """Map state without Spark."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__


class Timers(list):
    listTimers, registerTimer, deleteTimer = list.copy, list.append, list.remove


class Watermark:
    def __init__(self, micros):
        self.micros = micros

    def getCurrentWatermarkInMs(self):
        return self.micros // 1000


def test_a_backlog_of_one_asset_leaves_in_bounded_pieces(monkeypatch):
    """A million shuffled readings arrive before the watermark moves; then it passes them in two steps."""
    p = monitor.MonitorProcessor(None, QUICK, True)
    p.handle, p.waiting = Timers(), Waiting()
    held = {"s": dict(zip([c.split()[0] for c in monitor.STATE_SCHEMA.split(", ")], monitor.EMPTY_STATE))}
    p.state = type("State", (), {"update": lambda self, v: held.update(s=dict(zip(held["s"], v)))})()
    monkeypatch.setattr(p, "_load", lambda: dict(held["s"]))
    handled, sizes = [], []

    def in_order(asset, s, values, ts):
        handled.append(np.sort(ts))
        sizes.append(len(ts))
        s["last_ts"] = int(ts.max())
        return []

    monkeypatch.setattr(p, "_in_order", in_order)
    n, minute_us = 1_000_000, 60_000_000

    def batches():
        for start in np.random.default_rng(0).permutation(n // 10_000) * 10_000:
            ts = (start + np.random.default_rng(start).permutation(10_000)) * minute_us
            yield pd.DataFrame({"ts": pd.to_datetime(ts, unit="us"), **{c: 1.0 for c in monitor.PENDING_COLUMNS}})

    assert list(p.handleInputRows(("a",), batches(), Watermark(-1))) == [] and not handled
    assert p.handle == [1]
    per_span = monitor.SPAN // minute_us
    half = 500_000 * minute_us + 30_000_000
    assert list(p.handleExpiredTimer(("a",), Watermark(half), None)) == []
    assert sum(sizes) == 500_001 and max(sizes) <= per_span and p.handle == [500_001 * 60_000 + 1]
    list(p.handleExpiredTimer(("a",), Watermark(n * minute_us), None))
    every = np.concatenate(handled)
    assert len(every) == n and (np.diff(every) == minute_us).all() and max(sizes) <= per_span and not p.waiting


class Counted(Waiting):
    """Map state that notes the bytes of what is written."""

    def __init__(self):
        super().__init__()
        self.pages, self.bytes = 0, 0

    def updateValue(self, key, value):
        self.pages, self.bytes = self.pages + 1, self.bytes + len(value[0])
        self[key] = value


def shuffled_batches(n, step_us):
    ts = np.random.default_rng(1).permutation(n) * step_us
    for a in range(0, n, 10_000):
        yield pd.DataFrame({"ts": pd.to_datetime(ts[a : a + 10_000], unit="us"), **{c: 1.0 for c in monitor.PENDING_COLUMNS}})


@pytest.mark.parametrize("step_us", [2_000_000, 600_000_000])
def test_what_waits_is_written_once(monkeypatch, step_us):
    """Arrivals in no order: dense or sparse in time, a reading goes to state once, in few pages."""
    p = monitor.MonitorProcessor(None, QUICK, True)
    p.handle, p.waiting = Timers(), Counted()
    state = dict(zip([c.split()[0] for c in monitor.STATE_SCHEMA.split(", ")], monitor.EMPTY_STATE))
    p.state = type("State", (), {"update": lambda self, v: None})()
    monkeypatch.setattr(p, "_load", lambda: state)
    predicted = []
    monkeypatch.setattr(p, "_predict", lambda asset, s, values, ts: predicted.append(ts) or [])
    n = 600_000
    assert list(p.handleInputRows(("a",), shuffled_batches(n, step_us), Watermark(-1))) == []
    assert p.waiting.bytes == n * 8 * (1 + len(monitor.PENDING_COLUMNS)) and p.waiting.pages <= n // monitor.PAGE_ROWS + 3
    half = n // 2 * step_us + 1
    assert list(p.handleExpiredTimer(("a",), Watermark(half), None)) == []
    assert sum(map(len, predicted)) == n // 2 + 1
    list(p.handleExpiredTimer(("a",), Watermark(n * step_us), None))
    every = np.concatenate(predicted)
    assert len(every) == n and (np.diff(every) == step_us).all() and not p.waiting
    assert max(map(len, predicted[:-1])) >= monitor.PIECE_ROWS // 2
