from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.catalog import queries
from fleetpulse.config import DEFAULT
from fleetpulse.operators import explain, policy
from fleetpulse.plans.monitoring import debounce_levels
from fleetpulse.streaming.kernel import hold


def recommend(spark, rows):
    df = spark.createDataFrame(rows, "level double, remaining_days int, fail_prob_1d double, trend_trusted boolean")
    return [(r["raw_level"], r["raw_trigger"], r["raw_reason"]) for r in policy.add_recommendation(df).collect()]


def test_rules(spark):
    got = recommend(
        spark,
        [(25.0, 3, 0.85, True), (25.0, 3, 0.85, False), (20.0, 0, 0.9, True), (30.0, 9, 0.1, True), (40.0, 9, 0.6, True), (40.0, 9, 0.605, True), (31.0, 9, 0.59, True)],
    )
    assert [g[:2] for g in got] == [
        (2, "trend_probability"), (1, "health_inspect"), (2, "health_threshold"), (1, "health_inspect"),
        (1, "trend_probability"), (1, "trend_probability"), (0, "none"),
    ]
    assert got[0][2] == "Failure probability within 1d is 85% (est. 3d remaining at current trend)."
    assert got[1][2] == "Health (25.0%) below inspection threshold."
    assert " is 60% " in got[5][2] and got[5][2].endswith("— schedule maintenance.")


def test_closest_horizon(spark):
    df = spark.sql("SELECT map(0.25D, 0.1D, 0.75D, 0.3D) AS m, map(0.5D, 0.2D, 1.0D, 0.4D) AS n")
    assert tuple(df.select(policy.policy_probability(F.col("m")), policy.policy_probability(F.col("n"))).first()) == (0.3, 0.4)


def sequences(n, length, seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        levels = np.repeat(rng.integers(0, 3, length), rng.integers(1, 20, length))[:length]
        health = rng.random(length) < rng.choice([0.0, 0.02, 0.2])
        out[f"s{i:03d}"] = (levels.tolist(), (health & (levels > 0)).tolist())
    return out


def frame(spark, data):
    rows = [
        (k, i, int(l), ("health_inspect" if l == 1 else "health_threshold") if h else ("trend_probability" if l else "none"), f"r{l}")
        for k, (ls, hs) in data.items()
        for i, (l, h) in enumerate(zip(ls, hs), 1)
    ]
    return spark.createDataFrame(rows, "asset_id string, output long, raw_level int, raw_trigger string, raw_reason string")


def sequential(levels, health):
    """The rules one tick after another."""
    candidate, count, reported, out = 0, 0, 0, []
    for level, instant in zip(levels, health):
        if instant:
            candidate, count = level, 1
            out.append(level)
            continue
        count = count + 1 if level == candidate else 1
        candidate = level
        if count >= (5 if level > reported else 15):
            reported = level
        out.append(reported)
    return [("OK", "WARN", "CRITICAL")[x] for x in out]


def levels_of(df):
    pdf = df.select("asset_id", "output", "maintenance_level").toPandas().sort_values("output")
    return {k: g["maintenance_level"].tolist() for k, g in pdf.groupby("asset_id")}


def test_debounce_equals_sequence(spark):
    data = sequences(400, 400)
    want = {k: sequential(*v) for k, v in data.items()}
    assert levels_of(policy.debounce(frame(spark, data))) == want
    for k, (ls, hs) in list(data.items())[:50]:
        rows, _ = hold((0, 0, 0), ls, hs, DEFAULT)
        assert [("OK", "WARN", "CRITICAL")[l if h else r] for l, h, (_, r) in zip(ls, hs, rows)] == want[k]


def test_debounce_in_blocks(spark):
    data = sequences(12, 700, seed=4)
    hot = replace(DEFAULT, hot_rows=100, block_rows=64)
    df = frame(spark, data)
    assert sorted(debounce_levels(df, hot).collect()) == sorted(debounce_levels(df).select(*debounce_levels(df, hot).columns).collect())
    assert levels_of(debounce_levels(df, hot)) == {k: sequential(*v) for k, v in data.items()}


def test_hold_text(spark):
    data = {"a": ([2] * 5 + [0] * 15, [False] * 20)}
    rows = {r["output"]: r for r in policy.debounce(frame(spark, data)).collect()}
    assert rows[4]["maintenance_level"] == "OK" and rows[5]["maintenance_level"] == "CRITICAL"
    assert rows[19]["maintenance_level"] == "CRITICAL" and rows[20]["maintenance_level"] == "OK"
    assert rows[6]["maintenance_reason"] == (
        "Holding at CRITICAL (trend-based) — latest tick reads OK, needs 14 more consecutive tick(s) to clear."
    )


def test_contributors(spark):
    df = spark.sql(
        "SELECT 1.0D AS a, -5.0D AS b, 3.0D AS c, 9.0D AS d, map('a', 0D, 'b', 0D, 'c', 0D, 'd', 0D) AS feat_mean,"
        " map('a', 1D, 'b', 1D, 'c', 1D, 'd', CAST(NULL AS DOUBLE)) AS feat_std"
    )
    row = df.select(explain.top_contributors(["a", "b", "c", "d"]).alias("t")).select(
        "t", explain.joined_contributors(F.col("t")).alias("j"), explain.summarize(F.col("t")).alias("s")
    ).first()
    assert [x["feature"] for x in row["t"]] == ["b", "c", "a"]
    assert row["j"] == "b (z=-5.0); c (z=+3.0); a (z=+1.0)"
    assert row["s"].startswith("driven mainly by b (z=-5.0), c")
    assert df.select(explain.z_scores(["a", "d"])).first()[0] == [1.0, 0.0]


def test_places_are_the_contributors(spark):
    """Ties, missing baselines, NaN and fewer features than asked for."""
    nan, features = float("nan"), ["a", "b", "c", "d"]
    rows = [(1.0, -2.0, 2.0, 0.5), (0.0, 0.0, 0.0, 0.0), (nan, 3.0, nan, -3.0), (-0.0, None, 1.0, nan)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").selectExpr(
        "*", "map('a', 0D, 'b', 0D, 'c', 0D, 'd', double(NULL)) AS feat_mean", "map('a', 1D, 'b', 1D, 'c', 1D, 'd', 1D) AS feat_std"
    )
    for k in (3, 9):
        cfg = replace(DEFAULT, top_k=k)
        both = explain.with_places(df, "places", features, cfg).select(
            explain.named_places(F.col("places"), features).alias("got"), explain.top_contributors(features, cfg).alias("want")
        )
        assert all(str(r.got) == str(r.want) and len(r.got) == min(k, 4) for r in both.collect())


def test_the_stand_in_builds_features_once(spark, monkeypatch, tmp_path):
    """One feature table for baselines and monitor; one model for the runs of a stream."""
    rows = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_seconds(id * 60) AS ts", "id * 7 AS user_id", "if(id % 2 = 0, 'view', 'click') AS event_type",
        "double(id * 37 % 101) AS value", "concat('{\"k\": ', id * 13 % 97, '}') AS props",
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    built, real, started = [], queries.build_features, []
    monkeypatch.setattr(queries, "build_features", lambda *a, **k: built.append(1) or real(*a, **k))
    assert queries.monitor_flat(spark, str(tmp_path)).count() == 2 * (200 - 9 - 14)
    assert len(built) == 1

    class Ended:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(queries.streaming, "start", lambda *a, **k: started.append(a[1]) or Ended())
    parts = [queries._events(spark, str(tmp_path))] * 3
    queries._streamed(spark, str(tmp_path), parts)
    assert len(built) == 2 and len(started) == 3
