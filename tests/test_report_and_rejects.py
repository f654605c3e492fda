"""The report by asset against the fleet's, importance against whole walks, rejected text."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.catalog.queries import fixed_nodes
from fleetpulse.config import DEFAULT, FEATURES
from fleetpulse.operators import evaluate as E
from fleetpulse.operators.diagnostics import Alternatives, permutation_importance
from fleetpulse.operators.forest import PRIME, PackedForest, fit_forest, linear_hash, row_hash
from fleetpulse.sources.readings import read_csv_checked
from test_forest import feature_rows

HEADER = "timestamp,vibration_mps2,current_ampere,temperature_c,health_status"


def test_read_and_rejected_are_all_lines(spark, tmp_path):
    lines = [
        "2024-01-01T00:00:00,1.5,2,30,normal", "2024-01-01T00:01:00,,2,30,normal", "soon,1,2,30,normal", "2024-01-01T00:03:00,x,y,30,warning",
        "2024-01-01T00:04:00,1,2", "2024-01-01T00:05:00,1,2,30,normal,more", ",1,2,30,normal", "2024-01-01T00:07:00,nan,1e3, ,normal",
    ]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    (tmp_path / "b.csv").write_text(HEADER + "\n")
    read, rejected = read_csv_checked(spark, str(tmp_path), "pump", label=True)
    assert read.columns == ["asset_id", "ts", "vibration", "current", "temperature", "health_status"]
    rows = {r.reasons[0]: r for r in rejected.collect()}
    assert read.count() + rejected.count() == len(lines)
    assert rows["no time: timestamp"].raw == {"timestamp": "soon"} and rows["no time: timestamp"].ts is None
    both = rows["no number: vibration_mps2"]
    assert both.reasons == ["no number: vibration_mps2", "no number: current_ampere"] and both.raw == {"vibration_mps2": "x", "current_ampere": "y"}
    short = rejected.filter(F.array_contains("reasons", "wrong number of fields"))
    assert {r.line for r in short.collect()} == {lines[4], lines[5]}
    assert {(r.file.rsplit("/", 1)[1], r.block_start) for r in rejected.collect()} == {("a.csv", 0)}
    kept = {str(r.ts): r for r in read.collect()}
    assert len(kept) == 4 and kept["2024-01-01 00:01:00"].vibration is None and kept["2024-01-01 00:07:00"].temperature is None
    with pytest.raises(ValueError, match="missing required columns"):
        (tmp_path / "odd").mkdir()
        (tmp_path / "odd" / "c.csv").write_text("timestamp,current_ampere\n1,2\n")
        read_csv_checked(spark, str(tmp_path / "odd"))


def test_ranking_by_asset_equals_one_asset_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{i % 4}" if i % 11 else None, int(rng.random() < 0.3), float(np.round(rng.normal(), 1) * 3)) for i in range(900)]
    rows += [("only good", 0, 0.5)] * 5
    df = spark.createDataFrame(rows, "asset_id string, y int, s double")
    got = {r["scope"]: (r["roc_auc"], r["average_precision"]) for r in E.scoped_ranking(df, "y", "s", "fleet").collect()}
    assert set(got) == {None, "a0", "a1", "a2", "a3", "only good", "fleet"} and got["only good"] == (None, None)
    for name, own in [("fleet", df), ("a2", df.filter("asset_id = 'a2'")), (None, df.filter("asset_id IS NULL"))]:
        assert got[name] == pytest.approx(tuple(E.ranking_metrics(own, "y", "s").first()))


def test_sums_and_calibration_error_by_asset(spark):
    rng = np.random.default_rng(4)
    names = ["asset_id", "y_health", "pred_health", "y_failure", "failure_prob", "pred_maintenance"]
    rows = [(f"a{i % 3}", *map(int, rng.integers(0, 2, 3)), float(rng.random()), int(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, names)
    scoped = E.section_sums(df).withColumn("scope", E.scope("fleet", "is_fleet"))
    for name, own in [("fleet", df), ("a1", df.filter("asset_id = 'a1'"))]:
        mine = scoped.filter(F.col("scope") == name)
        assert tuple(E.rates_of(mine, "health").drop("scope").first()) == tuple(E.binary_metrics(E.confusion(own, "y_health", "pred_health")).first())
        assert mine.first()["brier"] == pytest.approx(E.brier(own, "y_failure", "failure_prob").first()[0])
        error = E.scoped_calibration_error(df, "fleet").filter(F.col("scope") == name).first()["ece"]
        assert error == pytest.approx(E.expected_calibration_error(own, "y_failure", "failure_prob").first()[0])
    raw = spark.createDataFrame([("a0", 150), ("a1", 100), ("a2", 101), ("short", 3), ("fleet", 354)], "scope string, n_raw long")
    counts = {r["scope"]: tuple(r)[1:4] for r in E.scoped_counts(raw, scoped).collect()}
    assert counts["short"] == (3, 0, 3) and counts["fleet"] == (354, 300, 54)


@pytest.mark.parametrize("fixed", [True, False])
def test_importance_equals_walking_every_tree_again(spark, fixed):
    df = feature_rows(spark, 300)
    cfg = replace(DEFAULT, n_trees=9, tree_sample=64)
    nodes = fixed_nodes() if fixed else fit_forest(df, 300, cfg).toPandas()
    forest, repeats = PackedForest(nodes), 3
    got = {r["feature"]: r for r in permutation_importance(df, nodes, 300, repeats=repeats, cfg=cfg).collect()}
    rows = df.withColumn("h", row_hash()).toPandas()
    (ga, gb), (pa, pb) = linear_hash("42|group"), linear_hash("42|place")
    rows["g"], rows["p"] = (rows.h * ga + gb) % PRIME % 2, (rows.h * pa + pb) % PRIME
    total = dict.fromkeys(FEATURES, 0.0)
    for _, group in rows.groupby("g"):
        group = group.sort_values(["p", "asset_id", "ts"])
        x, h = group[list(FEATURES)].to_numpy(), group.h.to_numpy()
        base = forest.score(x)
        for j, f in enumerate(FEATURES):
            for r in range(repeats):
                a, b = linear_hash(f"42|donor|{f}|{r}")
                y = x.copy()
                y[:, j] = x[np.argsort((h * a + b) % PRIME, kind="stable"), j]
                total[f] += np.abs(forest.score(y) - base).sum()
    for f in FEATURES:
        assert got[f]["importance"] == pytest.approx(total[f] / (300 * repeats), abs=1e-14)
    shares = [got[f]["walk_share"] for f in FEATURES]
    assert max(shares) < 0.5 and sum(shares) <= forest.depth  # a path meets at most as many features as it is deep


def test_one_look_gives_the_total_for_any_value_of_a_feature(spark):
    """Rows, values beyond every threshold and on one; no path is walked for a value."""
    df = feature_rows(spark, 200)
    nodes = fit_forest(df, 200, replace(DEFAULT, n_trees=5, tree_sample=64)).toPandas()
    x, forest, steps = df.select(*FEATURES).toPandas().to_numpy()[:40], PackedForest(nodes), Alternatives(nodes, len(FEATURES))
    base = forest.score(x)
    for value in (-1e9, 0.0, float(nodes.loc[nodes["feature"] >= 0, "threshold"].iloc[0]), 1e9):
        given = steps.slots(np.full_like(x, value))[:, None, :]
        sums, met = steps.changes(x, given)
        for j in range(len(FEATURES)):
            y = x.copy()
            y[:, j] = value
            assert sums[j] == pytest.approx(np.abs(forest.score(y) - base).sum(), abs=1e-12)
    assert 0 < met.max() <= 5 * len(x)
