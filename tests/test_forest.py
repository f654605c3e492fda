from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataclasses import replace

from fleetpulse.catalog.queries import fixed_nodes
from fleetpulse.config import DEFAULT, FEATURES
from fleetpulse.operators import forest
from fleetpulse.operators.forest import (
    PRIME, PackedForest, expected_path, finite_features, fit_forest, grow_tree, score_rows, tree_hashes, tree_samples, uniform,
)
from fleetpulse.operators.health import calibrate, health_from_score, pick_calibration
from helpers import minute


def feature_rows(spark, n, outliers=0, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, len(FEATURES)))
    x[:outliers] += 8
    pdf = pd.DataFrame(x, columns=list(FEATURES))
    pdf.insert(0, "ts", [minute(i) for i in range(n)])
    pdf.insert(0, "asset_id", [f"a{i % 3}" for i in range(n)])
    return spark.createDataFrame(pdf)


def walk(nodes, x):
    """Depth plus leaf correction, one node at a time."""
    total = 0.0
    for _, tree in nodes.groupby("tree_id"):
        rows = tree.set_index("node_id")
        node = rows.loc[0]
        while node["feature"] >= 0:
            node = rows.loc[int(node["left"] if x[int(node["feature"])] <= node["threshold"] else node["right"])]
        total += node["depth"] + float(expected_path(node["n_samples"]))
    sample = nodes.loc[nodes["depth"] == 0, "n_samples"].max()
    return -(2 ** (-total / nodes["tree_id"].nunique() / float(expected_path(sample))))


def test_expected_path():
    assert expected_path(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    assert float(expected_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_packed_scores_equal_walk(spark):
    cfg = replace(DEFAULT, n_trees=7, tree_sample=64)
    df = feature_rows(spark, 300)
    nodes = fit_forest(df, 300, cfg).toPandas()
    x = df.select(*FEATURES).toPandas().to_numpy()
    np.testing.assert_allclose(PackedForest(nodes).score(x)[:40], [walk(nodes, r) for r in x[:40]], atol=1e-12)
    fixed = fixed_nodes()
    np.testing.assert_allclose(PackedForest(fixed).score(x)[:40], [walk(fixed, r) for r in x[:40]], atol=1e-12)


@pytest.mark.parametrize("n", [1, 150, 256, 3000, 30000])
def test_every_tree_gets_the_smallest_ranks(spark, n):
    cfg = replace(DEFAULT, n_trees=20)
    df = feature_rows(spark, n)
    got = tree_samples(df, n, cfg).select("tree_id", "rank", "asset_id", "ts").toPandas()
    hashes = np.array([int(hashlib.md5(f"a{i % 3}|{int(pd.Timestamp(minute(i)).value // 1000)}".encode()).hexdigest()[:8], 16) % PRIME for i in range(n)])
    for t, (a, b) in enumerate(tree_hashes(cfg.seed, cfg.n_trees)):
        ranks = np.sort((hashes * a + b) % PRIME)
        mine = np.sort(got.loc[got.tree_id == t, "rank"].to_numpy())
        k = min(256, n)
        assert len(mine) >= k and (mine[:k] == ranks[:k]).all()
        assert len(mine) < 2.5 * k + 60  # the bound leaves little that is not sampled


def test_a_bound_that_is_too_low_is_doubled(spark, monkeypatch):
    cfg = replace(DEFAULT, n_trees=5)
    df = feature_rows(spark, 2000)
    want = forest.tree_samples(df, 2000, cfg).toPandas()
    monkeypatch.setattr(forest, "sqrt", lambda x: -0.09 * x)  # far too few
    got = forest.tree_samples(df, 2000, cfg).toPandas()
    for t in range(5):
        a, b = (np.sort(x.loc[x.tree_id == t, "rank"])[:256] for x in (want, got))
        assert (a == b).all() and len(a) == 256


def test_samples_are_uniform_and_independent(spark):
    """Every row is drawn equally often, and by pairs of trees as independent draws would."""
    cfg = replace(DEFAULT, n_trees=200)
    n, k = 4000, 256
    got = tree_samples(feature_rows(spark, n), n, cfg).select("tree_id", "rank", "asset_id", "ts").toPandas()
    chosen = got.sort_values(["rank", "asset_id", "ts"]).groupby("tree_id").head(k)
    times = chosen.groupby("ts").size().reindex([minute(i) for i in range(n)], fill_value=0).to_numpy()
    want = cfg.n_trees * k / n
    chi = ((times - want) ** 2 / (want * (1 - k / n))).sum()
    assert abs(chi - n) < 6 * np.sqrt(2 * n)
    sets = [set(g.ts) for _, g in chosen.groupby("tree_id")]
    shared = np.array([len(a & b) for i, a in enumerate(sets) for b in sets[:i]])
    assert abs(shared.mean() - k * k / n) < 0.5 and shared.max() < 60


def test_nodes_follow_from_the_rows(spark):
    """Level-wise places, draws and splits against a recursive build."""
    cfg = replace(DEFAULT, n_trees=3, tree_sample=40)
    df = feature_rows(spark, 90)
    nodes = {(r.tree_id, r.node_id): r for r in fit_forest(df, 90, cfg).collect()}
    sampled = tree_samples(df, 90, cfg).toPandas()
    seen = set()

    def check(tree, node, rows, depth):
        seen.add((tree, node))
        mine = nodes[tree, node]
        assert (mine.n_samples, mine.depth) == (len(rows), depth)
        spread = [j for j in range(rows.shape[1]) if len(rows) > 1 and rows[:, j].max() > rows[:, j].min()]
        if depth == 6 or not spread:
            assert mine.feature == -1
            return
        j = spread[int(uniform(f"42|{tree}|{node}|feature") * len(spread))]
        cut = rows[:, j].min() + uniform(f"42|{tree}|{node}|threshold") * (rows[:, j].max() - rows[:, j].min())
        assert (mine.feature, mine.threshold, mine.left, mine.right) == (j, cut, 2 * node + 1, 2 * node + 2)
        check(tree, 2 * node + 1, rows[rows[:, j] <= cut], depth + 1)
        check(tree, 2 * node + 2, rows[rows[:, j] > cut], depth + 1)

    for t in range(3):
        own = sampled[sampled.tree_id == t].sort_values(["rank", "asset_id", "ts"]).head(40)
        check(t, 0, own[list(FEATURES)].to_numpy(), 0)
    assert seen == set(nodes)


def test_values_that_differ_by_rounding_do_not_split():
    x = np.ones((5, 3))
    x[:, 1] += np.arange(5) * 1e-16
    x[:, 2] = np.arange(5)
    assert {n[1] for n in grow_tree(x, "42|0", 3)} <= {2, -1}
    assert grow_tree(x[:, :2], "42|0", 3) == [(0, -1, 0.0, -1, -1, 5, 0)]


def test_outliers_rank_lowest_and_seed_decides(spark):
    df = feature_rows(spark, 2000, outliers=20)
    a = fit_forest(df.repartition(2), 2000).toPandas().sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    b = fit_forest(df.repartition(8), 2000).toPandas().sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    assert a["tree_id"].nunique() == 200 and a["depth"].max() <= 8
    scored = score_rows(df, a).select("ts", "score").orderBy("score").toPandas()
    assert scored["score"].between(-1, 0, inclusive="left").all()
    assert set(scored["ts"][:20]) == {pd.Timestamp(minute(i)) for i in range(20)}
    assert len(PackedForest(a).__getstate__()) < 500_000


def test_non_finite_is_refused(spark):
    df = feature_rows(spark, 50).withColumn("current_rms", F.when(F.col("ts") == F.lit(minute(7)), float("nan")).otherwise(F.col("current_rms")))
    with pytest.raises(Exception, match="current_rms"):
        score_rows(df, fixed_nodes()).select("score").collect()
    assert df.filter(finite_features()).count() == 49


def test_calibration_and_health(spark):
    df = feature_rows(spark, 30).withColumn("score", F.lit(-0.4)).withColumn("current_rms", F.lit(2.0))
    row = calibrate(df).first()
    assert row["baseline_std"] == 1e-6 and row["feat_std"]["current_rms"] is None
    assert row["feat_mean"]["current_rms"] == 2.0
    local = calibrate(df.withColumn("score", F.lit(-0.5)), by_asset=True).filter("scope = 'a1'")
    picked = pick_calibration(df, calibrate(df), local).groupBy("asset_id", "calibration_source").agg(F.round(F.min("baseline_mean"), 9)).collect()
    assert sorted(map(tuple, picked)) == [("a0", "pooled (no local)", -0.4), ("a1", "local", -0.5), ("a2", "pooled (no local)", -0.4)]
    forced = pick_calibration(df, calibrate(df), local, "pooled").agg(F.min("baseline_mean")).first()[0]
    assert forced == pytest.approx(-0.4)
    with pytest.raises(Exception, match="no local calibration for"):
        pick_calibration(df, calibrate(df), local, "local").select("calibration_source").collect()
    scores = spark.createDataFrame([(-0.54,), (-0.2,), (-0.9,)], "s double").select(health_from_score(F.col("s"), F.lit(-0.44), F.lit(0.05)))
    assert [r[0] for r in scores.collect()] == pytest.approx([50.0, 100.0, 0.0])


def test_many_rows_reach_the_leaves_that_few_rows_reach():
    """Node by node or level by level: the same scores, bit by bit, ties with thresholds and NaN among them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, len(FEATURES))).round(2)
    for size in (2, 256, 1000):  # the last needs leaf numbers above 255
        columns = ["node_id", "feature", "threshold", "left", "right", "n_samples", "depth"]
        trees = [pd.DataFrame(grow_tree(x[rng.choice(len(x), size, False)], f"7|{t}", 10 if size > 256 else 8), columns=columns) for t in range(9)]
        nodes = pd.concat([t.assign(tree_id=i, threshold=t["threshold"].round(2)) for i, t in enumerate(trees)])
        forest = PackedForest(nodes)
        odd = x.copy()
        odd[::7, 3], odd[1::7, 4] = np.nan, np.inf
        for rows in (x, odd):
            few = np.concatenate([forest.score(rows[a : a + 1000]) for a in range(0, len(rows), 1000)])
            assert (forest.score(rows) == few).all()
            leaves = zip(forest._leaves(rows[:50]), forest._leaves_by_node(rows[:50]))
            assert all((a == b).all() for a, b in leaves)


def test_trees_of_a_row_are_found_in_whole_batches():
    """For every hash, the largest among them, the trees whose rank is below the bound, as whole numbers say."""
    hashes = tree_hashes(3, 40)
    numbers = np.concatenate([[0, 1, PRIME - 1], np.random.default_rng(2).integers(0, PRIME, 2_000)])
    # a rank of exactly 0 follows from h = -second / first
    numbers = np.append(numbers, [(-b * pow(a, -1, PRIME)) % PRIME for a, b in hashes])
    for below in (1, PRIME // 50, PRIME):
        want = [[t for t, (a, b) in enumerate(hashes) if (int(h) * a + b) % PRIME < below] for h in numbers]
        assert forest._trees_below(numbers, hashes, below) == want
