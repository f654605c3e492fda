"""What the forest relies on, and which features repeat one another."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, FEATURES, EngineConfig
from fleetpulse.functions.columns import sensor_label, sensor_of
from fleetpulse.operators.forest import LEAF, PRIME, anomaly, check_finite, expected_path, linear_hash, row_hash

REPEATS = 20
REDUNDANT_ABOVE = 0.95
GROUP_ROWS = 256
STEP_ROWS = 32  # their step functions fit a processor's cache


def reference_features(features: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Feature rows the model was fitted on; untracked or unmatched is an error."""
    if reference is None:
        raise ValueError("the model has no recorded reference rows; retrain it")
    rows = features.join(reference.select("asset_id", "ts"), ["asset_id", "ts"], "left_semi")
    if rows.isEmpty():
        raise ValueError("reference rows match no feature row")
    return rows


def permutation_importance(
    reference: DataFrame,
    nodes: pd.DataFrame,
    n_rows: int,
    features: Sequence[str] = FEATURES,
    repeats: int = REPEATS,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Mean |score change| per feature when its values are shuffled, and ``walk_share``.

    Rows are dealt to groups of about GROUP_ROWS by hash and shuffled inside
    their group, so each row's donor is a uniform draw from the whole set, every
    row takes part in every repeat, and no value is gathered in one task.  The
    order of the donors is a linear hash of the row's own, one for each feature
    and repeat, so plain SQL finds the same donors.

    A shuffled feature changes a row's path only in trees that test it on that
    path; ``walk_share`` is the part of all paths that it can change.  No path is
    walked for a repeat: see ``Alternatives``.
    """
    spark = reference.sparkSession
    groups = max(1, ceil(n_rows / GROUP_ROWS))
    names, seed = list(features), cfg.seed
    forest = spark.sparkContext.broadcast(Alternatives(nodes, len(names)))
    donors = np.array([[linear_hash(f"{seed}|donor|{f}|{r}") for r in range(repeats)] for f in names])

    def importance(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "asset_id", "ts"])
        x, hashes = group[names].to_numpy(float), group["row_hash"].to_numpy()
        check_finite(x, names)
        given = np.array([own[order] for own, order in zip(forest.value.slots(x), donor_orders(hashes, donors))])
        changes, met = np.zeros(len(names)), np.zeros(len(names))
        for a in range(0, len(x), STEP_ROWS):
            part = forest.value.changes(x[a : a + STEP_ROWS], given[:, :, a : a + STEP_ROWS])
            changes, met = changes + part[0], met + part[1]
        return pd.DataFrame({"feature": names, "change": changes, "n": len(x) * repeats, "walks": met.astype(np.int64) * repeats})

    dealt = reference.select("asset_id", "ts", row_hash().alias("row_hash"), *names)
    of_group, of_place = linear_hash(f"{seed}|group"), linear_hash(f"{seed}|place")
    dealt = dealt.withColumn("group_id", F.pmod(F.pmod(F.col("row_hash") * of_group[0] + of_group[1], F.lit(PRIME)), F.lit(groups)))
    dealt = dealt.withColumn("place", F.pmod(F.col("row_hash") * of_place[0] + of_place[1], F.lit(PRIME)))
    # One exchange with a fixed width: scoring variants is CPU work.
    width = min(groups, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 64))
    parts = dealt.repartition(width, "group_id").groupBy("group_id").applyInPandas(
        importance, "feature string, change double, n long, walks long"
    )
    trees = int(nodes["tree_id"].nunique())
    return parts.groupBy("feature").agg(
        (F.sum("change") / F.sum("n")).alias("importance"), (F.sum("walks") / (F.sum("n") * trees)).alias("walk_share")
    )


def donor_orders(hashes: np.ndarray, donors: np.ndarray) -> Iterator[np.ndarray]:
    """For each feature the rows in the order of every repeat's hash, a row for each repeat; equal hashes stay in place."""
    place, bits = np.arange(len(hashes)), max(1, len(hashes).bit_length())
    for numbers in donors:
        ranks = (hashes * numbers[:, :1] + numbers[:, 1:]) % PRIME
        yield np.sort(ranks << bits | place, axis=1) & ((1 << bits) - 1)


class Alternatives:
    """What a row's total path length becomes when one of its features takes any other value.

    A leaf is within reach of a row by feature j alone if every test that the row
    fails on the way to it is one of j, whatever the order of the tests.  Going
    down all trees level by level with the set of features failed so far finds
    the leaves within reach of all features at once.  A leaf holds for values of
    j between two thresholds, the same for every row, so a row's total is a step
    function of j over the sorted thresholds of j of all trees: one running sum
    has it for every value, and a repeat costs one look.
    """

    def __init__(self, nodes: pd.DataFrame, n_features: int):
        at = {key: i for i, key in enumerate(zip(nodes["tree_id"], nodes["node_id"]))}
        trees = nodes["tree_id"].to_numpy()
        feature, threshold = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(float)
        below = [np.array([at.get(key, -1) for key in zip(trees, nodes[side])]) for side in ("left", "right")]
        path = nodes["depth"].to_numpy() + expected_path(nodes["n_samples"].to_numpy())
        here = np.flatnonzero(nodes["node_id"].to_numpy() == 0)
        self.n_trees, self.sample = len(here), int(nodes["n_samples"].to_numpy()[here].max())
        tree = np.arange(len(here))
        low, high = np.full((len(here), n_features), -np.inf), np.full((len(here), n_features), np.inf)
        self.bits = (1 << np.arange(n_features)).astype(np.int32 if n_features < 32 else np.int64)
        self.levels, leaves = [], []
        while len(here):
            inner, ends = np.flatnonzero(feature[here] != LEAF), np.flatnonzero(feature[here] == LEAF)
            leaves.append((tree[ends], path[here[ends]], low[ends], high[ends]))
            f, cut, rows = feature[here[inner]], threshold[here[inner]], np.arange(len(inner))
            self.levels.append((ends, inner, f, cut[:, None], self.bits[f][:, None]))
            left_high, right_low = high[inner], low[inner]
            left_high[rows, f] = np.minimum(left_high[rows, f], cut)
            right_low[rows, f] = np.maximum(right_low[rows, f], cut)
            low, high = np.concatenate([low[inner], right_low]), np.concatenate([left_high, high[inner]])
            tree, here = np.tile(tree[inner], 2), np.concatenate([side[here[inner]] for side in below])
        self.tree, self.value, low, high = (np.concatenate(column) for column in zip(*leaves))
        self.met = (np.isfinite(low) | np.isfinite(high)).astype(float)
        self.cuts = [np.sort(threshold[feature == j]) for j in range(n_features)]
        # Slots of a feature: 0 up to its first threshold, one more behind each.
        first = np.cumsum([0, *[len(cuts) + 1 for cuts in self.cuts]])
        self.first, self.width = first[:-1], int(first[-1]) + 1
        slots = [(np.searchsorted(c, low[:, j], "right"), np.searchsorted(c, high[:, j], "left") + 1) for j, c in enumerate(self.cuts)]
        self.start = np.array([start + at for (start, _), at in zip(slots, self.first)], dtype=np.int32)
        self.end = np.array([end + at for (_, end), at in zip(slots, self.first)], dtype=np.int32)

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Slot of every value: a row for each feature."""
        return np.array([np.searchsorted(c, x[:, j], "left") + self.first[j] for j, c in enumerate(self.cuts)], dtype=np.int32)

    def failed(self, x: np.ndarray) -> np.ndarray:
        """For each leaf and row the features, as bits, whose tests the row fails on the way there."""
        columns = np.ascontiguousarray(x.T)
        mask, found = np.zeros((self.n_trees, len(x)), dtype=self.bits.dtype), []
        for ends, inner, f, cut, bit in self.levels:
            found.append(mask[ends])
            mask = mask[inner]
            wrong = np.where(columns[f] > cut, bit, self.bits.dtype.type(0))  # for those that want to go left
            mask, k = np.tile(mask, (2, 1)), len(inner)
            mask[:k] |= wrong
            np.bitwise_xor(wrong, bit, out=wrong)
            mask[k:] |= wrong
        return np.concatenate(found)

    def changes(self, x: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each feature the sum of |score change| over rows and repeats, and how many paths test it.

        ``given`` has the slots of the values put in place: feature, repeat, row.
        """
        n, failed = len(x), self.failed(x).ravel()
        near = np.flatnonzero(failed & (failed - 1) == 0)  # at most one feature
        leaf, row = np.divmod(near, n)
        failed = failed[near]
        here, there = np.flatnonzero(failed == 0), np.flatnonzero(failed)
        own = np.empty((self.n_trees, n))
        own[self.tree[leaf[here]], row[here]] = self.value[leaf[here]]
        met = np.bincount(leaf[here], minlength=len(self.tree)) @ self.met
        leaf, row = leaf[there], row[there]
        at = np.bitwise_count(failed[there] - 1) * np.int64(len(self.tree)) + leaf
        start, end = self.start.take(at), self.end.take(at)
        step = np.where(start < end, self.value.take(leaf) - own.take(self.tree.take(leaf) * n + row), 0.0)
        row = row * self.width
        steps = np.bincount(np.concatenate([row + start, row + end]), np.concatenate([step, -step]), n * self.width)
        total, steps = own.sum(axis=0), np.cumsum(steps.reshape(n, self.width), axis=1)
        rows, base = np.arange(n), self.anomaly(total)
        sums = np.zeros(len(self.cuts))
        for k, here in enumerate(self.slots(x)):
            if len(self.cuts[k]):
                change = steps[rows, given[k]] - steps[rows, here]
                sums[k] = np.abs(self.anomaly(total + change) - base).sum()
        return sums, met

    def anomaly(self, total: np.ndarray) -> np.ndarray:
        return anomaly(total, self.n_trees, self.sample)


def importance_by_sensor(importances: DataFrame) -> DataFrame:
    """Importance summed per sensor, with its share of the total in percent."""
    per = importances.groupBy(sensor_label(F.col("feature")).alias("sensor")).agg(F.sum("importance").alias("importance"))
    whole = F.sum("importance").over(W.partitionBy())  # at most six rows
    return per.select("sensor", "importance", (F.try_divide(F.col("importance"), whole) * 100).alias("percent"))


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def redundant_pairs(rows: DataFrame, features: Sequence[str] = FEATURES, threshold: float = REDUNDANT_ABOVE) -> DataFrame:
    """Feature pairs of one sensor that move together, strongest first.

    All pair covariances come from one aggregate over the rows.
    """
    by_sensor: dict[str, list[str]] = {}
    for f in features:
        if not f.endswith("_corr"):
            by_sensor.setdefault(sensor_of(f), []).append(f)
    pairs = [(s, a, b) for s, names in by_sensor.items() for a, b in combinations(names, 2)]
    singles = sorted({f for _, a, b in pairs for f in (a, b)})
    moments = rows.agg(
        *[F.stddev_samp(f).alias(f"sd_{f}") for f in singles],
        *[F.covar_samp(a, b).alias(f"co_{i}") for i, (_, a, b) in enumerate(pairs)],
    )
    cells = ", ".join(f"'{s}', '{a}', '{b}', abs(try_divide(co_{i}, sd_{a} * sd_{b}))" for i, (s, a, b) in enumerate(pairs))
    long = moments.selectExpr(f"stack({len(pairs)}, {cells}) AS (sensor, feature_a, feature_b, corr)")
    return long.filter(F.col("corr") >= threshold).orderBy(F.desc("corr"), "feature_a", "feature_b")
