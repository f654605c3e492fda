"""Isolation forest (Liu, Ting and Zhou 2008): sampling, building, scoring.

Nothing is drawn from a generator's state.  A tree's sample is the ``tree_sample``
rows of smallest rank, where the rank is a linear hash of the row's own hash with
two numbers of the tree; the feature and the threshold of a node are hashes of
(seed, tree, place of the node).  So the forest follows from the rows alone,
whatever their partitioning, and plain SQL can build it again.

The trees are built in parallel, one small group per tree.  A fitted forest is
at most n_trees * 511 nodes whatever the data size, which is why it may be
collected and broadcast.  Scoring is one Arrow-batched UDF over the feature
columns.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from fleetpulse.config import DEFAULT, FEATURES, EngineConfig
from fleetpulse.functions.columns import all_of
from fleetpulse.session import discard, materialize

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, left int, right int, n_samples int, depth int"
)
EULER_GAMMA = 0.5772156649015329
LEAF = -1
SCORE_BATCH = 16_384
#: Fewer rows descend level by level, more are compared node by node.
FEW_ROWS = 4096
PRIME = (1 << 31) - 1
#: Values of a node that lie apart by less, absolutely or by their size, count as equal.
APART = 1e-9


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    path = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, path, np.where(n == 2, 1.0, 0.0))


# -- fit ------------------------------------------------------------------


def draw(text: str) -> int:
    """Whole number below 2^52 from the first 13 hexadecimal digits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def uniform(text: str) -> float:
    return draw(text) / float(1 << 52)


def row_hash() -> Column:
    """Number of a row below PRIME, from its asset and time."""
    text = F.concat_ws("|", F.col("asset_id"), F.unix_micros(F.col("ts")).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def linear_hash(name: str) -> tuple[int, int]:
    """Two numbers that make a rank of a row: (row hash * first + second) mod PRIME."""
    return 1 + draw(f"{name}|scale") % (PRIME - 1), draw(f"{name}|shift") % PRIME


def tree_hashes(seed: int, n_trees: int) -> list[tuple[int, int]]:
    return [linear_hash(f"{seed}|{t}") for t in range(n_trees)]


def ranked_below(reference: DataFrame, below: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(tree_id, rank, asset_id, ts, features): rows whose rank in a tree is below a bound."""
    hashes = tree_hashes(cfg.seed, cfg.n_trees)
    first, second = (F.lit(list(numbers)) for numbers in zip(*hashes))

    @F.pandas_udf("array<int>")
    def trees_below(row_hash: pd.Series) -> pd.Series:
        return pd.Series(_trees_below(row_hash.to_numpy(np.int64), hashes, below))

    rank = F.pmod(F.col("row_hash") * F.get(first, "tree_id") + F.get(second, "tree_id"), F.lit(PRIME))
    rows = reference.select("asset_id", "ts", row_hash().alias("row_hash"), *FEATURES)
    dealt = rows.withColumn("tree_id", F.explode(trees_below("row_hash")))
    return dealt.select("tree_id", rank.alias("rank"), "asset_id", "ts", *FEATURES)


def _trees_below(row_hash: np.ndarray, hashes: list[tuple[int, int]], below: int) -> list[list[int]]:
    """The trees in which each row's rank is below a bound; most rows have none."""
    none: list[int] = []
    out = [none] * len(row_hash)
    for tree, (first, second) in enumerate(hashes):
        rank = row_hash * first + second
        for _ in range(2):  # modulo 2^31 - 1
            rank = (rank & PRIME) + (rank >> 31)
        rank[rank == PRIME] = 0
        for row in np.flatnonzero(rank < below).tolist():
            out[row] = [*out[row], tree]
    return out


def tree_samples(reference: DataFrame, n_rows: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Rows that hold each tree's sample: its ``tree_sample`` smallest ranks, for every number of rows.

    Ranks are uniform, so a bound on the rank leaves every tree its sample and
    about half as many rows again, and no task emits what cannot be among them;
    a row asks 200 cheap numbers and is not shuffled unless it is near one.
    The table is written and counted; should a tree be short after all, the
    bound is doubled until none is, which changes no sample.
    """
    wanted = min(cfg.tree_sample, n_rows)
    share = (wanted + 10 * sqrt(wanted) + 20) / n_rows
    while True:
        below = min(PRIME, ceil(PRIME * share))
        dealt = materialize(ranked_below(reference, below, cfg), "tree-samples")
        counts = dealt.groupBy("tree_id").count().agg(F.count("*"), F.min("count")).first()
        if below == PRIME or (counts[0] == cfg.n_trees and counts[1] >= wanted):
            return dealt
        discard(dealt)
        share *= 2


def grow_tree(values: np.ndarray, key: str, max_depth: int) -> list[tuple]:
    """Random splits level by level until rows are alone, alike, or ``max_depth`` deep.

    Node 0 is the root, the children of node i are 2i + 1 and 2i + 2.  A feature
    can split a node if its values lie apart by more than rounding.
    """
    nodes: list[tuple] = []
    level = [(0, np.arange(len(values)))]
    for depth in range(max_depth + 1):
        below = []
        for node, rows in level:
            here = values[rows]
            usable = np.zeros(0, dtype=int)
            if depth < max_depth and len(rows) > 1:
                low, high = here.min(axis=0), here.max(axis=0)
                usable = np.flatnonzero(high - low > APART * np.maximum(1.0, np.maximum(np.abs(low), np.abs(high))))
            if not usable.size:
                nodes.append((node, LEAF, 0.0, LEAF, LEAF, len(rows), depth))
                continue
            feature = int(usable[int(uniform(f"{key}|{node}|feature") * usable.size)])
            threshold = float(low[feature] + uniform(f"{key}|{node}|threshold") * (high[feature] - low[feature]))
            left = here[:, feature] <= threshold
            nodes.append((node, feature, threshold, 2 * node + 1, 2 * node + 2, len(rows), depth))
            below += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        level = below
    return nodes


def fit_forest(reference: DataFrame, n_rows: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Node table of a forest fitted on the ``n_rows`` rows of ``reference``."""
    if n_rows < 2:
        raise ValueError("no reference rows to fit on; check the rated range")
    sample = min(cfg.tree_sample, n_rows)
    max_depth = ceil(log2(max(sample, 2)))
    seed = cfg.seed

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(key[0])
        chosen = group.sort_values(["rank", "asset_id", "ts"]).head(sample)[list(FEATURES)].to_numpy(float)
        columns = ["node_id", "feature", "threshold", "left", "right", "n_samples", "depth"]
        built = pd.DataFrame(grow_tree(chosen, f"{seed}|{tree_id}", max_depth), columns=columns)
        built.insert(0, "tree_id", tree_id)
        return built

    return tree_samples(reference, n_rows, cfg).groupBy("tree_id").applyInPandas(build, NODE_SCHEMA)


# -- score ----------------------------------------------------------------


def anomaly(total: np.ndarray, n_trees: int, sample: int) -> np.ndarray:
    """Score of a total path length over all trees: -2^(-mean path / expected path)."""
    return -np.exp2(-total / n_trees / max(float(expected_path(sample)), 1e-12))


class PackedForest:
    """Trees padded to full depth, so every row takes the same steps.

    Below a leaf the padding always goes left and repeats the leaf's value.
    """

    def __init__(self, nodes: pd.DataFrame):
        trees = sorted(nodes["tree_id"].unique())
        self.depth = max(1, int(nodes["depth"].max()))
        self.sample = int(nodes.loc[nodes["depth"] == 0, "n_samples"].max())
        inner, bottom = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((len(trees), inner), dtype=np.intp)
        self.threshold = np.full((len(trees), inner), np.inf)
        self.value = np.zeros((len(trees), bottom))
        for t, tree_id in enumerate(trees):
            rows = nodes[nodes["tree_id"] == tree_id].set_index("node_id")
            feature, threshold = rows["feature"].to_dict(), rows["threshold"].to_dict()
            left, right = rows["left"].to_dict(), rows["right"].to_dict()
            path = dict(zip(rows.index, rows["depth"] + expected_path(rows["n_samples"])))
            todo = [(0, 0, 0)]
            while todo:
                node, slot, depth = todo.pop()
                if feature[node] == LEAF:
                    first = ((slot + 1) << (self.depth - depth)) - 1 - inner
                    self.value[t, first : first + (1 << (self.depth - depth))] = path[node]
                    continue
                self.feature[t, slot] = feature[node]
                self.threshold[t, slot] = threshold[node]
                todo.append((left[node], 2 * slot + 1, depth + 1))
                todo.append((right[node], 2 * slot + 2, depth + 1))

    def __getstate__(self) -> bytes:
        """Compressed: most padding repeats, so a forest ships in a fraction of
        a megabyte. Code sent to stateful streaming must stay below one."""
        arrays = (self.depth, self.sample, self.feature.astype(np.int16), self.threshold, self.value)
        return zlib.compress(pickle.dumps(arrays, protocol=5))

    def __setstate__(self, state: bytes) -> None:
        self.depth, self.sample, feature, self.threshold, self.value = pickle.loads(zlib.decompress(state))
        self.feature = feature.astype(np.intp)

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path / expected path): near -1 anomalous, near 0 normal."""
        out = np.empty(len(x))
        cuts = np.linspace(0, len(x), max(1, round(len(x) / SCORE_BATCH)) + 1).astype(int)
        for a, b in zip(cuts, cuts[1:]):
            piece = np.ascontiguousarray(x[a:b])
            leaves = self._leaves(piece) if len(piece) < FEW_ROWS else self._leaves_by_node(piece)
            out[a:b] = sum(value.take(leaf) for value, leaf in zip(self.value, leaves))
        return self.anomaly(out)

    def anomaly(self, total: np.ndarray) -> np.ndarray:
        """Score of a total path length over all trees."""
        return anomaly(total, len(self.feature), self.sample)

    def _leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        n, width = x.shape
        flat, row = x.ravel(), np.arange(n) * width
        inner = self.feature.shape[1]
        for feature, threshold in zip(self.feature, self.threshold):
            slot = (x[:, feature[0]] > threshold[0]) + 1
            for _ in range(1, self.depth):
                right = flat.take(feature.take(slot) + row) > threshold.take(slot)
                slot = 2 * slot + 1 + right
            yield slot - inner

    @cached_property
    def _by_node(self) -> tuple[list[np.ndarray], list]:
        """Thresholds of each feature in order, and each tree without its padding.

        A tree is the number of its only leaf or (feature, place of the threshold, left, right).
        """
        inner, real = self.feature.shape[1], self.threshold < np.inf
        cuts = [np.unique(self.threshold[real & (self.feature == j)]) for j in range(int(self.feature.max()) + 1)]
        kind = np.int16 if max(map(len, cuts)) < 32_767 else np.int64

        def grown(t: int, slot: int):
            if slot >= inner:
                return slot - inner
            if not real[t, slot]:
                return grown(t, 2 * slot + 1)
            feature = int(self.feature[t, slot])
            place = kind(np.searchsorted(cuts[feature], self.threshold[t, slot]))
            return feature, place, grown(t, 2 * slot + 1), grown(t, 2 * slot + 2)

        return cuts, [grown(t, 0) for t in range(len(self.feature))]

    def _leaves_by_node(self, x: np.ndarray) -> Iterator[np.ndarray | int]:
        """The same leaves from one comparison of all rows at every node, on small numbers.

        A value is above a threshold if more thresholds of its feature lie below
        it than below the threshold, so places among them are compared.
        """
        cuts, trees = self._by_node
        kind = np.int16 if max(map(len, cuts)) < 32_767 else np.int64
        places = [np.where(np.isnan(c), 0, np.searchsorted(cut, c)).astype(kind) for cut, c in zip(cuts, x.T)]
        number = np.min_scalar_type(self.value.shape[1] - 1).type

        def leaf(node) -> np.ndarray | int:
            if not isinstance(node, tuple):
                return number(node)
            feature, place, left, right = node
            above = (places[feature] > place).view(np.uint8).astype(number, copy=False)
            low, high = leaf(left), leaf(right)
            if not isinstance(left, tuple) and not isinstance(right, tuple):
                above *= high - low
                above += low
                return above
            np.negative(above, out=above)  # all bits where the row goes right
            chosen = low ^ high
            chosen &= above
            chosen ^= low
            return chosen

        for tree in trees:
            yield leaf(tree)


def check_finite(x: np.ndarray, features: Sequence[str]) -> None:
    """A dropout must fail here rather than become a plausible score."""
    finite = np.isfinite(x).all(axis=0)
    if not finite.all():
        bad = [name for name, ok in zip(features, finite) if not ok]
        raise ValueError(f"refusing to score non-finite values in {bad}")


def score_column(spark, nodes: pd.DataFrame, features: Sequence[str] = FEATURES) -> Column:
    """Anomaly score of the feature columns; higher is more normal.

    A non-finite feature fails the job and is named.
    """
    forest = spark.sparkContext.broadcast(PackedForest(nodes))
    names = tuple(features)

    @F.pandas_udf(DoubleType())
    def anomaly_score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        check_finite(x, names)
        return pd.Series(forest.value.score(x))

    return anomaly_score(*[F.col(c) for c in features])


def score_rows(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return df.withColumn("score", score_column(df.sparkSession, nodes, features))


def finite_features(features: Sequence[str] = FEATURES) -> Column:
    """True where every feature is a finite number: splits a feature table into
    rows to score and rows to set aside."""
    limit = F.lit(1.7976931348623157e308)
    return F.coalesce(all_of(F.col(c).between(-limit, limit) for c in features), F.lit(False))
