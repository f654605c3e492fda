"""Nearest neighbours through learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts: the graph is
halved again and again at the median of its smoothest non-constant vector, found
by power iteration.  A small network learns to tell the part from the vector.
Every vector of the table is filed under its most probable part; a query goes to
its ``probes`` most probable parts, and all vectors filed there are compared
with it exactly.

Parts are dealt out in chunks of bounded size on both sides, so that neither a
part that holds a third of all vectors nor one that every query asks for is one
task.  Only the nearest few of each chunk leave it.

Defined results: vectors that are null, zero, of another length than most of the
sample, or that hold null or non-finite components take no part, nor do rows
without an id; rows that share a query's id are the query itself; a query row
that is repeated is asked once, rows of one id with different vectors are asked
each; a candidate row that is repeated is found once per row; lengths are
measured on vectors scaled by a power of two, so their size may be any; ties go
to the smaller id; with fewer candidates than asked for all that are found are
returned; an empty table gives an empty table. With few vectors in the sample,
fewer than eight a part, the number of parts is halved until there are as many.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from fleetpulse.llm.common import table
from fleetpulse.session import materialize, ship


@dataclass(frozen=True)
class Index:
    """``sample`` bounds what is fitted on the driver; ``chunk`` the rows of one task's group."""

    sample: int = 16384
    parts: int = 32
    probes: int = 24
    near: int = 10
    hidden: int = 128
    epochs: int = 20
    chunk: int = 4096
    seed: int = 3


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, version): v as doubles, rows that can be compared; ``version`` tells apart the vectors of one id."""
    fit = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    ).filter(F.coalesce(fit, F.lit(False))).withColumn("version", F.xxhash64("v"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the ``near`` nearest rows of each row."""
    out = np.empty((len(x), near), dtype=np.int64)
    for i in range(0, len(x), 1024):
        score = x[i : i + 1024] @ x.T
        score[np.arange(len(score)), np.arange(i, i + len(score))] = -2
        out[i : i + 1024] = np.argpartition(-score, near - 1, axis=1)[:, :near]
    return out


def balanced_parts(x: np.ndarray, near: int, parts: int, seed: int) -> np.ndarray:
    """Part of each row; parts differ in size by the rounding of halves only."""
    graph = neighbour_graph(x, near)
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), dtype=np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for rows in groups:
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            a = np.repeat(np.arange(len(rows)), near)
            b = place[graph[rows]].ravel()
            a, b = a[b >= 0], b[b >= 0]
            degree = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows)) + 1.0
            root = np.sqrt(degree)
            y = rng.standard_normal(len(rows))
            for _ in range(60):
                y -= root * (root @ y) / degree.sum()
                s = y / root
                y = (s + np.bincount(a, s[b], len(rows)) + np.bincount(b, s[a], len(rows))) / root
                y /= np.sqrt(y @ y) or 1.0
            order = np.argsort(y / root, kind="stable")
            halves += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        groups = halves
    for number, rows in enumerate(groups):
        part[rows] = number
    return part


def probabilities(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Log-probabilities of the parts, up to a constant per row."""
    return np.tanh(x @ model["in"] + model["in_bias"]) @ model["out"] + model["out_bias"]


def learn(x: np.ndarray, part: np.ndarray, graph: np.ndarray, how: Index) -> dict[str, np.ndarray]:
    """Network from vectors to the parts that their neighbours lie in, with Adam."""
    rng = np.random.default_rng(how.seed)
    parts = int(part.max()) + 1
    target = np.zeros((len(x), parts))
    for column in (np.arange(len(x))[:, None], graph):
        for j in range(column.shape[1]):
            np.add.at(target, (np.arange(len(x)), part[column[:, j]]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    model = {
        "in": rng.standard_normal((x.shape[1], how.hidden)) / np.sqrt(x.shape[1]) * 3, "in_bias": np.zeros(how.hidden),
        "out": rng.standard_normal((how.hidden, parts)) / np.sqrt(how.hidden), "out_bias": np.zeros(parts),
    }
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            rows = order[i : i + 128]
            h = np.tanh(x[rows] @ model["in"] + model["in_bias"])
            logit = h @ model["out"] + model["out_bias"]
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ model["out"].T) * (1 - h * h)
            g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "in": x[rows].T @ dh, "in_bias": dh.sum(axis=0)}
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                model[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(vectors: DataFrame, how: Index = Index()) -> dict[str, np.ndarray] | None:
    """Model from a sample of distinct vectors below a threshold of their hash; None without a vector."""
    every = max(1, vectors.count() // how.sample)
    drawn = vectors.filter(F.pmod(F.xxhash64("version"), F.lit(every)) == 0).select("v").distinct().limit(2 * how.sample)
    rows = sorted(drawn.collect(), key=lambda r: r.v) or vectors.select("v").limit(1).collect()
    if not rows:
        return None
    width = Counter(len(r.v) for r in rows).most_common(1)[0][0]
    x = unit(np.array([r.v for r in rows if len(r.v) == width]))
    near = min(how.near, len(x) - 1)
    parts = how.parts
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    if near < 1 or parts == 1:
        return {"in": np.zeros((width, 1)), "in_bias": np.zeros(1), "out": np.zeros((1, 1)), "out_bias": np.zeros(1)}
    part = balanced_parts(x, near, parts, how.seed)
    return learn(x, part, neighbour_graph(x, near), how)


def filed(vectors: DataFrame, model: dict[str, np.ndarray], probes: int) -> DataFrame:
    """(id, v, part) with the ``probes`` most probable parts of each vector, one row each."""
    ship(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(sent.value["in"])
        for batch in batches:
            lists = batch.column(1)
            right = np.flatnonzero(np.array(lists.value_lengths()) == width)
            if not len(right):
                continue
            batch = batch.take(pa.array(right))
            x = unit(batch.column(1).flatten().to_numpy().reshape(-1, width))
            score = probabilities(sent.value, x)
            n = min(probes, score.shape[1])
            best = np.argsort(-score, axis=1, kind="stable")[:, :n]
            taken = batch.take(pa.array(np.repeat(np.arange(len(x)), n)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(best.ravel().astype(np.int64))], names=["id", "v", "version", "part"])

    return vectors.select("id", "v", "version").mapInArrow(rows, "id long, v array<double>, version long, part long")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def nearest_in_chunk(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest candidates of each query, exact and with ties by id."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "version": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(candidates):
        return empty
    q, c = scaled(np.stack(queries["v"].to_numpy())), scaled(np.stack(candidates["v"].to_numpy()))
    q_id, c_id, version = queries["id"].to_numpy(), candidates["id"].to_numpy(), queries["version"].to_numpy()
    q_size, c_size = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    rough = (q / q_size[:, None]) @ (c / c_size[:, None]).T
    rough[q_id[:, None] == c_id[None, :]] = -np.inf
    n = min(k, len(c))
    # Matrix products round equal rows unlike; whatever may reach the k-th place is taken again.
    bar = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - 1e-9
    out = []
    for i in range(len(q)):
        at = np.flatnonzero((rough[i] >= bar[i]) & (rough[i] > -np.inf))
        exact = (c[at] * q[i]).sum(axis=1) / (c_size[at] * q_size[i])
        best = np.lexsort((c_id[at], -exact))[:k]
        out.append(pd.DataFrame({"query_id": q_id[i], "version": version[i], "vec_id": c_id[at[best]], "score": exact[best]}))
    return pd.concat(out) if out else empty


def search(vectors: DataFrame, queries: DataFrame, model: dict[str, np.ndarray], how: Index, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    chunk = how.chunk
    of = materialize(filed(vectors, model, 1), "filed")
    asked = materialize(filed(queries.dropDuplicates(["id", "version"]), model, how.probes), "asked")
    # Chunks per part, from counts of the parts: as many rows as parts.
    cuts = of.groupBy("part").agg(F.ceil(F.count("*") / chunk).alias("cuts")).join(
        asked.groupBy("part").agg(F.ceil(F.count("*") / chunk).alias("asks")), "part"
    )
    cuts = materialize(cuts, "cuts")
    left = asked.join(F.broadcast(cuts), "part").withColumn("ask", F.pmod(F.xxhash64("id"), F.col("asks")))
    left = left.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select("part", "cut", "ask", "id", "v", "version")
    right = of.join(F.broadcast(cuts), "part").withColumn("cut", F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts")))
    right = right.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))).select("part", "cut", "ask", "id", "v")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_chunk(q, c, k)

    keys = ["part", "cut", "ask"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, version long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "version").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_learned_partitions(spark, sf_dir: str, how: Index = Index()) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    model = fit(vectors, how)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(vectors, vectors.filter(F.col("id") % 50 == 0), model, how, 5)
