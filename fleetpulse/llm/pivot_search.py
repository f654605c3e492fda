"""Exact search for the largest integer inner products, by elimination with pivots.

Components become floor(256 x), so scores are integers and ties are ties.  Each
candidate c gets one more component, sqrt(M^2 - |c|^2) with M the largest length,
and each query a zero there.  Then

    |q' - c'|^2 = |q|^2 + M^2 - 2 q.c

and the largest inner products are the nearest points of a metric space.  The
distances of all candidates to ``pivots`` far-apart points are computed once and
stored with them.  By the triangle inequality |d(q', p) - d(c', p)| never exceeds
d(q', c'); its maximum over the pivots, a lower bound of the distance, gives an
upper bound of the score.

Candidates are filed in cells by their nearest pivot.  A query first looks into
a part of the cell whose bound is best; the k-th score found there is a score to
beat.  Then every cell whose bound reaches that score is visited: candidates are
taken in the order of their bounds and scored exactly until the next bound is
below the k-th score.  Equal bounds are still scored, so ties are complete.
Bounds are kept in single precision and widened by more than their rounding.

Nothing but the pivots and the range of distances of each cell (pivots squared)
is broadcast.  A cell is dealt out in pieces of at most about ``chunk`` rows on
both sides, from counts, so a hot vector is not one task.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do those without an id or whose integer length does not fit
(sum of squares 2^62 or more), as their scores would not fit a long; shorter
vectors count as padded with zeros, so an empty vector scores zero everywhere;
rows that share the query's id are the query itself; a repeated query row is
asked once, rows of one id with different vectors are asked each; a repeated
candidate row is found once per row; ties go to the smaller id; an empty table
gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from fleetpulse.llm.common import table
from fleetpulse.session import materialize, ship

SCALE = 256
#: Sum of squares from which a vector takes no part; scores of others fit a long.
LONGEST = float(1 << 62)
#: Below this sum of squares every partial sum is exact in double precision.
EXACT = 1 << 52


@dataclass(frozen=True)
class Pivots:
    """``sample`` bounds the vectors that pivots are chosen from; ``chunk`` and ``numbers`` the rows and components of one task's group."""

    pivots: int = 32
    sample: int = 8192
    chunk: int = 4096
    numbers: int = 1 << 22
    first: int = 256


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, version): x as longs, ``version`` tells apart the vectors of one id."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    size = F.aggregate("v", F.lit(0.0), lambda a, c: a + (F.abs(SCALE * c) + 1) * (F.abs(SCALE * c) + 1))
    whole = F.transform("v", lambda c: F.floor(SCALE * c).cast("long"))
    kept = rows.filter(F.coalesce(sound, F.lit(False))).filter(size < LONGEST)
    return kept.select("id", whole.alias("x")).withColumn("version", F.xxhash64("x"))


def padded(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of longs as a matrix, zeros after the end of shorter ones."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1).astype(np.float64)


@dataclass
class Model:
    """Pivots with their last component, and the square M^2 that it is measured against."""

    x: np.ndarray
    last: np.ndarray
    top: float

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances to all pivots; the last component of a query is zero."""
        size = squares(x)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - size, 0.0))
        width = min(x.shape[1], self.x.shape[1])
        product = x[:, :width].astype(np.float64) @ self.x[:, :width].T.astype(np.float64) + last[:, None] * self.last[None, :]
        own = self.top if not query else size[:, None]
        return np.sqrt(np.maximum(own + self.top - 2.0 * product, 0.0)).astype(np.float32)

    def slack(self, size: np.ndarray) -> np.ndarray:
        """More than the rounding of two distances: single precision, and the root of a difference of squares."""
        return 4e-7 * (np.sqrt(size) + np.sqrt(self.top)) + 4e-8 * np.sqrt(size + self.top)

    def bound(self, size: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Largest score at these least distances, for queries of these squared lengths."""
        apart = np.maximum(apart - self.slack(size)[:, None], 0.0)
        return (size[:, None] + self.top - apart * apart) / 2.0 + 1e-9 * (size[:, None] + self.top) + 1.0


def fit(rows: DataFrame, how: Pivots) -> Model | None:
    """Pivots picked farthest first from a sample of distinct vectors, drawn by a threshold on their hash."""
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c))).first()
    if not n:
        return None
    every = max(1, n // how.sample)
    drawn = rows.filter(F.pmod(F.xxhash64("version"), F.lit(every)) == 0).select("x").distinct().limit(2 * how.sample)
    lists = [r.x for r in drawn.collect()] or [r.x for r in rows.select("x").limit(1).collect()]
    x = padded(pa.array(sorted(lists), pa.list_(pa.int64())))
    chosen, near = [0], np.full(len(x), np.inf)
    while True:
        picked = x[chosen[-1] : chosen[-1] + 1]
        near = np.minimum(near, squares(x - picked))
        if len(chosen) == how.pivots or near.max(initial=0.0) == 0:
            break
        chosen.append(int(near.argmax()))
    pivots = x[chosen]
    return Model(pivots, np.sqrt(np.maximum(float(top) - squares(pivots), 0.0)), float(top))


def pivot_table(rows: DataFrame, model: Model) -> DataFrame:
    """Add each candidate's distances to all pivots, ``d``, and the number of the nearest, ``cell``."""
    sent = ship(rows.sparkSession).sparkContext.broadcast(model)
    more = [T.StructField("d", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType())]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            d = sent.value.distances(padded(batch.column(batch.schema.get_field_index("x"))), query=False)
            cell = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(d), pa.array(cell)], names=[*batch.schema.names, "d", "cell"])

    return rows.mapInArrow(measure, T.StructType([*rows.schema.fields, *more]))


def pieces(batches: Iterator[pa.RecordBatch], numbers: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches by the numbers that they hold, not by rows."""
    for batch in batches:
        each = max(1, batch.nbytes // 8 // max(1, batch.num_rows))
        step = max(1, numbers // each)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def lists_of(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def cell_ranges(filed: DataFrame) -> DataFrame:
    """(cell, n, low, high): the range of distances to every pivot; a row per cell, combined in the tasks first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            d = batch.column(1).flatten().to_numpy().reshape(len(cell), -1)
            for c in np.unique(cell):
                mine = d[cell == c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32()), pa.array([len(mine)], pa.int64()), lists_of(mine.min(axis=0)[None]), lists_of(mine.max(axis=0)[None])],
                    names=["cell", "n", "low", "high"],
                )

    some = filed.select("cell", "d").mapInArrow(partial, "cell int, n long, low array<float>, high array<float>")
    spread = some.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "r"), "n")
    by_pivot = spread.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    return by_pivot.groupBy("cell").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))).alias("r")).select(
        "cell", "n", F.col("r.low").alias("low"), F.col("r.high").alias("high")
    )


def routed(queries: DataFrame, model: Model, ranges: tuple[np.ndarray, np.ndarray, np.ndarray], all_cells: bool) -> DataFrame:
    """A row for each cell a query has to visit: the best one, or all whose bound reaches the score to beat."""
    sent = ship(queries.sparkSession).sparkContext.broadcast((model, *ranges))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells, low, high = sent.value
        for batch in pieces(batches, 1 << 18):
            x = padded(batch.column(1))
            d = pivots.distances(x, query=True)
            apart = np.zeros((len(x), len(cells)), dtype=np.float32)
            for p in range(d.shape[1]):
                own = d[:, p : p + 1]
                np.maximum(apart, np.maximum(low[None, :, p] - own, own - high[None, :, p]), out=apart)
            bound = pivots.bound(squares(x), apart)
            if all_cells:
                beat = np.array([-np.inf if s is None else s for s in batch.column(3).to_pylist()], dtype=np.float64)
                row, at = np.nonzero(bound >= beat[:, None])
            else:
                row, at = np.arange(len(x)), bound.argmax(axis=1)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, lists_of(d[row]), pa.array(cells[at].astype(np.int32))], names=[*batch.schema.names, "d", "cell"])

    return queries.mapInArrow(rows, "id long, x array<long>, version long, beat long, d array<float>, cell int")


def scores(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; by the fast product where every partial sum is a whole double."""
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if exact else x @ q


def best_in_chunk(asked: pa.Table, filed: pa.Table, model: Model, how: Pivots, k: int) -> pa.Table:
    """The ``k`` best candidates of each query, in bound order until none can be better; ``seen`` counts those scored."""
    width = max(padded(asked["x"]).shape[1], padded(filed["x"]).shape[1])
    q, c = padded(asked["x"], width), padded(filed["x"], width)
    q_id, c_id, version = (column.to_numpy() for column in (asked["id"], filed["id"], asked["version"]))
    dq, dc = (side["d"].combine_chunks().flatten().to_numpy().reshape(len(side), -1) for side in (asked, filed))
    beat = [-np.inf if s is None else s for s in asked["beat"].to_pylist()]
    size = squares(q)
    exact = float(size.max()) < EXACT and float(squares(c).max()) < EXACT
    c64 = c.astype(np.float64) if exact else c
    # One row of the matrix of bounds for each pivot in turn; a block of queries at a time.
    out = {name: [] for name in ("query_id", "version", "vec_id", "score", "seen")}
    for start in range(0, len(q), 256):
        block = slice(start, start + 256)
        apart = np.zeros((len(q[block]), len(c)), dtype=np.float32)
        for p in range(dq.shape[1]):
            np.maximum(apart, np.abs(dq[block, p, None] - dc[None, :, p]), out=apart)
        bounds = model.bound(size[block], apart)
        for i, bound in enumerate(bounds, start):
            open_ = np.flatnonzero((bound >= beat[i]) & (c_id != q_id[i]))
            order = open_[np.argsort(-bound[open_], kind="stable")]
            ids, points, bar, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), beat[i], 0, how.first
            while at < len(order) and bound[order[at]] >= bar:
                taken = order[at : at + step]
                ids = np.concatenate([ids, c_id[taken]])
                points = np.concatenate([points, scores(c64[taken], q[i], exact)])
                best = np.lexsort((ids, -points))[:k]
                ids, points = ids[best], points[best]
                bar = max(bar, points[-1]) if len(points) == k else bar
                at, step = at + len(taken), 2 * step
            n = max(1, len(ids))
            out["query_id"].append(np.full(n, q_id[i]))
            out["version"].append(np.full(n, version[i]))
            out["vec_id"].append(ids if len(ids) else np.array([-1]))
            out["score"].append(points if len(ids) else np.array([np.iinfo(np.int64).min]))
            out["seen"].append(np.append(at, np.zeros(n - 1, dtype=np.int64)).astype(np.int64))
    columns = {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in out.items()}
    none = columns["score"] == np.iinfo(np.int64).min
    return pa.table({
        "query_id": columns["query_id"], "version": columns["version"], "vec_id": pa.array(columns["vec_id"], mask=none),
        "score": pa.array(columns["score"], mask=none), "seen": columns["seen"],
    })


FOUND = "query_id long, version long, vec_id long, score long, seen long"


def compared(asked: DataFrame, filed: DataFrame, cuts: DataFrame, model: Model, how: Pivots, k: int, one_cut: bool) -> DataFrame:
    """Best candidates of each query in each piece of the cells it visits."""
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / how.chunk).alias("asks")).join(F.broadcast(cuts), "cell")
    counts = materialize(counts, "pieces")
    left = asked.join(F.broadcast(counts), "cell").withColumn("ask", F.pmod(F.xxhash64("id", "version"), F.col("asks")))
    if one_cut:
        left = left.withColumn("cut", F.pmod(F.xxhash64("version", "id"), F.col("cuts")))
    else:
        left = left.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    right = filed.join(F.broadcast(counts), "cell").withColumn("cut", F.pmod(F.xxhash64("id", "version", "salt"), F.col("cuts")))
    right = right.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
    sent = asked.sparkSession.sparkContext.broadcast(model)
    nothing = pa.schema([(name, pa.int64()) for name in ("query_id", "version", "vec_id", "score", "seen")]).empty_table()

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        return best_in_chunk(q, c, sent.value, how, k) if len(q) and len(c) else nothing

    keys = ["cell", "cut", "ask"]
    left, right = left.select(*keys, "id", "x", "version", "beat", "d"), right.select(*keys, "id", "x", "d")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int, how: Pivots = Pivots()) -> DataFrame:
    """(query_id, rank, vec_id, score, seen) of rows (id, x, version); ``seen``: candidates that were scored for the query."""
    model = fit(vectors, how)
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, seen long")
    how = replace(how, chunk=max(1, min(how.chunk, how.numbers // max(1, model.x.shape[1]))))
    # Repeated rows are told apart, so that a hot one is spread over the pieces of its cell.
    filed = materialize(pivot_table(vectors.withColumn("salt", F.monotonically_increasing_id()), model), "pivot-table")
    ranges = materialize(cell_ranges(filed), "cell-ranges")
    listed = sorted(ranges.collect(), key=lambda r: r.cell)
    held = tuple(np.array([r[name] for r in listed], dtype=kind) for name, kind in (("cell", np.int32), ("low", np.float32), ("high", np.float32)))
    cuts = ranges.select("cell", F.ceil(F.col("n") / how.chunk).alias("cuts"))
    once = queries.select("id", "x", "version").dropDuplicates(["id", "version"]).withColumn("beat", F.lit(None).cast("long"))
    once = materialize(once, "queries")
    tried = compared(materialize(routed(once, model, held, False), "routes"), filed, cuts, model, how, k, one_cut=True)
    place = F.row_number().over(W.partitionBy("query_id", "version").orderBy(F.col("score").desc_nulls_last(), "vec_id"))
    beaten = tried.filter("score IS NOT NULL").withColumn("place", place).filter(F.col("place") == k)
    with_score = once.drop("beat").join(
        beaten.select(F.col("query_id").alias("id"), "version", F.col("score").alias("beat")), ["id", "version"], "left"
    ).select("id", "x", "version", "beat")
    visits = materialize(routed(with_score, model, held, True), "routes")
    found = compared(visits, filed, cuts, model, how, k, one_cut=False)
    seen = F.sum("seen").over(W.partitionBy("query_id", "version"))
    return found.withColumn("seen", seen).withColumn("rank", place).filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select(
        "query_id", "rank", "vec_id", "score", "seen"
    )


def op12_pivot_search(spark, sf_dir: str, how: Pivots = Pivots()) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.filter(F.col("id") % 50 == 0), 5, how).drop("seen")


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
