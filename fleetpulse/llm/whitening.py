"""Whitened embeddings: the leading principal components by Chebyshev-filtered subspace iteration.

The covariance V is never formed.  Every pass over the table centres its vectors
and adds up (x - m) (x - m)^T Q for a narrow block Q of orthonormal columns; a
task sends one number for each entry of the block, added up by Spark.  A round

* takes the Rayleigh-Ritz values of the block: V Q is at hand from the last pass,
* puts the unwanted spectrum, 0 to the smallest Ritz value of the block, on [-1, 1],
* applies the Chebyshev polynomial of ``degree`` by its three-term recurrence, one
  pass a step, which leaves that part bounded and lets the rest grow,
* makes the block orthonormal again (QR).

The last column of the block is drawn anew in each round, so a direction that
the first draw missed would come up.  Rounds end when all wanted components are
certified: the residual |V q - e q| of each is within ``tolerance`` of the largest
eigenvalue, which bounds the error of its value, and stops shrinking, or is at
the rounding level.  A block that makes no headway, as in a spectrum without
gaps, is doubled; at full width Rayleigh-Ritz is exact, so this ends.

The driver holds blocks only, width x block numbers, whatever the table's size.

Components of vectors become floor(256 c), so sums are exact and rows that agree
are the same row.  The fit list holds each distinct vector once; a hot vector is
combined before the shuffle.

Defined results: vectors that are null, hold null or non-finite entries or
entries too large for exact whole numbers (256 c of 2^53 or more), are empty, or
differ in length from most rows (of equally common lengths, the shorter) take
no part; all other rows are returned, repeated ones and those without an id
too; components whose eigenvalue is zero up to rounding (1e-12 of the largest)
are not returned, as nothing can be whitened by them, so there may be fewer than
asked, and no rows at all for one distinct vector or an empty table; among
equal eigenvalues any orthonormal directions are right; a deviation that does
not fit a long is null.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetpulse.llm.common import table
from fleetpulse.session import materialize, ship

SCALE = 256
ZERO = 1e-12


@dataclass(frozen=True)
class Filter:
    components: int = 4
    block: int = 32
    degree: int = 8
    rounds: int = 40
    tolerance: float = 1e-12
    rounding: float = 4e-15
    seed: int = 11


@dataclass
class Whitening:
    """``axes`` has a unit eigenvector in each column; ``values`` the eigenvalues, falling."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residual: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part; x as longs, all of one length."""
    v = F.col(vector_col).cast("array<double>")
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= float(1 << 53)))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(sound)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    whole = F.transform("v", lambda c: F.floor(SCALE * c).cast("long"))
    return rows.filter(F.size("v") == (common.width if common else 0)).select("id", whole.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], width: int, column: int = 0, numbers: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size with their vectors as a matrix of longs."""
    step = max(1, numbers // width)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            piece = batch.slice(i, step)
            yield piece, piece.column(column).flatten().to_numpy().reshape(-1, width)


def exact_sums(fit_list: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, as whole numbers of any size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 512 entries below 2^53 cannot overflow.
        for _, x in matrices(batches, width, numbers=512 * width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, len(x), dtype=np.int64)), pa.array(x.sum(axis=0))], names=["at", "n", "s"]
            )

    partial = fit_list.select("x").mapInArrow(rows, "at int, n long, s long")
    total = partial.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()
    return (int(total[0].n), [int(r.s) for r in total]) if total else (0, [])


class Passes:
    """Passes over a table of vectors around their mean; counts them."""

    def __init__(self, fit_list: DataFrame, n: int, sums: list[int]):
        self.rows, self.n, self.width, self.count = fit_list.select("x"), n, len(sums), 0
        self.mean = np.array([s / n for s in sums])

    def total(self, shape: tuple[int, int], of) -> np.ndarray:
        """Sum over all vectors of ``of(centred block)``, a matrix of this shape."""
        height, breadth = shape
        width, sent = self.width, self.rows.sparkSession.sparkContext.broadcast((self.mean, of))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, each = sent.value
            held, some = np.zeros((height, breadth)), False
            for _, x in matrices(batches, width):
                held, some = held + each(x - mean), True
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(height, dtype=np.int32)), *(pa.array(held[:, j]) for j in range(breadth))], names=["at", *(f"c{j}" for j in range(breadth))]
                )

        names = [f"c{j}" for j in range(breadth)]
        partial = self.rows.mapInArrow(rows, ", ".join(["at int", *(f"{c} double" for c in names)]))
        summed = partial.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).orderBy("at").collect()
        self.count += 1
        sent.unpersist()
        return np.array([r[1:] for r in summed], dtype=np.float64)

    def covariance(self, block: np.ndarray) -> np.ndarray:
        """V times a block."""
        return self.total(block.shape, Product(block)) / self.n

    def trace(self) -> float:
        return float(self.total((1, 1), squared)[0, 0]) / self.n


@dataclass
class Product:
    block: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x.T @ (x @ self.block)


@dataclass
class Gram:
    block: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = x @ self.block
        return w.T @ w


def squared(x: np.ndarray) -> np.ndarray:
    return np.array([[(x * x).sum()]])


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values of the block, falling, with its rotated columns and V times them."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values)
    return values[order], q @ turn[:, order], vq @ turn[:, order]


def filtered(passes: Passes, q: np.ndarray, vq: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of V over [0, cut], scaled to stay bounded at the largest Ritz value."""
    half = cut / 2
    top = float((q[:, 0] @ vq[:, 0]) / (q[:, 0] @ q[:, 0]))
    scale = half / (top - half)
    first = scale
    before, now = q, (vq - half * q) * (scale / half)
    for _ in range(degree - 1):
        nearer = 1.0 / (2.0 / first - scale)
        before, now = now, (passes.covariance(now) - half * now) * (2 * nearer / half) - before * (scale * nearer)
        scale = nearer
    return now


def leading(passes: Passes, k: int, how: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, axes, residuals) of the k largest eigenvalues, certified."""
    rng = np.random.default_rng(how.seed)
    width = passes.width
    block = min(width, max(how.block, 2 * k))
    q, _ = np.linalg.qr(rng.standard_normal((width, block)))
    last = np.inf
    for _ in range(how.rounds):
        values, q, vq = ritz(q, passes.covariance(q))
        largest = max(values[0], 0.0)
        # The quotient's own error is of second order; the residual bounds the first.
        residual = np.sqrt(((vq - q * values) ** 2).sum(axis=0))[:k]
        worst = residual.max() / largest if largest > 0 else 0.0
        certified = worst <= how.tolerance
        if block == width or worst <= how.rounding or (certified and worst > last / 4):
            return values[:k], q[:, :k], residual
        if not certified and worst > last / 2:
            more = np.linalg.qr(np.hstack([q, rng.standard_normal((width, min(width, 2 * block) - block))]))[0]
            block, q, last = more.shape[1], more, np.inf
            continue
        last = worst
        cut = values[-2]
        # A block wider than the rank already spans it after one product.
        grown = filtered(passes, q, vq, cut, how.degree) if cut > 1e-6 * largest else vq
        q, _ = np.linalg.qr(np.hstack([grown[:, :-1], rng.standard_normal((width, 1))]))
    raise RuntimeError(f"components not certified in {how.rounds} rounds: residual {worst:.1e} of the largest eigenvalue")


def fit(rows: DataFrame, how: Filter = Filter()) -> Whitening | None:
    """Whitening from the distinct vectors of rows (id, x); None where nothing varies."""
    ship(rows.sparkSession)
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    first = distinct.first()
    if first is None:
        return None
    n, sums = exact_sums(distinct, len(first.x))
    passes = Passes(distinct, n, sums)
    trace = passes.trace()
    if n == 1 or trace == 0:
        return None
    values, axes, residual = leading(passes, min(how.components, passes.width), how)
    keep = values > ZERO * values[0]
    found = Whitening(n, sums, axes[:, keep], values[keep], trace, residual[keep], 0)
    gram = passes.total((int(keep.sum()),) * 2, Gram(found.axes / np.sqrt(found.values))) / n
    found.identity_error, found.passes = float(np.abs(gram - np.eye(len(gram))).max()), passes.count
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, in whole numbers; None beyond a long."""
    reach = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if reach * reach * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each row and component."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    width, k = len(model.sums), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scaled, share = m.axes / np.sqrt(m.values), m.values / m.trace
        for piece, x in matrices(batches, width, column=1, numbers=1 << 18):
            row = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), m.n)), pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(row)),
                    pa.array(((x - m.mean) @ scaled).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(row), m.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(
        project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def op13_whitening(spark, sf_dir: str, how: Filter = Filter()) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    model = fit(rows, how)
    if model is None:
        return spark.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    return whiten(rows, model).withColumnRenamed("id", "vec_id")
