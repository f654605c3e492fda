"""Filter audit, pivot search and whitening against brute force."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from fleetpulse.llm import filter_audit, pivot_search, whitening

DOCS = "doc_id long, text string, lang string, source string, part string, mask string, n long"
LABELS = "doc_id long, quality int, toxic int, good string"
VECTORS = "vec_id long, embedding array<double>, id string, x string, d string, cell string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "i", "x", "d", "c", "n") for i, v in rows], VECTORS)


# -- audit -------------------------------------------------------------------


def audited(docs, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in labels:
        if d is not None:
            good[d] |= q == 1
            toxic[d] |= t == 1
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", math.inf), d)
    judged = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t],
        }
        judged.append((s or "", {f for f in fails if fails[f]}, good[d], toxic[d]))
    out = Counter()
    parts = {p for p, *_ in judged}
    for order in itertools.permutations("ABCDE"):
        for part in parts:
            left = [j for j in judged if j[0] == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                hit = [j for j in left if letter in j[1]]
                left = [j for j in left if letter not in j[1]]
                redundant = sum(letter in j[1] for j in everyone) - len(hit)
                only = sum(j[1] == {letter} for j in everyone)
                out[part, "".join(order), step] = (len(left), len(hit), redundant, only, sum(j[2] for j in hit), sum(j[3] for j in hit))
    shapley = Counter()
    for (part, order, step), m in out.items():
        shapley[part, order[step - 1]] += m[1]
    return {(*k, *m, shapley[k[0], k[1][k[2] - 1]]) for k, m in out.items()}


def ask_audit(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "en", s, "p", "m", 3) for i, t, s in docs], DOCS)
    k = spark.createDataFrame([(*r, "g") for r in labels], LABELS)
    return filter_audit.audit(filter_audit.mask_cells(d, k), "ABCDE")


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long, "a " * 300, "A B c $", None, "", long.upper(), long + " #", "é" * 30, "x|y", long + "\x85A B", "A" * 5000 + " b" * 400]
    docs = [(i, t, ["big", None, "", "small"][min(i % 7, 3)]) for i, t in enumerate(texts * 3)]
    docs += [(3, "A B c $", "big"), (0, long, "big"), (0, long, "small"), (None, long, "big"), (None, "only here", None), (None, "only here", None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (999, 1, 1), (6, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = ask_audit(spark, docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 3 * 600 and set(rows) == audited(docs, labels)


def test_audit_empty(spark):
    assert ask_audit(spark, [], []).count() == 0
    # One document without failures: zeros in every row.
    rows = ask_audit(spark, [(1, " ".join(f"w{i}" for i in range(200)), "s")], []).collect()
    assert len(rows) == 600 and {tuple(r)[3:] for r in rows} == {(1, 0, 0, 0, 0, 0, 0)}


# -- search ------------------------------------------------------------------


def best(rows, k=5):
    whole = [
        (i, [math.floor(256 * c) for c in v]) for i, v in rows
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    asked = {(i, tuple(x)) for i, x in whole if i % 50 == 0}
    out = []
    for i, q in asked:
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def ask_search(spark, rows, how=pivot_search.Pivots(), k=5):
    x = pivot_search.integers(vectors(spark, rows), "vec_id", "embedding")
    return pivot_search.search(x, x.filter(F.col("id") % 50 == 0), k, how)


SMALL = pivot_search.Pivots(pivots=6, sample=64, chunk=48, first=8)


def test_search_noise_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 7)) * rng.choice([0.1, 1, 30], size=(400, 1)))]
    same = rows[50][1]
    rows += [(1000 + i, same) for i in range(150)]  # a hot vector, ties by id
    rows += [(200, rows[200][1]), (77, rows[77][1]), (100, [3.0] * 7), (None, same), (2000, None), (2001, [1.0, None]), (2050, [float("nan")] * 7)]
    rows += [(2051, [float("inf")] * 7), (2052, []), (2100, []), (2101, [5.0]), (2150, [1.0, 2.0, 3.0]), (2102, [0.0] * 7), (2103, [-0.0001] * 9)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ask_search(spark, rows, SMALL).collect())
    assert got == best(rows)
    usual = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ask_search(spark, rows).collect())
    assert usual == got


def test_search_large_values(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(120, 5)) * 1e6)]
    rows += [(500, [1e200] * 5), (501, [1e-200] * 5)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ask_search(spark, rows, SMALL).collect())
    assert got == best([r for r in rows if r[0] != 500])  # too long for a score


def test_search_few(spark):
    assert ask_search(spark, []).count() == 0
    assert ask_search(spark, [(50, [1.0, 2.0])]).count() == 0
    assert [tuple(r)[:4] for r in ask_search(spark, [(50, [1.0]), (1, [2.0])]).collect()] == [(50, 1, 1, 256 * 512)]


def test_search_leaves_out_most_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    points = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.05
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(points)]
    found = ask_search(spark, rows, pivot_search.Pivots(pivots=20, sample=500, chunk=512, first=16)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == best(rows)
    assert sum(r.seen for r in found if r.rank == 1) < 0.1 * 40 * 2000


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for scale in (1, 1000, 2**25):
        x = (rng.normal(size=(300, 8)) * scale).astype(np.int64)
        top = pivot_search.squares(x).max()
        pivots = x[:9]
        model = pivot_search.Model(pivots, np.sqrt(np.maximum(top - pivot_search.squares(pivots), 0)), top)
        q, c = model.distances(x, True), model.distances(x, False)
        apart = np.abs(q[:, None, :] - c[None, :, :]).max(axis=2)
        exact = x.astype(object) @ x.T.astype(object)
        assert (model.bound(pivot_search.squares(x), apart) >= exact).all()


# -- whitening ---------------------------------------------------------------


def dense(rows, k=4):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=np.int64)
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(axis=0)
    c = once - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    keep = [j for j in range(min(k, len(values))) if values[j] > 1e-12 * values[0]]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def ask_whitening(spark, rows, how=whitening.Filter()):
    x = whitening.integers(vectors(spark, rows), "vec_id", "embedding")
    model = whitening.fit(x, how)
    return (model, whitening.whiten(x, model).collect()) if model else (None, [])


def check_whitening(spark, rows, sound=None, how=whitening.Filter(), close=1e-8):
    sound = rows if sound is None else sound
    model, found = ask_whitening(spark, rows, how)
    n, deviation, white, share = dense(sound)
    assert len(found) == len(sound) * len(share)
    assert {r.n for r in found} == {n} and {r.identity_error for r in found} == {model.identity_error} and model.identity_error < 1e-9
    for j in range(len(share)):
        mine = sorted((r for r in found if r.component == j + 1), key=lambda r: (r.id, r.deviation, abs(r.whitened)))
        order = sorted(range(len(sound)), key=lambda i: (sound[i][0], deviation[i], abs(white[i, j])))
        assert [(r.id, r.deviation) for r in mine] == [(sound[i][0], deviation[i]) for i in order]
        a, b = np.array([r.whitened for r in mine]), white[order, j]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < close
        assert abs(mine[0].explained - share[j]) < 1e-10 * share[j]
    return model


def test_whitening_noise_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(900, 48)) * 0.12
    points[:, 0] *= 1.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(points)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)] + [(3, rows[3][1]), (4, rows[9][1])]
    odd = [(6000, None), (6001, [None] * 48), (6002, [float("nan")] * 48), (6003, [float("-inf")] * 48), (6004, [1.0] * 47), (6005, []), (6006, [1e300] * 48)]
    model = check_whitening(spark, rows + odd, rows, whitening.Filter(block=10, degree=6))
    assert model.passes > 10 and (model.residual <= 1e-12 * model.values[0]).all()
    assert len(ask_whitening(spark, [(None, rows[0][1]), *rows[1:60]], whitening.Filter())[1]) == 240


def test_whitening_without_gaps_and_low_rank(spark):
    rng = np.random.default_rng(6)
    flat = [(i, [float(c) for c in v]) for i, v in enumerate(np.vstack([np.eye(40), -np.eye(40)]))]
    model, found = ask_whitening(spark, flat, whitening.Filter(block=8))
    assert len(found) == 320 and model.identity_error < 1e-9 and np.allclose(model.values, model.values[0])
    thin = rng.integers(-40, 40, size=(200, 2)) @ rng.integers(-3, 3, size=(2, 60)) / 256.0
    check_whitening(spark, [(i, [float(c) for c in v]) for i, v in enumerate(thin)], how=whitening.Filter(block=8))
    check_whitening(spark, [(i, [float(c)]) for i, c in enumerate(rng.normal(size=30))])
    near = rng.normal(size=(400, 40)) @ np.diag([1 + 1e-4 * i for i in range(40)])
    check_whitening(spark, [(i, [float(c) for c in v]) for i, v in enumerate(near)], how=whitening.Filter(block=8), close=1e-6)


def test_whitening_few(spark):
    assert ask_whitening(spark, []) == (None, [])
    assert ask_whitening(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == (None, [])
    model, found = ask_whitening(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])])
    assert len(found) == 3 and model.n == 2 and sorted(abs(r.whitened) for r in found) == [1.0] * 3


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening.deviations(x, 2, [7, 0]) == [None, 1 + 64]
    assert whitening.deviations(np.array([[2, 5]]), 3, [6, 0]) == [225]


@pytest.mark.parametrize("name", ["op12_pivot_search", "op13_whitening"])
def test_queries_on_an_empty_table(spark, tmp_path, name):
    import __spark_entry__ as E

    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert E.queries()[name](spark, str(tmp_path)).count() == 0
