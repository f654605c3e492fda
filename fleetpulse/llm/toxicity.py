"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as the embedding of the hashed word beside the mean embedding
of its hashed character n-grams.  Two gated recurrent networks read a window of
words forwards and backwards, attention pools their states, and a logistic unit
scores the pool.  Windows of ``WINDOW`` words start every ``STRIDE`` words of the
whole text and at its last ``WINDOW`` words, so every passage of up to
WINDOW - STRIDE + 1 words lies whole in a window; the text gets the highest
score.

Training runs in numpy on windows of a sample of labelled documents: at most
``Training.documents`` of the two classes, drawn by a hash of the id, with at most
``Training.windows`` windows from anywhere in each text.  Scoring runs in Arrow
batches cut by bytes, vectorised over windows; the model (a few MB, fixed by its
parameters) is broadcast.

Defined results: a null or empty text has no window and scores 0; repeated rows
score alike; labels other than 0 and 1 are not used; without labels of both
classes every text scores 0; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.llm.common import byte_batches, table
from fleetpulse.session import ship

THRESHOLD = 0.7
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 16
GRAMS = (3, 5)
EMBED, STATE, ATTEND = 8, 8, 8
WINDOW, STRIDE = 40, 8
SAMPLE_STRIDE = 32  # between windows that training may draw
CHUNK = 4096
BATCH_BYTES = 2 << 20

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHT = _LOWER.astype(np.uint64) + np.uint64(1)
_WEIGHT[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0
_EDGE = 1


@dataclass(frozen=True)
class Training:
    documents: tuple[int, int] = (3000, 1500)
    windows: int = 12
    epochs: int = 4
    batch: int = 256
    rate: float = 0.01
    seed: int = 5


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(document of each word, number of each word among the distinct ones, features of the distinct ones)."""
    joined = np.frombuffer(b" ".join([*texts, b""]) or b" ", dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offsets = np.cumsum(lengths) - lengths
    inside = ~_SPACES[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, {}
    document = np.searchsorted(offsets, starts, side="right") - 1
    place = _places(len(joined), starts)
    powers = np.cumprod(np.full(int((ends - starts).max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    value = np.where(inside, _WEIGHT[joined], np.uint64(0)) * powers[np.clip(place, 0, len(powers) - 1)]
    hashes = np.add.reduceat(value, starts)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return document, number, {"word": ((distinct >> np.uint64(40)) % np.uint64(WORD_ROWS)).astype(np.int64), **gram_table(joined, starts[first], ends[first])}


def _places(n: int, starts: np.ndarray) -> np.ndarray:
    place = np.arange(n)
    return place - np.concatenate((np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.append(starts, n)))))


def gram_table(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Hashed character n-grams of words, with marks at both ends; in runs by word."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()) + max(GRAMS), _EDGE, dtype=np.uint32)
    own = np.repeat(np.arange(len(size)), size - 2)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    flat[begin[own] + 1 + at] = _LOWER[joined[starts[own] + at]]
    word = np.repeat(np.arange(len(size)), size)
    end = (begin + size)[word]
    here = np.arange(len(word))
    codes, words = [], []
    for k in GRAMS:
        code = np.zeros(len(word), dtype=np.uint32)
        for j in range(k):
            code = (code + flat[j : j + len(word)]) * np.uint32(0x01000193) ^ (code >> np.uint32(15))
        fits = here + k <= end
        codes.append((code[fits] >> np.uint32(7)) % np.uint32(GRAM_ROWS))
        words.append(word[fits])
    every = np.concatenate(words)
    order = np.argsort(every, kind="stable")
    return {"gram": np.concatenate(codes)[order].astype(np.int64), "gram_count": np.bincount(every, minlength=len(size))}


def embed(model: dict[str, np.ndarray], features: dict[str, np.ndarray]) -> np.ndarray:
    count = features["gram_count"]
    sums = np.add.reduceat(model["grams"][features["gram"]], np.cumsum(count) - count, axis=0)
    return np.concatenate((model["words"][features["word"]], sums / count[:, None].astype(np.float32)), axis=1)


def window_starts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each window, its first word) from words per document.  The last window of a text ends with it."""
    per = np.where(count == 0, 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1))
    owner = np.repeat(np.arange(len(count)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return owner, np.minimum(nth * STRIDE, np.maximum(count[owner] - WINDOW, 0))


def window_ids(count: np.ndarray, number: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Word numbers [windows, WINDOW]; -1 pads."""
    if not len(number):
        return np.full((len(owner), WINDOW), -1)
    at = start[:, None] + np.arange(WINDOW)
    begin = (np.cumsum(count) - count)[owner][:, None]
    return np.where(at < count[owner][:, None], number[np.minimum(begin + at, len(number) - 1)], -1)


def windows_of(document: np.ndarray, number: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of each window, word numbers [windows, WINDOW])."""
    count = np.bincount(document, minlength=texts)
    owner, start = window_starts(count)
    return owner, window_ids(count, number, owner, start)


def fresh_model(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "words": draw(0.1, WORD_ROWS, EMBED), "grams": draw(0.3, GRAM_ROWS, EMBED),
        "in": draw(0.3, 2 * EMBED, 6 * STATE), "in_bias": np.zeros(6 * STATE, dtype=np.float32),
        "state_f": draw(0.2, STATE, 3 * STATE), "state_b": draw(0.2, STATE, 3 * STATE),
        "look": draw(0.3, 2 * STATE, ATTEND), "look_bias": np.zeros(ATTEND, dtype=np.float32), "pick": draw(0.3, ATTEND),
        "out": draw(0.3, 2 * STATE), "out_bias": np.zeros(1, dtype=np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def run_gates(inputs: np.ndarray, ids: np.ndarray, state_weights: np.ndarray, backwards: bool, tape: list | None = None) -> np.ndarray:
    """States [WINDOW, windows, STATE] of one direction; ``inputs`` are projected words, the last row of them for padding."""
    n, length = ids.shape
    h = np.zeros((n, STATE), dtype=inputs.dtype)
    states = np.empty((length, n, STATE), dtype=inputs.dtype)
    padded = (ids < 0).any()
    rows = np.ascontiguousarray(np.where(ids < 0, len(inputs) - 1, ids).T)
    x = np.empty((n, 3 * STATE), dtype=inputs.dtype)
    for t in range(length - 1, -1, -1) if backwards else range(length):
        np.take(inputs, rows[t], axis=0, out=x, mode="clip")
        u = h @ state_weights
        # The logistic function as a hyperbolic tangent, in place.
        gates = x[:, : 2 * STATE] + u[:, : 2 * STATE]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        r, z = gates[:, :STATE], gates[:, STATE:]
        c = r * u[:, 2 * STATE :]
        c += x[:, 2 * STATE :]
        np.tanh(c, out=c)
        new = np.subtract(h, c, out=states[t])
        new *= z
        new += c
        if padded:
            gone = rows[t] == len(inputs) - 1
            new[gone] = h[gone]
        if tape is not None:
            tape.append((t, h, r, z, c, u[:, 2 * STATE :]))
        h = new
    return states


def forward(model: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logit of each window; ``x`` embeds the distinct words."""
    projected = x @ model["in"] + model["in_bias"]
    projected = np.concatenate((projected, np.zeros((1, 6 * STATE), dtype=np.float32)))
    ways = {}
    tapes = {"f": [], "b": []} if tape is not None else {"f": None, "b": None}
    for way, part in (("f", slice(0, 3 * STATE)), ("b", slice(3 * STATE, 6 * STATE))):
        ways[way] = run_gates(np.ascontiguousarray(projected[:, part]), ids, model[f"state_{way}"], way == "b", tapes[way])
    states = np.concatenate((ways["f"], ways["b"]), axis=2)
    seen = np.tanh(states @ model["look"] + model["look_bias"])
    weight = np.where((ids >= 0).T, seen @ model["pick"], -np.inf)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pool = np.einsum("tn,tnk->nk", weight, states)
    if tape is not None:
        tape.update(tapes, states=states, seen=seen, weight=weight, pool=pool)
    return pool @ model["out"] + model["out_bias"][0]


def gradients(model: dict[str, np.ndarray], features: dict[str, np.ndarray], ids: np.ndarray, truth: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted logistic loss by back-propagation through time."""
    x = embed(model, features)
    tape: dict = {}
    logit = forward(model, x, ids, tape)
    d_logit = ((sigmoid(logit) - truth) * share / share.sum()).astype(np.float32)
    pool, states, weight, seen = tape["pool"], tape["states"], tape["weight"], tape["seen"]
    g = {"out": pool.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * model["out"]
    d_weight = np.einsum("nk,tnk->tn", d_pool, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_seen = d_score[:, :, None] * model["pick"] * (1 - seen**2)
    g["pick"] = np.einsum("tn,tnk->k", d_score, seen)
    g["look"] = np.einsum("tnk,tna->ka", states, d_seen)
    g["look_bias"] = d_seen.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_pool + d_seen @ model["look"].T
    d_projected = np.zeros((len(x) + 1, 6 * STATE), dtype=np.float32)
    for way, shift in (("f", 0), ("b", 1)):
        u = model[f"state_{way}"]
        d_u = np.zeros_like(u)
        d_h = np.zeros((len(ids), STATE), dtype=np.float32)
        for t, h, r, z, c, un in reversed(tape[way]):
            d_new = d_h + d_states[t][:, shift * STATE : (shift + 1) * STATE]
            live = (ids[:, t] >= 0)[:, None]
            d_live = np.where(live, d_new, 0)
            d_c = d_live * (1 - z) * (1 - c**2)
            d_z = d_live * (h - c) * z * (1 - z)
            d_r = d_c * un * r * (1 - r)
            d_in = np.concatenate((d_r, d_z, d_c), axis=1)
            d_gate = np.concatenate((d_r, d_z, d_c * r), axis=1)
            d_u += h.T @ d_gate
            d_h = np.where(live, d_live * z, d_new) + d_gate @ u.T
            np.add.at(d_projected, (ids[:, t], slice(shift * 3 * STATE, (shift + 1) * 3 * STATE)), d_in)
        g[f"state_{way}"] = d_u
    d_projected = d_projected[:-1]
    g["in"], g["in_bias"] = x.T @ d_projected, d_projected.sum(axis=0)
    d_x = d_projected @ model["in"].T
    g["words"] = np.zeros_like(model["words"])
    np.add.at(g["words"], features["word"], d_x[:, :EMBED])
    count = features["gram_count"]
    g["grams"] = np.zeros_like(model["grams"])
    np.add.at(g["grams"], features["gram"], np.repeat(d_x[:, EMBED:] / count[:, None], count, axis=0))
    return g


def train(texts: list[bytes], truth: np.ndarray, document: np.ndarray, how: Training = Training()) -> dict[str, np.ndarray]:
    """Model from windows of text, with Adam.

    A toxic document need not be toxic everywhere.  The first pass takes every
    window for what its document is, both classes weighing alike; the later
    ones take of each toxic document only the window that scores highest.
    """
    model = fresh_model(how.seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    rng = np.random.default_rng(how.seed)
    share = np.where(truth == 1, 0.5 / max(truth.mean(), 1e-9), 0.5 / max(1 - truth.mean(), 1e-9)).astype(np.float32)
    step = 0
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        order = rng.permutation(len(texts))
        if epoch:
            toxic = np.flatnonzero(truth == 1)
            scores = np.concatenate([score_texts(model, [texts[j] for j in toxic[i : i + 1024]]) for i in range(0, len(toxic), 1024)])
            ranked = toxic[np.lexsort((-scores, document[toxic]))]
            best = ranked[np.flatnonzero(np.diff(document[ranked], prepend=document[ranked[0]] - 1))]
            order = rng.permutation(np.concatenate((np.flatnonzero(truth == 0), best)))
            share = np.ones(len(texts), dtype=np.float32)
        for i in range(0, len(order), how.batch):
            part = order[i : i + how.batch]
            within, number, features = word_table([texts[j] for j in part])
            owner, ids = windows_of(within, number, len(part))
            if not len(owner):
                continue
            g = gradients(model, features, ids, truth[part][owner], share[part][owner])
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def score_texts(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Highest window score of each text; 0 without a word."""
    best = np.zeros(len(texts))
    document, number, features = word_table(texts)
    if not len(number):
        return best
    x = embed(model, features)
    count = np.bincount(document, minlength=len(texts))
    owner, start = window_starts(count)
    for i in range(0, len(owner), CHUNK):
        part = slice(i, i + CHUNK)
        ids = window_ids(count, number, owner[part], start[part])
        np.maximum.at(best, owner[part], sigmoid(forward(model, x, ids)).astype(np.float64))
    return best


def score_batches(model: dict[str, np.ndarray] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, score) of batches of (id, text)."""
    for batch in byte_batches(batches, BATCH_BYTES):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        scores = score_texts(model, texts) if model else np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(windows, label, document of each) of sampled labelled documents: bounded, so they may come to the driver."""
    ship(docs.sparkSession)
    ordered = F.struct(F.xxhash64("doc_id"), "doc_id")
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = [usable.filter(F.col("toxic") == c).orderBy(ordered).limit(how.documents[c]) for c in (0, 1)]
    wanted = chosen[0].unionByName(chosen[1])
    most, seed = how.windows, how.seed

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                starts = np.arange(0, max(len(words) - WINDOW, 0) + 1, SAMPLE_STRIDE)
                rng = np.random.default_rng([seed, abs(doc_id)])
                for s in rng.permutation(starts)[:most] if words else []:
                    out.append((toxic, b" ".join(words[s : s + WINDOW]), doc_id))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["toxic", "words", "document"])

    # As many ids as documents in the sample, a few dozen kB.
    sample = docs.join(F.broadcast(wanted), "doc_id").select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text")
    got = sorted((r.toxic, bytes(r.words), r.document) for r in sample.mapInArrow(rows, "toxic long, words binary, document long").collect())
    return [w for _, w, _ in got], np.array([t for t, _, _ in got], dtype=np.float32), np.array([d for _, _, d in got])


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> dict[str, np.ndarray] | None:
    texts, truth, document = training_windows(docs, labels, how)
    return train(texts, truth, document, how) if len(set(truth.tolist())) == 2 else None


def with_scores(docs: DataFrame, model: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from score_batches(sent.value, batches)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(rows, "doc_id long, score double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
