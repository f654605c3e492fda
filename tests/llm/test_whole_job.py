"""Tests of what the second review found missing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from fleetpulse.llm import jaccard, mixing, simhash, substring_dedup
from fleetpulse.llm.common import byte_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fives(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("bucket", [512, 6])
def test_near_dedup_links_all_texts_of_similar_words(spark, monkeypatch, bucket):
    """Copies at every similarity about 0.8, a chain and a common passage, against all pairs by brute force."""
    monkeypatch.setattr(jaccard.groups, "__defaults__", (bucket,))
    rng = np.random.default_rng(0)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, texts = fresh(40), []
    for changes in range(16):
        base = fresh(200)
        for _ in range(3):
            other = list(base)
            for at in rng.choice(200, changes, replace=False):
                other[at] = "changed"
            texts.append(" ".join(other))
    walk = fresh(120)
    for i in range(25):
        walk[4 * i] = f"step{i}"
        texts.append(" ".join(walk))
    texts += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(40)]
    sets = [fives(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.MAX_BITS
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert far > 10  # links that three bits would miss
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in simhash.near_dedup_stage(spark, docs, "").collect()} == {find(i) for i in range(len(texts))}


def test_mixing_stage_follows_the_permuted_epochs(spark):
    rows = [(i, f"text {i} " * 40, "en", "big", 1) for i in range(120)] + [(200 + i, f"small {i}", "en", "small", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(docs).select("doc", "epoch", "block_key", "doc_key").collect()
    assert max(r.epoch for r in mixed) == 3  # the small source is drawn four times
    want = [r.doc for r in sorted(mixed, key=lambda r: (r.epoch, r.block_key, r.doc_key))]
    got = [r.doc_id for r in mixing.mixing_stage(spark, docs, "").collect()]
    assert got == want
    assert all(a != b for a, b in zip(got, got[1:]))


def test_a_passage_of_many_texts_gives_few_candidates(spark):
    """600 texts of 52 words share a passage of 12: it is no key, as it is frequent in the corpus, though no list names it."""
    rng = np.random.default_rng(7)
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 10**7, 20)), *passage, *(f"w{x}" for x in rng.integers(0, 10**7, 20))]) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    levels = jaccard.frequency_levels(docs)
    rows = jaccard.with_prefixes(docs, levels).select("doc_id", "prefix").toPandas()
    holders = {}
    for d, keys in zip(rows.doc_id, rows.prefix):
        for key in keys:
            holders.setdefault(key, set()).add(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    assert len(pairs) < 0.01 * 600 * 599 / 2


def test_frequency_levels_count_every_text(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 60))) for _ in range(300)] + [None, "", "one"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(7)
    levels = jaccard.frequency_levels(docs)
    counts = np.zeros(len(levels), dtype=np.int64)
    for t in texts:
        np.add.at(counts, (jaccard.shingles(t) % np.uint64(len(levels))).astype(np.int64), 1)
    assert (levels == np.frexp(counts.astype(float))[1]).all() and levels.max() > 1


def test_shared_keys_over_batch_borders():
    """Rows of keys with several nodes, and the first node of each key, however the sorted partition is cut."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        key = np.sort(rng.integers(0, int(rng.integers(1, 20)), n))
        table = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n) + 5), *(pa.array(np.arange(n, dtype=np.int32)) for _ in range(2)), pa.array(key)], names=["node", "n", "place", "key"]
        )
        cuts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 8))))
        batches = [table.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, n])]
        got = sorted(tuple(r.values()) for b in jaccard._shared(iter(batches)) for r in b.to_pylist())
        first = {k: int(np.flatnonzero(key == k)[0]) for k in set(key.tolist())}
        want = [(i + 5, i, i, k, first[k] + 5, first[k], first[k]) for i, k in enumerate(key.tolist()) if (key == k).sum() > 1]
        assert got == sorted(want)


def test_batches_are_cut_by_bytes():
    sizes = [10, 20, 4000, 10, 90_000, 5, 5, 5] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * s for s in sizes])], names=["text"])
    pieces = list(byte_batches(iter([batch]), limit=10_000))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= 20_000 for p in pieces)


def test_parity_maps_never_rule_out_a_link():
    rng = np.random.default_rng(10)
    kept = far = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.union1d(one[rng.random(len(one)) < rng.uniform(0.3, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, n)), dtype=np.uint64))
        both = len(np.intersect1d(one, other))
        maps = [np.frombuffer(jaccard.bitmap(x), dtype=np.uint64) for x in (one, other)]
        apart = np.bitwise_count(maps[0] ^ maps[1]).sum().astype(np.int64)
        assert apart <= len(one) + len(other) - 2 * both
        near = jaccard.near_maps(np.array([len(one)], np.int32), np.array([len(other)], np.int32), np.array([apart]))[0]
        assert near or 5 * both < 4 * (len(one) + len(other) - both)
        kept, far = kept + near, far + (5 * both < 3 * (len(one) + len(other) - both))
    assert kept < 300 and far > 100


def test_near_dedup_takes_pairs_from_fingerprints(spark, monkeypatch):
    """The stage's first candidates are the links of ``simhash``: all texts within its bits come together."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for _ in range(12):
        base = fresh(400)
        for i in range(4):
            texts.append(" ".join(base[:i] + ["other"] + base[i + 1 :]))
        texts.append(texts[-1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    taken, real, groups = [], simhash.near_pairs, jaccard.groups
    monkeypatch.setattr(simhash, "near_pairs", lambda printed: taken.append(([tuple(r) for r in printed.select("row", "text", "sig", "fp").collect()], real(printed))) or taken[0][1])
    monkeypatch.setattr(simhash.jaccard, "groups", lambda printed, near: taken.append([tuple(r) for r in near.collect()]) or groups(printed, near))
    assert len(simhash.near_dedup_stage(spark, docs, "").collect()) == 12
    (rows, _), pairs = taken
    first = {}
    for row, _, sig, fp in sorted(rows):
        first.setdefault(bytes(sig), (row, fp & (1 << 64) - 1))
    root = {row: row for row, _ in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    assert pairs and all(a > b and a in root and b in root for a, b in pairs)
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    near = [(a, b) for a, p in first.values() for b, q in first.values() if a < b and (p ^ q).bit_count() <= simhash.MAX_BITS]
    assert near and all(find(a) == find(b) for a, b in near)


def test_substring_contexts_are_stored_without_hashes(spark, monkeypatch):
    """What does not compress is not stored beside the bytes, and what was asked for is deleted before contexts are compared."""
    from pathlib import Path

    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i} head {passage} tail {i * i}") for i in range(20)], "doc_id long, text string")
    written, gone = {}, []

    def told(df, label):
        if label == "distinct-contexts":
            gone.append(not Path(written["wanted"].scratch_path).exists())
        written[label] = real(df, label)
        return written[label]

    real = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", told)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_earlier(docs).collect()}
    assert removed[0] == 0 and all(removed[i] >= len(passage) for i in range(1, 20))
    assert written["contexts"].columns == ["doc", "key", "h", "start", "windows", "bytes"] and gone == [True]


@pytest.mark.parametrize("hot", [4_000, 2])
def test_substring_passes_give_the_whole_result_and_free_their_tables(spark, monkeypatch, hot):
    """Packed anchors are not written beside their shuffle; a pass is gone from disk before the next one compares."""
    from pathlib import Path

    rng = np.random.default_rng(7)
    passages = [" ".join(f"w{n}" for n in rng.integers(0, 10_000, 14)) for _ in range(12)]
    texts = [f"{i} first {passages[i % 12]} then {passages[i * 5 % 12]} last {i * i}" for i in range(60)] + ["", "short", passages[0], passages[0]]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    least = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 49):
            least.setdefault(t[j : j + 50], i)
    want = {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 49):
            if least[t[j : j + 50]] < i:
                gone[j : j + 50] = True
        want[i] = (int(gone.sum()), "".join(c for c, g in zip(t, gone) if not g).encode())
    want[len(texts)] = (0, b"")
    labels, left = [], []

    def told(df, label):
        if label == "distinct-contexts":
            left.append(sum(Path(w.scratch_path).exists() for n, w in labels if n in ("distinct-contexts", "masks")))
        labels.append((label, real(df, label)))
        return labels[-1][1]

    real = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", told)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "PASS_BYTES", 1)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in substring_dedup.remove_earlier(docs).collect()}
    assert got == want
    names = [n for n, _ in labels]
    assert "anchors" not in names and left == [0] * substring_dedup.CONTEXT_PASSES and names.count("contexts") == substring_dedup.TEXT_PASSES
