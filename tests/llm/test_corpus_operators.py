"""Operators against brute force on small tables with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from fleetpulse.llm import ann, line_dedup, mixing, packing, quality, simhash, substring_dedup, toxicity, url_rules, warc
from fleetpulse.llm.components import connected
from fleetpulse.llm.induced_sort import suffix_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def prose(seed: int, n: int, spread: int = 1000) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i % 10]}{i % spread}" + ("\n" if i % 13 == 0 else "") for i in rng.integers(0, 10 * spread, n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 4000)
    near = prose(2, 300).split(" ")
    twin = " ".join([*near[:150], "changed", *near[151:]])
    passage = prose(3, 60, 50)
    texts = [
        prose(2, 300), twin, None, "", " \t\n", "one", "one two", long, long + " end", prose(4, 80), prose(4, 80),
        "a " * 3000, prose(5, 70) + " " + passage, passage + " " + prose(6, 70), "x\ny\nz\nw", "x\ny\nz\nv\nx\ny\nz", "\n\n\n\n\n\n",
        "é" * 200, "ü ß 漢字 " * 30, "A.B c,D " * 20,
    ]
    out = [(i, t, ["en", "de", None][i % 3], ["big", "small", None][min(i % 5, 2)], len(t) if t is not None else None, "k", "r") for i, t in enumerate(texts)]
    out += [(7, long, "de", "big", len(long), "k", "r"), (None, prose(8, 90), None, None, None, None, None), (None, "one two", "en", "big", 7, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def order(doc_id):
    return -math.inf if doc_id is None else doc_id


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_lines(docs, rows, empty):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        lines = [] if t is None else t.split("\n")
        for p in range(len(lines) - 2):
            run = "\n".join(lines[p : p + 3])
            if words(run):
                first[run] = min(first.get(run, (math.inf, 0)), (order(d), p))
    want = Counter()
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            run = "\n".join(lines[p : p + 3])
            if words(run) and first[run] < (order(d), p):
                gone |= {p, p + 1, p + 2}
        spans = sum(p - 1 not in gone for p in gone)
        kept = t if not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone)
        want[(d, kept, len(lines), len(gone), spans)] += 1
    cut = line_dedup.cut_lines(docs)
    assert cut.columns == [*docs.columns, "line_total", "line_removed", "line_spans"]
    got = Counter((r.doc_id, r.text, r.line_total, r.line_removed, r.line_spans) for r in cut.collect())
    assert got == want
    assert line_dedup.cut_lines(empty).count() == 0


def counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, empty):
    got = Counter((r.doc_id, *(r[c] for c in quality.STATS)) for r in quality.with_stats(docs).collect())
    assert got == Counter((d, *counts(t)) for d, t, *_ in rows)
    assert quality.with_stats(empty).count() == 0


def test_quality_counts_when_hashes_meet(spark, monkeypatch):
    """With hardly any hash bits different windows meet, and the exact way takes over."""
    monkeypatch.setattr(quality, "POSITION_BITS", 61)
    texts = [prose(i, 200, 3) for i in range(3)] + ["a b c d a b c", "a a a a"]
    got = quality.with_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [counts(t)[4] for t in texts]


def brute_steps(rows, good_ids, limit=0.02, level=0.05):
    """Last admitted step of each stratum: every step is judged on its own, in order, until one fails."""
    def rejects(r, upto):
        value = {"symbol_rate": r[4] / max(r[3], 1), "repeat_rate": r[6] / max(r[2], 1), "dup_lines_per_word": r[5] / max(r[2], 1), "mean_word_length": r[3] / max(r[2], 1)}
        return any(value[rate] > c for rate, c in quality.steps()[:upto])

    holdout = {}
    for r in rows:
        if r[0] in good_ids and not r[7]:
            holdout.setdefault(r[1], {}).setdefault(r[0], []).append(r)
    every, out = sum(map(len, holdout.values())), {}
    for lang, documents in holdout.items():
        n, step = len(documents), 0
        while step < len(quality.steps()):
            k = sum(any(rejects(r, step + 1) for r in copies) for copies in documents.values())
            tail = sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(k + 1)) if k < n * limit else 1
            if tail > level * n / every:
                break
            step += 1
        out[lang] = (n, step)
    return out


def test_cutoffs_keep_their_promise(spark):
    rng = np.random.default_rng(0)
    names = [None, "de", "en", "en", "en", "en"]
    rows = [
        (i, "rare" if i % 40 == 0 else names[i % 6], 100, int(rng.integers(400, 690)), int(rng.integers(0, 30)) if i % 4 else 200,
         int(rng.integers(0, 8)) if i % 9 == 0 else 0, int(rng.integers(0, 34)), i % 50 == 7)
        for i in range(4000)
    ]
    rows += rows[100:300] + [(5, "en", 100, 500, 400, 0, 0, False)]  # repeated rows, and a bad row under a good id
    stats = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    marks = [(i, int(i % 4 > 0), 0) for i in range(4000)]
    labels = spark.createDataFrame([*marks, *marks[:1500], (-1, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    chosen = quality.choose_steps(stats, labels)
    got = {r.stratum: (r.n, r.step) for r in chosen.collect()}
    want = brute_steps(rows, {i for i, q, _ in marks if q})
    assert got == {lang: v for lang, v in want.items()}
    assert 0 < got["en"][1] < len(quality.steps()) and got[None][1] > 0
    assert "rare" not in got  # without a good label there is no promise, and nothing is rejected
    in_force = {(r.stratum, r.rate): r.cutoff for r in quality.cutoffs_of(chosen).collect()}
    assert in_force[("en", "symbol_rate")] == min(c for r, c in quality.steps()[: got["en"][1]] if r == "symbol_rate")
    judged = quality.judge(stats, chosen)
    assert judged.count() == len(rows)
    assert judged.filter("lang = 'rare' and not base_failed and not kept").count() == 0
    for r in judged.filter("not base_failed").collect():
        limits = {rate: c for (lang, rate), c in in_force.items() if lang == r.lang}
        values = {"symbol_rate": r.n_symbols / r.word_chars, "repeat_rate": r.n_repeat_words / 100, "dup_lines_per_word": r.n_dup_lines / 100, "mean_word_length": r.word_chars / 100}
        assert r.kept == (not any(values[rate] > c for rate, c in limits.items()))
    nothing = quality.judge(stats, quality.choose_steps(stats, labels.limit(0)))
    assert nothing.filter("kept").count() == sum(not r[7] for r in rows)


def test_too_few_labels_reject_nothing(spark):
    """One good document fewer than a step without any rejection needs, and just enough."""
    enough = math.ceil(math.log(0.05) / math.log(0.98))
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    for n, step in ((enough - 1, 0), (enough, len(quality.steps()))):
        stats = spark.createDataFrame([(i, "en", 100, 500, 0, 0, 0, False) for i in range(n)], schema)
        labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
        assert [(r.n, r.step) for r in quality.choose_steps(stats, labels).collect()] == [(n, step)]


def test_quality_counts_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b c d a b c", "en", -5, "x")], "doc_id long, text string, lang string, n_words long, base_failed string")
    row = quality.with_stats(docs).first()
    assert row.n_words == 7 and row.base_failed is True


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_fingerprints_and_groups(docs, rows, empty, spark):
    printed = simhash.with_fingerprints(docs)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in printed.collect())
    assert got == Counter((d, brute_fingerprint(t)) for d, t, *_ in rows)
    kept = simhash.near_dedup_stage(spark, docs, "").collect()
    comp = components([brute_fingerprint(t) for _, t, *_ in rows])
    assert len(kept) == len(set(comp.values()))
    least = defaultdict(lambda: math.inf)
    for d, t, *_ in rows:
        c = comp[brute_fingerprint(t)]
        least[c] = min(least[c], math.inf if d is None else d)
    assert all((math.inf if r.doc_id is None else r.doc_id) == least[comp[brute_fingerprint(r.text)]] for r in kept)
    assert simhash.near_dedup_stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("bucket", [512, 8])
def test_pigeonring_loses_no_link(spark, bucket):
    """Random prints, a crowded ball and a long chain; small buckets send them through every level."""
    rng = np.random.default_rng(1)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    centre = int(rng.integers(0, 1 << 63))
    prints |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    walk = int(rng.integers(0, 1 << 63))
    for i in range(40):
        walk ^= sum(1 << int(b) for b in set(rng.integers(0, 63, 3)))
        prints.add(walk)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {r.node: r.root for r in connected(simhash.links(frame, bucket)).collect()}
    want = components(prints)
    groups = lambda m: {frozenset(x for x in prints if m.get(x, x) == c) for c in {m.get(x, x) for x in prints}}
    assert groups(got) == groups(want)


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs.repartition(2)).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    total = Counter()
    for d, t, *_ in rows:
        total[d] += len(encoder.encode(t or "", add_special_tokens=False).ids) + 1
    assert Counter({d: n for d, n in total.items()}) == sum((Counter({d: length * k}) for (d, _, length, _, _), k in pieces.items()), Counter())
    single = {d: t for d, t, *_ in rows if Counter(r[0] for r in rows)[d] == 1}
    for (d, start, length, crc, n), _ in pieces.items():
        if d in single:
            ids = np.array([*encoder.encode(single[d] or "", add_special_tokens=False).ids, 1], dtype="<u4")
            assert (n, crc) == (len(ids), zlib.crc32(ids[start : start + length].tobytes()))
    assert packing.pack(empty).count() == 0


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Tokens()
    for text in ["", " a", "a  b", "x <|endoftext|> y <|", "a\n\n b", "it's 'll don't", "a\u3000 b", "\x1c a", "é 漢字 $$$ 12", " ", "🙂 \x00"]:
        assert list(ours.encode(text)) == encoder.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_rule():
    """Placement against the definition: least sum of squares over all choices, fullest level first."""
    rng = np.random.default_rng(2)
    packer = packing.Packer(32)
    for size in rng.integers(1, 32, 500):
        before = packer.count.copy()
        best = None
        for level in [0, *np.flatnonzero(before[1:] > 0) + 1]:
            if level + size <= 32:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 32
                value = (int((after[1:32] ** 2).sum()), -level)
                best = min(best or value, value)
        packer.place((0, 0, np.zeros(size), int(size)))
        assert int((packer.count[1:32] ** 2).sum()) == best[0]
    assert packer.count[32] == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    for trial in range(60):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 150)), 0).astype(np.uint8)
        cap = int(rng.choice([8, 13, 50]))
        positions, common = suffix_order(text, cap, budget=int(rng.choice([5, 1000])))
        data = text.tobytes()
        assert sorted(positions) == list(range(len(data)))
        for i in range(1, len(data)):
            a, b = data[positions[i - 1] :], data[positions[i] :]
            n = next((k for k in range(min(len(a), len(b), cap)) if a[k] != b[k]), min(len(a), len(b), cap))
            assert common[i] == n and (n == cap or a[n : n + 1] < b[n : n + 1])


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substrings(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    least = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], math.inf), order(d))
    want = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < order(d):
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.remove_earlier(docs).collect())
    assert got == want
    assert substring_dedup.remove_earlier(empty).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8))
    x[20:60] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (750, [0.0] * 8), (800, [float("nan")] * 8), (850, [None] + [1.0] * 7), (900, [1.0]), (None, [1.0] * 8), (50, x[50].tolist())]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")), "vec_id", "embedding")
    how = ann.Index(sample=300, parts=8, probes=8, chunk=64, epochs=2)
    found = ann.search(vectors, vectors.filter("id % 50 = 0"), ann.fit(vectors, how), how, 5).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    for q in range(0, 600, 50):
        score = sorted((-(v * x[q]).sum() / np.sqrt((v * v).sum()) / np.sqrt((x[q] * x[q]).sum()), i) for i, v in good if i != q)[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in score]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], [-s for s, _ in score], atol=1e-12)
    assert ann.fit(vectors.limit(0), how) is None


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-310])
def test_nearest_at_any_size(spark, size, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 6))
    spark.createDataFrame([(i, (v * size).tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = ann.op6_learned_partitions(spark, str(tmp_path), ann.Index(parts=4, probes=4)).collect()
    unit = (x * size) / np.abs(x * size).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    for q in (0, 50, 100):
        score = unit @ unit[q]
        score[q] = -2
        mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[1] for m in mine] == np.argsort(-score)[:5].tolist() and np.allclose([m[2] for m in mine], np.sort(score)[::-1][:5], atol=1e-9)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    empty.write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert ann.op6_learned_partitions(spark, f"{tmp_path}/none").count() == 0


def test_registered_search_recall(spark):
    """The registered query at its own settings against brute force."""
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding.to_numpy()).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = ann.op6_learned_partitions(spark, sf).toPandas()
    hits = total = 0
    for row in np.flatnonzero(table.vec_id % 50 == 0):
        score = x @ x[row]
        score[row] = -2
        best = set(table.vec_id[np.argsort(-score)[:5]])
        hits, total = hits + len(best & set(found.vec_id[found.query_id == table.vec_id[row]])), total + 5
    assert hits / total >= 0.9


def test_network_gradients():
    texts = [b"a bc stupid def", b"hello world foo", b"x"]
    model = {k: v.astype(np.float64) for k, v in toxicity.fresh_model(1).items()}
    document, number, features = toxicity.word_table(texts)
    _, ids = toxicity.windows_of(document, number, 3)
    truth = np.array([1.0, 0, 1])

    def loss():
        p = toxicity.sigmoid(toxicity.forward(model, toxicity.embed(model, features), ids))
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()

    for name, g in toxicity.gradients(model, features, ids, truth, np.ones(3)).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model[name][at]
        model[name][at] = old + 1e-4
        up = loss()
        model[name][at] = old - 1e-4
        down = loss()
        model[name][at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-5, name


def naive_window(model, words_in):
    """One window through the network, word by word and unit by unit of the definition."""
    _, number, features = toxicity.word_table([b" ".join(words_in)])
    x = [toxicity.embed(model, features)[i] for i in number]
    logistic = lambda v: 1 / (1 + np.exp(-v))
    n, states = toxicity.STATE, {}
    for way, at in (("f", 0), ("b", 3 * n)):
        h, u = np.zeros(n), model[f"state_{way}"]
        for i in range(len(x))[:: 1 if way == "f" else -1]:
            v = x[i] @ model["in"][:, at : at + 3 * n] + model["in_bias"][at : at + 3 * n]
            r, z = logistic(v[:n] + h @ u[:, :n]), logistic(v[n : 2 * n] + h @ u[:, n : 2 * n])
            c = np.tanh(v[2 * n :] + r * (h @ u[:, 2 * n :]))
            h = z * h + (1 - z) * c
            states[way, i] = h
    both = [np.concatenate((states["f", i], states["b", i])) for i in range(len(x))]
    look = np.exp([np.tanh(s @ model["look"] + model["look_bias"]) @ model["pick"] for s in both])
    return logistic(sum(w * s for w, s in zip(look / look.sum(), both)) @ model["out"] + model["out_bias"][0])


def test_scores_equal_a_network_run_window_by_window():
    model = {k: 3 * v for k, v in toxicity.fresh_model(4).items()}
    texts = [prose(i, n, 60).encode() for i, n in enumerate((1, 7, 40, 41, 47, 48, 49, 133))] + [b"", b" \n "]
    got = toxicity.score_texts(model, texts)
    for text, score in zip(texts, got):
        w = text.split()
        starts = {min(s, max(len(w) - 40, 0)) for s in range(0, len(w), toxicity.STRIDE)}
        want = max((naive_window(model, w[s : s + 40]) for s in starts), default=0.0)
        assert abs(score - want) < 1e-5


def test_every_short_passage_lies_whole_in_a_window():
    longest = toxicity.WINDOW - toxicity.STRIDE + 1
    assert longest >= 25
    for n in range(1, 140):
        _, start = toxicity.window_starts(np.array([n]))
        for first in range(max(n - longest, 0) + 1):
            last = min(first + longest, n)
            assert any(s <= first and last <= s + toxicity.WINDOW for s in start)


def test_long_texts_are_scored_in_bounded_memory():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(48)), "text": [prose(i % 5, 20000, 300) for i in range(48)]})
    tracemalloc.start()
    out = pa.Table.from_batches(toxicity.score_batches(toxicity.fresh_model(2), [batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 48 and peak < 400 << 20
    scores = out.column("score").to_pylist()
    assert np.allclose(scores[:5], scores[5:10], atol=1e-6)  # repeated texts score alike, whatever the batch


def test_toxicity(spark, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(i, int(rng.integers(5, 150)), 40).split(" ")
        if bad:
            w[int(rng.integers(0, len(w)))] = ["moron", "scum,"][i % 2]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(500, None), (501, ""), (None, "calm words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = toxicity.Training(documents=(200, 100), epochs=30, batch=64)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), how)
    score = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(score[i] >= 0.7) == (i % 4 == 0) for i in unseen])
    assert right > 0.95 and score[500] == score[501] == 0
    assert all(0 <= s <= 1 for s in score.values())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none is None and {r.score for r in toxicity.with_scores(docs, none).collect()} == {0.0}
    assert toxicity.with_scores(empty, model).count() == 0


def test_mixing(docs, rows, empty):
    mix = mixing.Mix(max_epochs=3.0, blocks=4)
    got = mixing.mix_sources(docs, mix).collect()
    drawn = Counter((r.source, r.doc, r.row.text) for r in got)
    assert set(drawn) == {(s, d, t) for d, t, _, s, *_ in rows}  # nothing is dropped
    tokens = Counter()
    for d, t, _, s, *_ in rows:
        tokens[s] += len(words(t))
    for s, n in tokens.items():
        taken = sum(r.tokens for r in got if r.source == s)
        budget = next(r.budget for r in got if r.source == s)
        assert taken <= budget <= 3.01 * n and taken >= budget - max(r.tokens for r in got if r.source == s)
    most, least = max(tokens.values()), min(tokens.values())
    exponent = got[0].exponent
    assert (least / most) ** (exponent - 1) <= 3.0 + 1e-9 and (exponent < 1e-9 or (least / most) ** (exponent - 1) > 3.0 - 1e-6)
    flat = mixing.mix_sources(docs, mixing.Mix(max_epochs=1e9, entropy=0.5, blocks=4)).select("source", "weight").distinct().collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in flat) - 0.5) < 1e-6 or next(iter(flat)).weight > 0
    assert mixing.mix_sources(empty, mix).count() == 0


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://org": ("org", "", None, "allow"),
        "https://x.org/": ("x.org", "/", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://b.com/de/?x": ("b.com", "/de/", "com/de/", "block"),
        "mailto:x": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://?a/b": ("", "", None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(None, "https://x.org/", "h"), (0, "mailto:x", None)]
    rows += [(100 + i, f"http://spam{i % 3}.com/de/{i}", "h") for i in range(40)] + [(200, "http://spam1.net/de/5", "h")]
    got = url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.url in cases:
            assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert next(r for r in got if r.page_id == 200).verdict == "block"  # mined from the labelled ones
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.filter_urls(none).count() == 0


def test_revisits(spark):
    u = "http://www.A.com/x/?utm_source=f#t"
    rows = [
        (1, u, 10, "response", {"ETag": '"a"', "Content-Type": "t", "X": "1"}, "d1"),
        (2, "https://a.com/x", 5000, "response", {"etag": '"b"', "Last-Modified": "m", "Content-Length": "9"}, "d2"),
        (3, "https://a.com/x/", 20, "revisit", {"ETag": 'W/"a"', "Content-Type": "new", "X": "2"}, None),
        (4, "https://a.com/x", 5000, "revisit", {"ETag": '"b"'}, None),
        (5, "https://a.com/x", 9000, "revisit", {"Last-Modified": "m", "Content-Length": "0"}, None),
        (6, "https://a.com/x", 9000, "revisit", None, None),
        (7, "https://b.com/x", 9000, "revisit", {"ETag": '"a"'}, None),
        (8, None, 9000, "revisit", {"ETag": '"a"'}, None),
        (9, "https://a.com/x", None, "revisit", {"ETag": '"a"'}, None),
        (5, "https://a.com/x", 9000, "revisit", {"Last-Modified": "m", "Content-Length": "0"}, None),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, url string, at long, kind string, headers map<string,string>, digest string, canonical string")
    got = {r.record_id: r for r in warc.resolve_revisits(frame).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {
        3: ("resolved", 1), 4: ("mismatch", 1), 5: ("resolved", 2), 6: ("unchecked", 2), 7: ("missing", None), 8: ("missing", None), 9: ("missing", None),
    }
    assert got[3].headers == {"etag": 'W/"a"', "content-type": "t", "x": "2"} and got[3].digest == "d1"
    assert got[5].headers == {"etag": '"b"', "last-modified": "m", "content-length": "9"}
    assert warc.resolve_revisits(frame).count() == 8 and warc.resolve_revisits(frame.limit(0)).count() == 0


def test_stages_take_odd_tables(spark, docs, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, empty, sf).count() == 0, name
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert out.count() >= 1, name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    verdicts = {r.doc_id for r in quality.op8_quality_rules(spark, sf).filter("kept").collect()}
    assert kept == verdicts
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} <= kept and pieces
