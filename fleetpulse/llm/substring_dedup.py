"""Removal of byte strings that an earlier document already holds.

Every byte of a document goes that lies in a string of ``length`` bytes which
also starts in a document with a smaller id.  Equal strings are brought together
by external induced sorting of suffixes with common-prefix values; what is
sorted, and where, is chosen so that every sort is bounded:

* A window is ``length`` bytes.  The 20-byte gram of least hash in it is its
  anchor, so equal windows have equal anchors.  Consecutive windows with one
  anchor make a context of at most ``2 * length - gram`` bytes.
* Only anchors found in two documents or more can matter.  Batches pack their
  hashes by bucket, combined first, and each bucket is compared in one sort;
  the packed hashes lie on disk once, in that shuffle.
* Of documents with one text only the first is compared; the others go whole.
  Anchors are counted by the 64-bit hash of their text.
* Contexts that are equal byte for byte are one row with their smallest id.
* The distinct contexts are dealt by anchor; an anchor with more than ``HOT`` of
  them is dealt by its single windows instead.  Each task sorts its contexts in
  chunks cut between anchors, and finds the smallest id of every class of
  windows with a common prefix of ``length``.
* Texts are cut into contexts in passes by their hash, contexts are compared in
  passes by what they are dealt by.  Equal windows meet in one pass, and the
  disk holds the shuffles of one pass at a time.

Defined results: null and empty texts have no bytes; ids compare as numbers and
a null id is smaller than every other; rows that share an id never remove from
each other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.llm.common import key_runs, small_batches, table, text_key
from fleetpulse.llm.induced_sort import suffix_order
from fleetpulse.session import discard, materialize, ship

LENGTH = 50
GRAM = 20
HOT = 4_000
ANCHORS = 500_000
CHUNK_BYTES = 1 << 18
SLICE_BYTES = 1 << 18
TASK_CONTEXTS = 100_000
PASS_BYTES = 1 << 25
TEXT_PASSES = 2
CONTEXT_PASSES = 2
LEAST_ID = -(1 << 63)
NULL_ID = LEAST_ID + 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every GRAM-byte string; the last GRAM - 1 places are padding."""
    padded = np.concatenate((data, np.zeros(GRAM + 8, np.uint8)))

    def at(kind: str, shift: int) -> np.ndarray:
        return np.ndarray((len(data),), dtype=kind, buffer=padded.data, offset=shift, strides=(1,)).astype(np.uint64)

    h = at("<u8", 0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += at("<u8", 8)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += at("<u4", 16)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def contexts_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash) per context; windows count from the start of their text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    hashes = gram_hashes(data)
    # Hash above, place below: the least value names the leftmost gram of least hash.
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data), dtype=np.uint64)
    step, span = 1, low
    while 2 * step <= width:
        span = np.minimum(span[:-step], span[step:])
        step *= 2
    if step < width:
        span = np.minimum(span[: len(span) - (width - step)], span[width - step :])
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = (span[offsets[owner] + window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(anchor):
        return none, none, none, none
    opens = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    runs = np.diff(np.append(opens, len(anchor)))
    return owner[opens], window[opens], runs, hashes[anchor[opens]].view(np.int64)


def encoded(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Cuts (from, to) of ``texts`` at every SLICE_BYTES; a slice holds one text more at most."""
    if not len(texts):
        return []
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    opens = np.flatnonzero(np.diff(ends // SLICE_BYTES, prepend=-1))
    return list(zip(opens.tolist(), [*opens[1:].tolist(), len(texts)]))


def anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, n, packed) of the anchors of (ident, text), packed by bucket for the shuffle.

    An anchor that two texts of one batch have is known to be shared, so the
    batch sends those texts as a row of its own (in a bucket below 0) and only the
    hash onwards.  A hash in a third of all documents thus costs one entry per batch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2048):
            ids = batch.column("ident").to_numpy()
            owners, hashes = [], []
            texts = batch.column("text")
            for i, end in slices(texts):
                owner, _, _, h = contexts_of(encoded(texts.slice(i, end - i)), length)
                owners.append(ids[owner + i])
                hashes.append(h)
            doc, h = np.concatenate(owners), np.concatenate(hashes)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            doc, h = doc[new], h[new]
            opens = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            many = np.diff(np.append(opens, len(h))) > 1
            known = np.repeat(many, np.diff(np.append(opens, len(h))))
            out = [(-1 - int(ids[0]) % buckets, int(known.sum()), packed(h[known], doc[known]))] if known.any() else []
            h, doc = h[opens], np.where(many, LEAST_ID, doc[opens])
            deal = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            cuts = np.searchsorted(deal[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[k] : cuts[k + 1]]
                out.append((int(k), len(at), packed(h[at], doc[at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["bucket", "n", "packed"])

    return docs.mapInArrow(rows, "bucket long, n long, packed binary")


def packed(h: np.ndarray, doc: np.ndarray) -> bytes:
    """Hashes, then ids with their high halves apart, which compress well."""
    halves = doc.view(np.uint64)
    return h.tobytes() + halves.astype(np.uint32).tobytes() + (halves >> np.uint64(32)).astype(np.uint32).tobytes()


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.uint32, n, 12 * n)
    return np.frombuffer(data, np.int64, n), (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)


def shared_anchors(found: DataFrame, buckets: int) -> DataFrame:
    """(ident, h) of the anchors that two texts or more have.

    A bucket holds about ANCHORS entries, whatever the input's size.
    """

    def told(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h)], names=["ident", "h"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "bucket"):
            parts = []
            for bucket, n, data in zip(*(run.column(c).to_pylist() for c in ("bucket", "n", "packed"))):
                if bucket < 0:  # known to its batch
                    yield told(*unpacked(data, n))
                else:
                    parts.append(unpacked(data, n))
            if not parts:
                continue
            h, doc = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            opens = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sizes = np.diff(np.append(opens, len(h)))
            # LEAST_ID stands for texts that have been told of already.
            shared = np.repeat((doc[opens] != doc[opens + sizes - 1]), sizes) & (doc != LEAST_ID)
            yield told(h[shared], doc[shared])

    return found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(rows, "ident long, h long")


def shared_contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc, key, h, start, windows, bytes) of contexts whose anchor is in ``wanted`` (ident, doc, hs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, end - i) for b in batches for i, end in slices(b.column("text"))):
            texts = encoded(batch.column("text"))
            owner, start, runs, h = contexts_of(texts, length)
            lists = batch.column("hs")
            use = np.zeros(len(h), bool)
            edge = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                part = slice(edge[i], edge[i + 1])
                use[part] = np.isin(h[part], lists[i].values.to_numpy())
            owner, start, runs, h = owner[use], start[use], runs[use], h[use]
            held = [texts[o][s : s + n + length - 1] for o, s, n in zip(owner.tolist(), start.tolist(), runs.tolist())]
            taken = batch.select(["doc", "key"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(h), pa.array(start), pa.array(runs), pa.array(held, pa.binary())],
                names=["doc", "key", "h", "start", "windows", "bytes"],
            )

    joined = docs.join(wanted, ["ident", "doc"]).select("doc", "key", "text", "hs")
    return joined.mapInArrow(rows, "doc long, key long, h long, start long, windows long, bytes binary")


def earlier_windows(contexts: pa.Table, length: int) -> np.ndarray:
    """Bit i of a context's mask: its window i is in a context of a smaller id."""
    held = [bytes(b) for b in contexts.column("bytes").to_pylist()]
    ids = contexts.column("least").to_numpy()
    # UTF-8 has no byte above 244, so two codes are free below all others: 0 ends the text, 1 ends a context.
    sizes = np.array([len(b) for b in held], dtype=np.int64)
    data = np.frombuffer(b"".join(held), np.uint8) + np.uint8(2)
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.ones(int((sizes + 1).sum()) + 1, np.uint8)
    text[-1] = 0
    at = np.arange(len(data)) + np.repeat(np.arange(len(held)), sizes)
    text[at] = data
    owner = np.full(len(text), -1, np.int64)
    counts = sizes - length + 1
    starts = np.repeat(offsets, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    owner[starts] = np.repeat(np.arange(len(held)), counts)
    order, common = suffix_order(text, length)
    opens = np.flatnonzero(common < length)
    of = owner[order]
    value = np.where(of >= 0, ids[np.maximum(of, 0)], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(value, opens), np.diff(np.append(opens, len(order))))
    hit = (of >= 0) & (least < value)
    mask = np.zeros(len(held), np.int64)
    np.bitwise_or.at(mask, of[hit], np.int64(1) << (order[hit] - offsets[of[hit]]))
    return mask


def masks(distinct: DataFrame, parts: int, length: int) -> DataFrame:
    """(c1, c2, least, mask) of the contexts (deal, bytes, least, copied) that can remove something.

    These hold windows of earlier documents, the bits of ``mask``, or are in
    documents of several ids.  ``c1`` and ``c2`` are hashes of the bytes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(whole: pa.Table, mask: np.ndarray) -> list[pa.RecordBatch]:
            use = np.flatnonzero((mask != 0) | whole.column("copied").to_numpy())
            return whole.select(["c1", "c2", "least"]).append_column("mask", pa.array(mask)).take(pa.array(use)).combine_chunks().to_batches()

        def compared(chunk: list[pa.Table]) -> list[pa.RecordBatch]:
            whole = pa.concat_tables(chunk)
            return told(whole, earlier_windows(whole, length))

        chunk, size = [], 0
        for run in key_runs(batches, "deal"):
            # An anchor with one distinct context has nothing to compare.
            deal = run.column("deal").to_numpy()
            same = deal[1:] == deal[:-1]
            several = np.append(same, False) | np.append(False, same)
            single = run.drop_columns("bytes").filter(pa.array(~several))
            yield from told(single, np.zeros(single.num_rows, np.int64))
            run = run.filter(pa.array(several))
            if not run.num_rows:
                continue
            chunk.append(run)
            size += run.column("bytes").nbytes
            if size >= CHUNK_BYTES:
                yield from compared(chunk)
                chunk, size = [], 0
        if chunk:
            yield from compared(chunk)

    dealt = distinct.repartition(parts, "deal").sortWithinPartitions("deal").select("deal", "bytes", "least", "copied", *byte_names())
    return dealt.mapInArrow(rows, "c1 long, c2 long, least long, mask long")


def byte_names() -> list[Column]:
    return [F.xxhash64("bytes").alias("c1"), F.xxhash64(F.lit(1), "bytes").alias("c2")]


def classes(hashed: str, n: int) -> list[Column]:
    """``n`` conditions on a hash, of which every row meets one."""
    return [F.pmod(hashed, F.lit(n)) == i for i in range(n)]


def cut_texts(docs: DataFrame, length: int) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept) of rows (doc, text, starts, masks)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            found = batch.column("found")
            ends = np.where(found.is_valid().to_numpy(zero_copy_only=False), found.offsets.to_numpy()[1:], found.offsets.to_numpy()[:-1])
            starts, masks = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "mask"))
            for data, a, b in zip(encoded(batch.column("text")), found.offsets.to_numpy(), ends):
                n = len(data)
                if a == b or (starts[a] < 0 and n < length):
                    out.append((n, 0, 0, data))
                    continue
                if starts[a] < 0:
                    out.append((n, n, 1, b""))
                    continue
                bits = masks[a:b, None] >> np.arange(length - GRAM + 1) & 1
                mark, shift = np.nonzero(bits)
                where = starts[a:b][mark] + shift
                change = np.bincount(where, minlength=n + 1) - np.bincount(where + length, minlength=n + 1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] > gone[:-1])) + int(gone[0])
                out.append((n, int(np.count_nonzero(gone)), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text", "found").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def release(spark) -> None:
    """Let Spark drop the shuffle files of finished parts; they would pile up on disk beside the written tables."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) for every row."""
    spark = ship(docs.sparkSession)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    # The hash of a text; LEAST_ID is taken as a mark.
    ident = F.greatest(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(NULL_ID))
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), doc.alias("doc"), text_key(id_col, text_col).alias("key"), ident.alias("ident"), F.col(text_col).alias("text")
    )
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-2 * size // ((length - GRAM + 2) * ANCHORS)))
    first = materialize(named.groupBy("ident").agg(F.min("doc").alias("doc")), "first-texts")
    found = anchors(named.select("ident", "text"), length, buckets)
    wanted = shared_anchors(found, buckets).groupBy("ident").agg(F.collect_set("h").alias("hs"))
    wanted = materialize(wanted.join(first, "ident"), "wanted")
    release(spark)
    # Hashes of contexts do not compress: they are taken from the bytes where they are used, and not stored beside them.
    texts, contexts = named.select("ident", "doc", "key", "text"), []
    passes = -(-size // PASS_BYTES) or 1
    for of_pass in classes("ident", min(passes, TEXT_PASSES)):
        contexts.append(materialize(shared_contexts(texts.filter(of_pass), wanted.filter(of_pass), length), "contexts"))
        release(spark)
    discard(wanted)
    each = reduce(DataFrame.unionByName, contexts)
    hot = each.groupBy("h").agg(F.approx_count_distinct(F.xxhash64("bytes")).alias("n")).filter(F.col("n") > HOT)
    hot = materialize(hot.select("h"), "hot-anchors")
    cold = each.join(hot, "h", "left_anti").withColumn("deal", F.col("h"))
    single = (
        each.join(hot, "h", "left_semi")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)))
        .withColumn("bytes", F.substring(F.col("bytes"), F.col("i").cast("int") + 1, F.lit(length)))
        .withColumn("start", F.col("start") + F.col("i")).withColumn("windows", F.lit(1).cast("long")).drop("i")
        .withColumn("deal", F.xxhash64("bytes"))
    )
    columns = ["doc", "key", "start", "windows", "bytes", "deal"]
    every = cold.select(*columns).unionByName(single.select(*columns))
    all_bits = F.expr("shiftleft(1L, cast(windows AS int)) - 1")
    mask = F.when(F.col("doc") > F.col("least"), all_bits).otherwise(F.col("mask"))
    parts, marks = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    for of_pass in classes("deal", min(passes, CONTEXT_PASSES)):
        dealt = every.filter(of_pass)
        distinct = dealt.groupBy("deal", "bytes").agg(F.min("doc").alias("least"), (F.min("doc") < F.max("doc")).alias("copied"))
        distinct = materialize(distinct, "distinct-contexts")
        release(spark)
        # Written, so that the next join is a plain one, which adaptive execution can split at a context that many have.
        per_context = materialize(masks(distinct, max(parts, -(-distinct.count() // TASK_CONTEXTS)), length), "masks")
        discard(distinct)
        release(spark)
        placed = dealt.select("doc", "key", "start", "windows", *byte_names()).join(per_context, ["c1", "c2"])
        marks.append(materialize(placed.select("key", "start", mask.alias("mask")).filter("mask <> 0"), "marks-of-pass"))
        discard(per_context)
        release(spark)
    for written in contexts:
        discard(written)
    found = reduce(DataFrame.unionByName, marks).groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    copies = named.select("ident", "key", F.col("doc").alias("own")).join(first, "ident").filter(F.col("own") > F.col("doc"))
    # A copy goes whole: its mark is a start of -1.
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("mask")))
    found = materialize(found.unionByName(copies.select("key", whole.alias("found")).distinct()), "marks")
    for written in marks:
        discard(written)
    release(spark)
    return cut_texts(named.join(found, "key", "left"), length)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_earlier(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
