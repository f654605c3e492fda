"""Texts that share four fifths of their five-word shingles, exactly.

A text is the set of the hashes of its runs of ``SHINGLE`` words (all its words,
if they are fewer).  Two texts are linked if the Jaccard similarity of their
sets is at least NUM / DEN.  Texts with equal sets are one node.

Candidates by prefix: put every set in one global order.  Two linked sets have a
common element among the first n - ceil(0.8 n) + 1 elements of each, so these
are the keys of candidate buckets, and at the pair's first common element the
places leave room for the overlap that 0.8 needs.  Any order is right; this one
goes from rare to frequent by counts over the whole corpus (``frequency_levels``),
so that a passage of many texts is no key of theirs.

Pairs that are known to be near (``simhash.near_pairs``) are confirmed first.
Then each bucket links its members to its first one, unless they are joined
already; those links are confirmed too and joined to components.  Then all pairs
of different components are candidates, larger buckets in blocks, unless their parity maps differ in more
bits than linked sets can differ in elements.  Every candidate is confirmed by its
whole sets, so no link is lost and none is wrong (up to 64-bit hashes of words).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from fleetpulse.llm.common import byte_batches, key_runs, majority
from fleetpulse.llm.components import connected
from fleetpulse.llm.substring_dedup import release
from fleetpulse.session import discard, materialize, ship

SHINGLE, SEED = 5, 42
NUM, DEN = 4, 5
BUCKET = 512
#: Fewest and most slots of the frequencies, a byte each.
SLOTS = (1 << 20, 1 << 27)
#: Bits of the parity map of a set.
BITS = 512
#: Partners of a text that are compared with it in one group.
HELD = 256


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a whole text, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def prefix(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first elements in the global order, of which linked sets share one."""
    n = len(hashes)
    if n:
        order = np.argsort(levels[(hashes & np.uint64(len(levels) - 1)).astype(np.int64)], kind="stable")
        hashes = hashes[order]
    return hashes[: n + 1 - -(-NUM * n // DEN)] if n else hashes


def bitmap(hashes: np.ndarray) -> bytes:
    """``BITS`` bits, each the parity of the elements that fall on it.

    An element that only one of two sets has flips one bit, so the bitmaps of
    two sets differ in no more bits than the sets in elements.
    """
    return np.packbits(np.bincount(((hashes >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def near_maps(na: np.ndarray, nb: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be linked if they differ in at least ``apart`` elements: no link fails this."""
    return alike(na, nb, (na.astype(np.int64) + nb - apart) // 2)


def alike(na, nb, overlap):
    """Whether sets of these sizes with this overlap are linked."""
    return (NUM + DEN) * overlap >= NUM * (na + nb)


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """How common hashes are in the whole corpus: a power of two for each of a fixed number of slots.

    Tasks count all shingles of their texts by the slot of the hash, and Spark
    adds the counts up; a slot's level is the bit length of its count. There are
    about four slots for each document, within ``SLOTS``, a byte each, so what is
    collected and broadcast has a fixed bound.
    """
    n = docs.count()
    slots = min(max(1 << (4 * n).bit_length(), SLOTS[0]), SLOTS[1])
    width = min(slots, 1 << 12)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, dtype=np.uint32)
        for batch in byte_batches(batches):
            for text in batch.column(0).to_pylist():
                # Hashes of a text are distinct, their slots need not be.
                np.add.at(counts, (shingles(text) & np.uint64(slots - 1)).astype(np.int64), 1)
        for at in range(0, slots, width):
            block = counts[at : at + width]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names=["at", "counts"])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "at"):
            total: dict[int, np.ndarray] = {}
            for at, packed in zip(run.column("at").to_pylist(), run.column("counts").to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.int64)
            level = [np.frexp(t.astype(np.float64))[1].astype(np.uint8).tobytes() for t in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(level, pa.binary())], names=["at", "levels"])

    counted = docs.select("text").mapInArrow(rows, "at long, counts binary")
    added = counted.repartition("at").sortWithinPartitions("at").mapInArrow(levels, "at long, levels binary")
    out = np.zeros(slots, dtype=np.uint8)
    for row in added.collect():
        out[row.at : row.at + width] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out


def with_prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """Add the set's signature, size, parity map, prefix and fingerprint; row by row, no shuffle."""
    spark = ship(docs.sparkSession)
    held = spark.sparkContext.broadcast(levels)
    more = [T.StructField("sig", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("map", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches):
            sets = [shingles(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([prefix(s, held.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "sig", "n", "map", "prefix", "fp"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *more]))


def candidates(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the places leave room for enough overlap, if this is the first common element."""
    return alike(n[a], n[b], np.minimum(n[a] - place[a], n[b] - place[b]))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in key_runs(batches, "bucket"):
        keys, node, root, n, place, side = (run.column(c).to_numpy() for c in ("bucket", "node", "root", "n", "place", "side"))
        maps = np.frombuffer(b"".join(run.column("map").to_pylist()), dtype=np.uint64).reshape(len(keys), BITS // 64)
        edge = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        alive = np.arange(len(keys))
        end = edge[np.searchsorted(edge, alive)]
        step = 1
        while len(alive):
            alive = alive[end[alive] >= alive + step]
            a, b = alive, alive + step
            use = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 2)) & candidates(n, place, a, b)
            a, b = a[use], b[use]
            close = near_maps(n[a], n[b], np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1).astype(np.int64))
            x, y = node[a[close]], node[b[close]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])
            step += 1


def in_buckets(keyed: DataFrame, *keys: str) -> DataFrame:
    """Candidate pairs of the rows (keys, node, root, n, place, map, side) that share their keys."""
    rows = keyed.select(F.xxhash64(*keys).alias("bucket"), "node", "root", "n", "place", "map", "side")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_pairs, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs of rows (a, b) of ``texts`` that are linked.

    Pairs are dealt by their smaller row in groups of about ``HELD`` partners.
    Its text travels once to each group, the others once for each pair; texts
    compress, sets of hashes do not, so sets are made where they are compared.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / HELD).alias("parts"))
    dealt = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    dealt = materialize(dealt, "dealt-pairs")
    text = texts.select("row", "text")
    partners = dealt.join(text, dealt["a"] == text["row"]).select("b", "part", F.lit(1).alias("kind"), "row", "text")
    firsts = dealt.select("b", "part").distinct().join(text, F.col("b") == text["row"]).select("b", "part", F.lit(0).alias("kind"), "row", "text")
    both = firsts.unionByName(partners).repartition("b", "part").sortWithinPartitions("b", "part", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, np.zeros(0, dtype=np.uint64)
        for batch in byte_batches(batches):
            out = []
            for b, kind, row, words in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                mine = shingles(words)
                if kind == 0:
                    first, held = b, mine
                elif alike(len(held), len(mine), len(np.intersect1d(held, mine, assume_unique=True))):
                    out.append((row, first))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = materialize(both.mapInArrow(check, "a long, b long"), "links")
    discard(dealt)
    release(pairs.sparkSession)
    return links


def packed(nodes: DataFrame, buckets: int) -> DataFrame:
    """Prefixes for the shuffle: the elements of many texts that fall into one bucket as one row of packed columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            key = lists.flatten().to_numpy()
            if not len(key):
                continue
            text = np.repeat(np.arange(len(sizes)), sizes)
            place = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            node, n = batch.column(0).to_numpy()[text], batch.column(1).to_numpy()[text].astype(np.int32)
            bucket = (key.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, cuts)
            columns = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (node, n, place, key)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), *columns], names=["bucket", "node", "n", "place", "key"])

    return nodes.select("row", "n", "prefix").mapInArrow(rows, "bucket long, node binary, n binary, place binary, key binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (np.int64, np.int32, np.int32, np.int64)
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=k)) for x, k in zip(row, kinds)], names=["node", "n", "place", "key"])


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(node, n, place, key, first, first_n, first_place) of keys with several nodes; ``first`` is the smallest of them."""
    buckets = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed(nodes, buckets).repartition("bucket").mapInArrow(unpacked, "node long, n int, place int, key long")
    kind = "node long, n int, place int, key long, first long, first_n int, first_place int"
    return materialize(rows.sortWithinPartitions("key", "node").mapInArrow(_shared, kind), "shared-keys")


def groups(printed: DataFrame, near: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """(sig, root) of the table ``printed`` of (row, text, sig, n, prefix): equal roots are joined by links.

    ``near`` are pairs (a > b) of first rows of their ``sig`` to confirm before
    any other, a written table; it is deleted.
    """
    spark = printed.sparkSession
    if near is None:
        near = materialize(spark.createDataFrame([], "a long, b long"), "near-pairs")
    close = confirmed(near, printed)
    joined = connected(close)
    nodes = materialize(printed.groupBy("sig").agg(F.min("row").alias("row")), "nodes")
    keyed = shared_keys(printed.select("row", "n", "prefix").join(nodes.select("row"), "row", "left_semi"))
    release(spark)
    room = F.least(F.col("n") - F.col("place"), F.col("first_n") - F.col("first_place"))
    stars = keyed.filter((F.col("node") > F.col("first")) & alike(F.col("n"), F.col("first_n"), room))
    stars = stars.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    ends = [joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    apart = ~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b"))
    stars = stars.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(apart).select("a", "b")
    stars = materialize(stars.join(near, ["a", "b"], "left_anti"), "candidates")
    stars_confirmed = confirmed(stars, printed)
    links = close.unionByName(stars_confirmed)
    roots = connected(links)
    rooted = keyed.select("key", "node", "n", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    mixed = materialize(mixed.select("key", F.ceil(F.col("size") / bucket).cast("int").alias("blocks")), "open-buckets")
    maps = printed.select(F.col("row").alias("node"), "map")
    opened = rooted.join(mixed, "key").join(maps, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = opened.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "root", "n", "place", "map", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    rest = materialize(in_buckets(cut, "key", "low", "high").distinct().join(stars.unionByName(near), ["a", "b"], "left_anti"), "candidates")
    for done in (keyed, mixed, stars, near, joined, roots):
        discard(done)
    release(spark)
    more = confirmed(rest, printed)
    final = connected(links.unionByName(more))
    for done in (rest, close, stars_confirmed, more):
        discard(done)
    found = nodes.join(final.select(F.col("node").alias("row"), "root"), "row", "left")
    return found.select("sig", F.coalesce("root", "row").alias("root"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key, of a partition sorted by key and node, has another row, with the key's first row; no key is held."""
    head = None  # (key, node, n, place) of the current key's first row, which waits for a second one unless it is out
    out = False
    names = ["node", "n", "place", "key", "first", "first_n", "first_place"]
    for batch in batches:
        if not batch.num_rows:
            continue
        node, n, place, key = (batch.column(i).to_numpy() for i in range(4))
        starts = np.append(True, key[1:] != key[:-1])
        goes_on = head is not None and head[0] == key[0]
        starts[0] = not goes_on
        run = np.cumsum(starts)  # 0: rows of the key that was open before
        size = np.bincount(run, minlength=run[-1] + 1)
        at = np.flatnonzero(starts)
        old = head if goes_on else (key[0], 0, 0, 0)
        firsts = [np.concatenate([[o], x[at]])[run] for o, x in zip(old[1:], (node, n, place))]
        waits = None
        if goes_on and not out:
            waits = [[head[1]], [head[2]], [head[3]], [head[0]], [head[1]], [head[2]], [head[3]]]
        keep = (size[run] > 1) | (run == 0)
        columns = [x[keep] for x in (node, n, place, key, *firsts)]
        if waits:
            columns = [np.concatenate([w, c]) for w, c in zip(waits, columns)]
        if len(columns[0]):
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=names)
        if run[-1] > 0:
            i = at[-1]
            head, out = (key[i], node[i], n[i], place[i]), size[run[-1]] > 1
        else:
            out = True
