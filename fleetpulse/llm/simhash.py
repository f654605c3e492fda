"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has one bit per position that is set in over half of the shingle
hashes.  Fingerprints at up to ``MAX_BITS`` differing bits are linked, and links
make groups.

Pigeonring: lay the 64 bits out as a ring of 16 segments.  If two fingerprints
differ in at most 3 bits, then some segment starts a chain in which, for every
length l, the first l segments together differ in at most l * 3 / 16 bits.  The
budget is zero up to l = 5, so the pair agrees on five consecutive segments:
those 20 bits are the key of a candidate bucket.  Inside a bucket the chain goes
on to l = 10 (one bit) and l = 15 (two bits); only pairs within both budgets get
the full Hamming check.  Equal fingerprints are one node, so copies cost nothing.

A bucket with more than ``BUCKET`` fingerprints is keyed again: the 44 bits
outside the key are cut into four parts of 11, one of which must agree too.
What is still too large after that is cut into blocks, and every pair of blocks
is a task of its own.  No bucket is emitted as all its pairs: a task returns the
links of a spanning forest, which join the same nodes.

Defined results: a null text, or one without words, has fingerprint zero and is
linked like any other; repeated rows share a group; a null id is smaller than
every other id and makes its group's id null only if it is alone; an empty
table gives an empty table; other columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from fleetpulse.llm import jaccard
from fleetpulse.llm.common import DOCUMENT_COLUMNS, key_runs, majority, small_batches, table
from fleetpulse.llm.components import connected
from fleetpulse.llm.substring_dedup import release
from fleetpulse.session import discard, materialize, ship

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS, SEGMENT_BITS, CHAIN = 16, 4, 5
PARTS, PART_BITS = 4, 11
BUCKET = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a whole text."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long; row by row, no shuffle."""
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, name])

    return docs.mapInArrow(rows, schema)


def ring_mask(start: int, length: int) -> int:
    """Bits of ``length`` segments from segment ``start``, around the ring."""
    mask = 0
    for i in range(length):
        mask |= ((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * ((start + i) % SEGMENTS))
    return mask


def budget_ends() -> list[tuple[int, int]]:
    """(length, bits): the last chain length of each proportional budget short of the whole ring."""
    allowed = [length * MAX_BITS // SEGMENTS for length in range(SEGMENTS + 1)]
    return [(n, allowed[n]) for n in range(CHAIN + 1, SEGMENTS) if allowed[n + 1] > allowed[n]]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def rotated(fp: Column, by: int) -> Column:
    """Rotate right by ``by`` bits."""
    if by == 0:
        return fp
    return F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by))


def forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest (node, smallest index of its tree) of the graph a-b over indices."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def linked_pairs(keys: np.ndarray, prints: np.ndarray, starts: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs in equal-key runs that pass the chain budgets and then the Hamming check.

    ``starts`` is the segment at which the chain of each row's key begins.
    ``side`` (blocks): only pairs from different sides, unless a row has side 2.
    """
    n = len(keys)
    edge = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
    end = edge[np.searchsorted(edge, np.arange(n))]
    masks = [(np.array([ring_mask(s, length) for s in range(SEGMENTS)], dtype=np.uint64), bits) for length, bits in budget_ends()]
    found_a, found_b = [], []
    alive = np.arange(n)
    step = 1
    while True:
        alive = alive[end[alive] >= alive + step]
        if not len(alive):
            break
        a, b = alive, alive + step
        if side is not None:
            use = (side[a] != side[b]) | (side[a] == 2)
            a, b = a[use], b[use]
        diff = prints[a] ^ prints[b]
        ok = np.ones(len(a), dtype=bool)
        for mask, bits in masks:
            ok &= np.bitwise_count(diff & mask[starts[a]]) <= bits
        a, b = a[ok], b[ok]
        close = np.bitwise_count(diff[ok]) <= MAX_BITS
        found_a.append(a[close])
        found_b.append(b[close])
        step += 1
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


LINKS = "a long, b long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in key_runs(batches, "bucket"):
        keys = run.column("bucket").to_numpy()
        prints = run.column("fp").to_numpy().view(np.uint64)
        starts = run.column("start").to_numpy().astype(np.int64)
        side = run.column("side").to_numpy()
        a, b = linked_pairs(keys, prints, starts, None if (side == 2).all() else side)
        if len(a):
            x, y = forest(prints.view(np.int64), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def in_buckets(keyed: DataFrame, *keys: str) -> DataFrame:
    """Links of the rows (keys, fp, start, side) that share their keys."""
    rows = keyed.select(F.xxhash64(*keys).alias("bucket"), "fp", "start", "side")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links, LINKS)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` whenever they are within MAX_BITS.

    Keys that hash alike merely share a bucket; every pair is checked in full.
    """
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(s).alias("start"), rotated(fp, s * SEGMENT_BITS).alias("turned")) for s in range(SEGMENTS)])
    chain = (1 << (CHAIN * SEGMENT_BITS)) - 1
    first = prints.select("fp", F.explode(keys).alias("k")).select(
        "fp", F.col("k.start").alias("start"), F.col("k.turned").bitwiseAND(F.lit(chain)).alias("key"),
        F.shiftrightunsigned(F.col("k.turned"), CHAIN * SEGMENT_BITS).alias("rest"),
    )
    sizes = first.groupBy("start", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
    sizes = materialize(sizes.drop("n"), "full-buckets")
    light = first.join(sizes, ["start", "key"], "left_anti").withColumn("side", F.lit(2))
    one = in_buckets(light, "start", "key")
    parts = F.array(*[
        F.struct(F.lit(p).alias("part"), F.shiftrightunsigned(F.col("rest"), p * PART_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("bits"))
        for p in range(PARTS)
    ])
    second = first.join(sizes, ["start", "key"], "left_semi").select("fp", "start", "key", F.explode(parts).alias("p")).select("fp", "start", "key", "p.*")
    inner = second.groupBy("start", "key", "part", "bits").agg(F.count("*").alias("n"))
    inner = materialize(inner.filter(F.col("n") > bucket), "full-parts")
    by = ["start", "key", "part", "bits"]
    two = in_buckets(second.join(inner, by, "left_anti").withColumn("side", F.lit(2)), *by)
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    cut = second.join(inner, by).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *by, "fp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    three = in_buckets(pairs, *by, "low", "high")
    return one.unionByName(two).unionByName(three).distinct()


def groups(docs: DataFrame, id_col: str, fp_col: str = "fp") -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``docs``; component_id is the smallest id of the group."""
    per_print = materialize(docs.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "prints")
    joined = materialize(links(per_print.select("fp")), "links")
    roots = connected(joined)
    rooted = per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def near_pairs(printed: DataFrame) -> DataFrame:
    """Pairs of rows (a > b) of ``printed`` (row, sig, fp) that the fingerprints bring together.

    Of texts with one fingerprint each goes with the first; different
    fingerprints come as ``links`` finds them by pigeonring. A row is the first
    of its ``sig``.
    """
    nodes = materialize(printed.groupBy("sig").agg(F.min("row").alias("row"), F.first("fp").alias("fp")).select("row", "fp"), "printed-nodes")
    prints = materialize(nodes.groupBy("fp").agg(F.min("row").alias("first")), "prints")
    found = links(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(c), F.col("first").alias(f"row_{c}")) for c in ("a", "b")]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.greatest("row_a", "row_b").alias("a"), F.least("row_a", "row_b").alias("b"))
    same = nodes.join(prints, "fp").filter(F.col("row") > F.col("first")).select(F.col("row").alias("a"), F.col("first").alias("b"))
    pairs = materialize(across.unionByName(same).distinct(), "near-pairs")
    for done in (nodes, prints):
        discard(done)
    release(printed.sparkSession)
    return pairs


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, and of rows that share it the first written.

    Rows that agree in id and text are one document; of their other columns the
    smallest by (lang, source, n_chars) stay. Texts are linked by the similarity
    of ``jaccard``: fingerprints of five-word shingles find pairs by pigeonring,
    which are confirmed by their whole sets, and prefixes find the links that
    lie beyond MAX_BITS. The shingles and links of op4 are those of its contract.
    Intermediate tables are deleted before the stage returns; the result reads
    ``docs``.
    """
    documents = docs.select(*DOCUMENT_COLUMNS)
    printed = jaccard.with_prefixes(documents, jaccard.frequency_levels(documents)).withColumn("row", F.monotonically_increasing_id())
    printed = materialize(printed.withColumn("text_id", F.md5("text")), "prefixes")  # pins the row numbers
    grouped = printed.select("doc_id", "row", "text_id", "sig").join(jaccard.groups(printed, near_pairs(printed)), "sig")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row"), F.col("text_id"))
    first = grouped.groupBy("root").agg(F.min(order).alias("keep"))
    kept = materialize(first.select(F.col("keep.doc_id").alias("kept_id"), F.col("keep.text_id").alias("kept_text")), "kept")
    discard(printed)
    release(spark)
    named = documents.withColumn("text_id", F.md5("text"))
    stays = named.join(kept, named["doc_id"].eqNullSafe(kept["kept_id"]) & named["text_id"].eqNullSafe(kept["kept_text"]), "left_semi")
    copies = W.partitionBy("doc_id", "text_id").orderBy("lang", "source", "n_chars")
    return stays.withColumn("copy", F.row_number().over(copies)).filter("copy = 1").select(*DOCUMENT_COLUMNS)


def op4_simhash_groups(spark, sf_dir: str) -> DataFrame:
    docs = with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    printed = materialize(docs, "fingerprints")
    named = printed.join(groups(printed, "doc_id"), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
