"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than ASCII white space; null text: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def text_key(id_col: str, text_col: str) -> Column:
    """Separates rows that share an id but not a text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a Python worker holds few long texts at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def byte_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches at ``rows`` rows and at about ``limit`` bytes; a longer row is a batch of its own."""
    for batch in small_batches(batches, rows):
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        todo = [batch.slice(i, step) for i in range(0, batch.num_rows, step)]
        while todo:
            piece = todo.pop(0)
            if piece.num_rows > 1 and piece.nbytes > 2 * limit:
                half = piece.num_rows // 2
                todo[:0] = [piece.slice(0, half), piece.slice(half)]
            else:
                yield piece


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is set if over half of the hashes have it; none: zero."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Re-cut batches of a partition sorted by ``key`` so that no key is split.

    The rows of one key must be few enough to hold; the callers bound them.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = values[-1]
        cut = int((values != last).nonzero()[0][-1] + 1) if (values != last).any() else 0
        starts_new = bool(held) and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != values[0]
        if starts_new:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
