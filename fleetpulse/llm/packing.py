"""Sum-of-squares online packing of tokenised documents.

A document is its token ids and one end id.  Whole windows are cut off first;
the remainder is placed by the sum-of-squares rule: of all fill levels at which
it fits, and of a fresh window, it goes where the sum over levels of the squared
number of partly filled windows grows least.  An array holds the number of open
windows per level, so a placement is a few array operations.

Each task packs the documents it reads; nothing is shuffled, and window numbers
carry the task's number.  At the end of a task its open windows (few: the rule
keeps their number low) are cut up once more: their pieces are laid end to end
over full windows, and what is left over goes to windows whose lengths are
powers of two, so that nothing is padded.

Defined results: a null or empty text is one piece of the end id; a null id is
kept; repeated rows are packed as documents of their own; a document longer
than a window has several pieces; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetpulse.llm.common import small_batches, table
from fleetpulse.session import ship

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TASK_BITS = 33


class Tokens:
    """Ids of the ``tokenizers`` vocabulary, through its rank file.

    Ranks are the same ids several times faster.  Texts that may name a special
    token go through ``tokenizers`` itself.
    """

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return self.ranks.encode_ordinary(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def tokens(name: str = VOCABULARY) -> Tokens:
    """One per worker process, since loading takes a while."""
    return Tokens(name)


class Packer:
    """Open windows by fill level.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.sequences = 0

    def level_for(self, size: int) -> int:
        """Fill level to place ``size`` at; 0 opens a window.  Ties go to the fullest level."""
        count, w = self.count, self.window
        levels = w - size
        if levels < 1:
            return 0
        here, there = count[1 : levels + 1], count[1 + size : w + 1]
        # count[w] stays 0: a window that is full is no longer open.
        grows = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if here[-1] > 0:
            grows[-1] = 1 - 2 * here[-1]
        best = len(grows) - 1 - int(np.argmin(grows[::-1]))
        return best + 1 if grows[best] <= 2 * count[size] + 1 else 0

    def place(self, piece: tuple) -> list | None:
        """Put a piece of less than a window; returns the window if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        held = []
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        self.open.setdefault(level + size, []).append(held)
        self.count[level + size] += 1
        return None

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        """Full windows that a document completes."""
        w, n = self.window, len(ids)
        for start in range(0, n - n % w, w):
            yield [(doc_id, start, ids[start : start + w], n)]
        if n % w:
            filled = self.place((doc_id, n - n % w, ids[n - n % w :], n))
            if filled:
                yield filled

    def rest(self) -> Iterator[list]:
        """Windows for what is still open: full ones, then powers of two."""
        pieces = [piece for level in sorted(self.open, reverse=True) for held in self.open[level] for piece in held]
        left = sum(len(p[2]) for p in pieces)
        room = 0
        held: list = []
        for doc_id, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if room == 0:
                    if held:
                        yield held
                    held, room = [], self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, len(ids) - at)
                held.append((doc_id, start + at, ids[at : at + take], total))
                at, room = at + take, room - take
        if held:
            yield held


def piece_batch(windows: list[list], first: int) -> pa.RecordBatch:
    rows = []
    for i, held in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in held:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, first + i, offset))
            offset += len(ids)
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in their windows."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokens().encode, Packer(window)
        number = TaskContext.get().partitionId() << TASK_BITS
        full: list[list] = []
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full += packer.add(doc_id, np.array([*encode(text or ""), END_ID], dtype="<u4"))
                if len(full) >= 1000:
                    yield piece_batch(full, number)
                    number += len(full)
                    full = []
        full += packer.rest()
        if full:
            yield piece_batch(full, number)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(rows, PIECES)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
