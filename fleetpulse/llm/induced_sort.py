"""External induced sorting of suffixes with common-prefix values.

Suffixes are of type S if they are smaller than the next one, else L.  The
leftmost S suffix of every run (LMS) is a seed.  From sorted seeds all L suffixes
follow by one pass over the characters upwards, and from those all S suffixes by
one pass downwards: whenever a suffix is taken in order, the one before it joins
the queue of its first character.  A queue thus receives its suffixes in order,
so the priority queue of (character, rank of the rest, position) is a row of
first-in first-out queues by character.  They are kept on disk beyond a budget.

Every queued tuple carries its common prefix with the tuple queued before it:
one more than the least value among the suffixes taken between their sources.
Values stop at ``cap`` and so does the order: suffixes that agree in ``cap``
characters may come in any order.  Whole batches of a queue are handled at once.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Queues:
    """First-in first-out queues of (position, common prefix) by character, on disk beyond ``budget`` tuples."""

    def __init__(self, characters: int, budget: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(characters)]
        self.stored: list[list[tuple[int, int]]] = [[] for _ in range(characters)]
        self.size, self.budget, self.file = 0, budget, None

    def put(self, c: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.held[c].append((positions, common))
        self.size += len(positions)
        if self.size > self.budget:
            self.spill()

    def spill(self) -> None:
        """Move all that is held to the end of an unlinked file of this task."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for c, chunks in enumerate(self.held):
            if chunks:
                positions = np.concatenate([p for p, _ in chunks])
                self.stored[c].append((self.file.tell(), len(positions)))
                self.file.write(positions.astype(np.int64).tobytes())
                self.file.write(np.concatenate([v for _, v in chunks]).tobytes())
                self.held[c] = []
        self.size = 0

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        chunks = []
        for at, n in self.stored[c]:
            self.file.seek(at)
            chunks.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)))
        chunks += self.held[c]
        self.size -= sum(len(p) for p, _ in self.held[c])
        self.held[c], self.stored[c] = [], []
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in chunks]), np.concatenate([v for _, v in chunks])


class LeastBetween:
    """Least of values[a..b], for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.uint8)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << int(k)) + 1])
        return out


def words_at(padded: np.ndarray, positions: np.ndarray, word: int) -> np.ndarray:
    """Eight characters from ``positions`` on, as one number that sorts alike."""
    view = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
    return view[positions + 8 * word].astype(np.uint64)


def common_prefix(padded: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    out = np.zeros(len(a), np.uint8)
    going = np.arange(len(a))
    for word in range(-(-cap // 8)):
        diff = words_at(padded, a[going], word) ^ words_at(padded, b[going], word)
        equal = diff == 0
        top = np.zeros(len(diff), np.int64)
        rest = diff.copy()
        for shift in (32, 16, 8):
            high = rest >> np.uint64(shift) != 0
            top[~high] += shift // 8
            rest = np.where(high, rest >> np.uint64(shift), rest)
        out[going] += np.where(equal, 8, top).astype(np.uint8)
        going = going[equal]
    return np.minimum(out, cap).astype(np.uint8)


def suffix_order(text: np.ndarray, cap: int, budget: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order, common prefix with the one before) of all suffixes of ``text``.

    ``text`` is an array of uint8 whose last character, 0, occurs nowhere else.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(cap + 16, np.uint8)))
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    run_end = np.repeat(change, np.diff(change, prepend=-1))
    is_s = padded[run_end] < padded[np.minimum(run_end + 1, n - 1)]
    is_s[n - 1] = True
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    keys = [words_at(padded, seeds, w) for w in range(-(-cap // 8))]
    seeds = seeds[np.lexsort(keys[::-1])]
    seed_common = np.zeros(len(seeds), np.uint8)
    seed_common[1:] = common_prefix(padded, seeds[:-1], seeds[1:], cap)
    bounds = np.searchsorted(text[seeds], np.arange(257))
    size = 256
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def one(a: int, b: int) -> int:
        return int(common_prefix(padded, np.array([a]), np.array([b]), cap)[0])

    def induce(queues: Queues, carry: np.ndarray, positions: np.ndarray, common: np.ndarray, want_s: bool) -> None:
        """Queue the suffix before each of ``positions`` if it is of the wanted type."""
        least = int(common.min())
        at = np.flatnonzero(positions > 0)
        at = at[is_s[positions[at] - 1] == want_s]
        before = positions[at] - 1
        first = text[before]
        order = np.argsort(first, kind="stable")
        at, before, first = at[order], before[order], first[order]
        new = np.empty(len(at), np.uint8)
        if len(at):
            opens = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            closes = np.append(opens[1:], len(first))
            table = LeastBetween(common)
            inner = np.ones(len(at), bool)
            inner[opens] = False
            inside = np.flatnonzero(inner)
            new[inside] = np.minimum(table.of(at[inside - 1] + 1, at[inside]).astype(np.int64) + 1, cap)
            heads = np.minimum(carry[first[opens]], table.of(np.zeros(len(opens), np.int64), at[opens]).astype(np.int64))
            new[opens] = np.where(heads < 0, 0, np.minimum(heads + 1, cap))
        known = carry >= 0
        carry[known] = np.minimum(carry[known], least)
        if len(at):
            last = at[closes - 1]
            tail = np.full(len(last), cap, np.int64)
            more = last + 1 < len(common)
            if more.any():
                tail[more] = table.of(last[more] + 1, np.full(more.sum(), len(common) - 1))
            carry[first[opens]] = tail
            for o, e in zip(opens, closes):
                queues.put(int(first[o]), before[o:e], new[o:e])

    # carry[c]: least common prefix taken since the last tuple joined queue c; -1 if none has.
    lower, carry = Queues(size, budget), np.full(size, -1, np.int64)
    l_part = [empty] * size
    for c in range(size):
        got = []
        positions, common = lower.take(c)
        while len(positions):
            got.append((positions, common))
            induce(lower, carry, positions, common, False)
            positions, common = lower.take(c)
        if got:
            l_part[c] = np.concatenate([p for p, _ in got]), np.concatenate([v for _, v in got])
        s, v = seeds[bounds[c] : bounds[c + 1]], seed_common[bounds[c] : bounds[c + 1]].copy()
        if len(s):
            v[0] = one(int(l_part[c][0][-1]), int(s[0])) if got else 0
            induce(lower, carry, s, v, False)
    upper, carry = Queues(size, budget), np.full(size, -1, np.int64)
    s_part = [empty] * size
    for c in range(size - 1, -1, -1):
        got = []
        positions, common = upper.take(c)
        while len(positions):
            got.append((positions, common))
            induce(upper, carry, positions, common, True)
            positions, common = upper.take(c)
        if got:
            s_part[c] = np.concatenate([p for p, _ in got]), np.concatenate([v for _, v in got])
        positions, common = l_part[c]
        if len(positions):
            down = np.empty(len(common), np.uint8)
            down[1:] = common[:0:-1]
            down[0] = one(int(s_part[c][0][-1]), int(positions[-1])) if got else 0
            induce(upper, carry, positions[::-1], down, True)
    s_part[0] = np.array([n - 1]), np.zeros(1, np.uint8)
    orders, commons = [], []
    for c in range(size):
        if len(l_part[c][0]):
            orders.append(l_part[c][0])
            commons.append(l_part[c][1].copy())
            commons[-1][0] = 0
        positions, down = s_part[c]
        if len(positions):
            up = np.empty(len(down), np.uint8)
            up[1:] = down[:0:-1]
            up[0] = one(int(orders[-1][-1]), int(positions[-1])) if len(l_part[c][0]) else 0
            orders.append(positions[::-1])
            commons.append(up)
    return np.concatenate(orders), np.concatenate(commons)
