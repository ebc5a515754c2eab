"""Collision counting over sorted single projections, within the vectors of one group.

Every vector is projected on a number of random lines. For each line the projections are kept sorted; a query opens a window
centred on its own projection and every vector inside collides with it on that line. Vectors that collide on enough lines are
verified by their cosine. Windows grow level by level (virtual rehashing: a wider window of the same arrays, nothing is
hashed again) until a query has enough verified neighbours at the level's distance.

Windows are bit sets: prefix sets of each sorted array are kept at steps of a few places, the window is the difference of two
of them, and the collisions of 64 vectors at once are added by bit-sliced counters.
"""

from __future__ import annotations

import numpy as np

from memlake.llm.cells import unit

#: Lines, collisions that make a candidate, and half the window's width as a multiple of the level's distance. A vector at the level's distance
#: collides on a line with probability 0.91, and on 54 of 64 lines with 0.98; one at a right angle, at the level 0.7, with 0.65 and 0.001.
LINES, THRESHOLD, WIDTH = 64, 54, 1.7
#: Cosines whose distances are the levels.
LEVELS = (0.9, 0.7, 0.4, 0.0, -1.0)
#: Queries whose windows are counted at once, and those whose candidates are verified at once.
QUERIES, TILE = 512, 64
#: Prefix sets of a sorted array.
MARKS = 256


def _lines(n: int) -> np.ndarray:
    return np.random.default_rng(1_000 + n).standard_normal((n, LINES)).astype(np.float32)


class Counter:
    """Numbers of sets that hold each place, in bit-sliced form: three planes of a power make one of it and one of the next."""

    def __init__(self, shape: tuple[int, int]):
        self.shape = shape
        self.waiting: list[list[np.ndarray]] = [[]]

    def add(self, bits: np.ndarray, power: int = 0) -> None:
        if power == len(self.waiting):
            self.waiting.append([])
        own = self.waiting[power]
        own.append(bits)
        if len(own) == 3:
            a, b, c = own
            odd = a ^ b
            carry = (a & b) | (odd & c)
            odd ^= c
            self.waiting[power] = [odd]
            self.add(carry, power + 1)

    def at_least(self, threshold: int) -> np.ndarray:
        """The places that `threshold` sets or more hold."""
        power = 0
        while power < len(self.waiting):
            if len(self.waiting[power]) == 2:
                a, b = self.waiting[power]
                self.waiting[power] = [a ^ b]
                self.add(a & b, power + 1)
            power += 1
        zero = np.zeros(self.shape, np.uint64)
        planes = [own[0] if own else zero for own in self.waiting] + [zero] * (threshold.bit_length() - len(self.waiting))
        above, equal = zero.copy(), ~zero
        for p in reversed(range(len(planes))):  # compared from the highest bit down
            if (threshold >> p) & 1:
                equal &= planes[p]
            else:
                above |= equal & planes[p]
                equal &= ~planes[p]
        return above | equal


class Windows:
    """Sorted projections of a group's vectors with prefix bit sets."""

    def __init__(self, units: np.ndarray):
        self.n, self.step = len(units), max(16, -(-len(units) // MARKS))
        self.words = (self.n + 63) // 64
        self.projected = units @ _lines(units.shape[1])
        self.values, self.prefix = [], []
        place = np.arange(self.n) // self.step + 1
        sets = np.zeros((-(-self.n // self.step) + 1, self.words * 64), bool)
        for i in range(LINES):
            order = np.argsort(self.projected[:, i], kind="stable")
            self.values.append(self.projected[order, i])
            sets[:] = False
            sets[place, order] = True
            packed = np.packbits(sets, axis=1, bitorder="little").view(np.uint64)
            self.prefix.append(np.bitwise_xor.accumulate(packed, axis=0))

    def candidates(self, projected: np.ndarray, half: float) -> np.ndarray:
        """A bit set for each query: the vectors that collide with it on THRESHOLD lines or more."""
        counter = Counter((len(projected), self.words))
        for i in range(LINES):
            # a window is widened to whole steps, so it never loses a vector
            low = np.searchsorted(self.values[i], projected[:, i] - half, "left") // self.step
            high = -(-np.searchsorted(self.values[i], projected[:, i] + half, "right") // self.step)
            bits = self.prefix[i][high]
            bits ^= self.prefix[i][low]
            counter.add(bits)
        return counter.at_least(THRESHOLD)


def pairs_of(bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the set bits."""
    row, word = np.nonzero(bits)
    inner = np.unpackbits(bits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(inner)
    row, column = row[at], word[at] * 64 + bit
    keep = column < n
    return row[keep], column[keep]


def top_neighbours(ids: np.ndarray, raw: np.ndarray, other_ids: np.ndarray, other_raw: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, cosine) of the k most similar other vectors of each of `ids`; equal cosines go by the smaller id.

    Cosines are rounded to 9 decimals; those below `least` don't count.
    """
    wide, other_wide = unit(raw), unit(other_raw)
    u, v = wide.astype(np.float32), other_wide.astype(np.float32)
    windows = Windows(v)
    projected = u @ _lines(u.shape[1])
    levels = [c for c in LEVELS if c > least] + [least]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = np.argsort(projected[:, 0], kind="stable")  # queries near to each other share candidates
    for level in levels:
        half = WIDTH * np.sqrt(max(0.0, 2 - 2 * level)) if level > -0.5 else np.inf
        again = []
        for start in range(0, len(left), QUERIES):
            rows = left[start : start + QUERIES]
            row, column = _verify(rows, windows.candidates(projected[rows], half), u, v, ids, other_ids, k, least)
            cos = np.round(np.einsum("ij,ij->i", wide[row], other_wide[column]), 9)
            keep = cos >= least
            row, column, cos = row[keep], column[keep], cos[keep]
            order = np.lexsort((other_ids[column], -cos, row))
            row, column, cos = row[order], column[order], cos[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            if level > levels[-1]:
                enough = np.bincount(row[keep & (cos >= level)], minlength=len(ids)) >= k
                again.append(rows[~enough[rows]])
                keep &= enough[row]
            out.append((ids[row[keep]], other_ids[column[keep]], cos[keep]))
        left = np.concatenate(again) if again else left[:0]
        if not len(left):
            break
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _verify(rows: np.ndarray, bits: np.ndarray, u: np.ndarray, v: np.ndarray, ids: np.ndarray, other_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the candidates in `bits` that may be among the k best of their row, in single precision.

    A tile of queries is multiplied with the vectors that are a candidate of one of them.
    """
    slack = 2e-6
    found = []
    for at in range(0, len(rows), TILE):
        own, part = rows[at : at + TILE], bits[at : at + TILE]
        column = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(part, axis=0).view(np.uint8), bitorder="little")[: len(v)])
        if not len(column):
            continue
        score = u[own] @ v[column].T
        score[~np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")[:, column].view(bool)] = -2
        score[ids[own][:, None] == other_ids[column][None, :]] = -2
        floor = np.partition(score, len(column) - k, axis=1)[:, len(column) - k, None] if len(column) > k else -1.5
        row, place = np.nonzero(score >= np.maximum(floor, max(least, -1.5)) - slack)
        found.append((own[row], column[place]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
