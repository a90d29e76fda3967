"""Words and hashes of many texts at once, in numpy.

Texts arrive as Arrow string columns. Their bytes are used where they lie: word and line boundaries, 64-bit hashes of
words, lines and word windows come from a few vectorized passes over a slice of about ``SLICE_BYTES`` of text, so the
memory of a task does not depend on the size of its partition. One very long text is one slice; hashes are made in runs
of ``RUN_BYTES`` there too, and what else is kept is a byte for each byte and some numbers for each word.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
AS_IS = np.arange(256, dtype=np.uint8)
#: Bytes that continue a code point.
CONTINUES = (np.arange(256) & 0xC0) == 0x80
#: A-Z to a-z, all other bytes unchanged.
LOWER = AS_IS.copy()
LOWER[65:91] += 32

#: Bytes that are hashed at once, and the powers that weigh them.
RUN_BYTES = 1 << 18


def _powers(base: int) -> np.ndarray:
    factors = np.full(RUN_BYTES + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """A slice of texts: ``data`` holds their bytes, ``off[i]:off[i + 1]`` those of text ``i``."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end`` of every word and ``first``: text ``i`` has the words ``first[i]:first[i + 1]``."""
        space = SPACE[self.data]
        before, after = np.empty_like(space), np.empty_like(space)
        if len(space):
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            before[self.off[:-1][self.off[:-1] < len(space)]] = True
            after[self.off[1:][self.off[1:] > 0] - 1] = True
        start = np.flatnonzero(~space & before)
        return start, np.flatnonzero(~space & after) + 1, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end, first`` of the lines that a split at line feeds gives; every text has at least one."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([self.off[1:], breaks]), kind="stable")
        n_breaks = np.searchsorted(breaks, self.off)
        return start, end, n_breaks + np.arange(len(self.off))

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: np.ndarray = AS_IS) -> np.ndarray:
        """A hash of the bytes ``start:end`` of each span, after ``fold``; starts and ends ascend."""
        code = np.zeros(len(start), dtype=np.uint64)
        at = 0
        while at < len(start):
            lo = int(start[at])
            stop = max(at + 1, int(np.searchsorted(end, lo + RUN_BYTES, side="right")))
            hi = int(end[stop - 1])
            if hi - lo <= RUN_BYTES:
                sums = np.zeros(hi - lo + 1, dtype=np.uint64)
                np.cumsum(self._weighed(lo, hi, fold), out=sums[1:])
                begin = start[at:stop] - lo
                code[at:stop] = (sums[end[at:stop] - lo] - sums[begin]) * _INVERSES[begin]
            else:  # one span longer than a run
                total = 0
                for k, piece in enumerate(range(lo, hi, RUN_BYTES)):
                    part = int(self._weighed(piece, min(piece + RUN_BYTES, hi), fold).sum(dtype=np.uint64))
                    total += part * pow(_BASE, k * RUN_BYTES, 1 << 64)
                code[at] = np.uint64(total % (1 << 64))
            at = stop
        return mixed(code + (end - start).astype(np.uint64))

    def _weighed(self, lo: int, hi: int, fold: np.ndarray) -> np.ndarray:
        return (fold[self.data[lo:hi]].astype(np.uint64) + np.uint64(1)) * _POWERS[: hi - lo]

    def tally(self, kind: np.ndarray) -> Tally:
        """Where bytes of a kind (a table of 256) are."""
        return Tally(np.flatnonzero(kind[self.data]))


class Tally:
    """Counts of a kind of byte in spans; holds a number for each such byte only."""

    def __init__(self, places: np.ndarray) -> None:
        self.places = places

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many are in ``lo:hi`` of each span."""
        if not len(self.places):
            return np.zeros(len(lo), dtype=np.int64)
        return np.searchsorted(self.places, hi) - np.searchsorted(self.places, lo)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into slices; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Texts(lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def owners(first: np.ndarray) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from every word on, and whether all of them are in one text."""
    n = len(codes)
    out = codes.copy()
    for j in range(1, min(k, n)):
        out[: n - j] = mixed(out[: n - j] * _C2 + codes[j:])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return out, left >= k


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the words of each text."""
    total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def repeated(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code: whether its text has it at least twice, and whether it has it earlier."""
    key = mixed(codes + mixed(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    again, many = np.empty_like(same), np.empty_like(same)
    again[order], many[order] = same, twice
    return many, again
