"""Hash buckets: 64-bit codes dealt to buckets as packed arrays instead of rows.

A row of Spark holds all codes that one slice of texts sends to one bucket, as bytes of a numpy array. The bucket is
the upper half of a code, scaled; the lower half identifies the code inside its bucket. So a code costs four bytes of
shuffle, and a bucket is sorted and counted in numpy. The number of buckets grows with the input, which bounds what
one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Codes in a bucket, about.
PER_BUCKET = 2_000_000
LEAST_BUCKETS = 64


def n_buckets(codes: int) -> int:
    """How many buckets hold so many codes."""
    return max(LEAST_BUCKETS, -(-codes // PER_BUCKET))


def deal(codes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``bucket, positions``: which of the codes fall into each bucket that gets any, in their order."""
    high = codes >> np.uint64(32)
    bucket = ((high * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def low(codes: np.ndarray) -> np.ndarray:
    """The half of the codes that tells them apart inside a bucket."""
    return (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def joined(blobs: list[bytes], kind: type) -> np.ndarray:
    """One array of several packed ones."""
    return np.frombuffer(b"".join(blobs), dtype=kind)
