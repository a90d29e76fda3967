"""Rows in scan order, read by prefixes that about double, so that a scan that stops early reads little more.

The order is cut by ranges of an integer key. Histograms of the key alone (a column of the table, not its texts) tell
where; a filter on the key then reaches the scan, which skips Parquet row groups outside of the range where the table is
stored by the key. Only the rows of ranges that are asked for are read, expanded, sorted and numbered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.pools import with_position

#: Bins of a histogram, and rows of the first range at least.
BINS, FIRST = 1 << 16, 1024


class Range(NamedTuple):
    """Rows with ``position``, the position of the last one, and how many source rows were read so far."""

    rows: DataFrame
    last: int
    read: int


def _leaves(rows: DataFrame, key: str, lo: int, hi: int, before: int, first: int, bins: int) -> Iterator[tuple[int, int]]:
    """``last key, rows`` of parts of ``lo..hi`` in order, none with more rows than all before it (or ``first``).

    Parts with more are cut again, down to single keys. Each such part doubles what is before, so they are few.
    """
    width = -(-(hi - lo + 1) // bins)
    own = rows.filter(F.col(key).between(lo, hi))
    place = ((F.col(key).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width)).cast("long")
    counts = {r["b"]: r["n"] for r in own.groupBy(F.floor(place).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for b in sorted(counts):
        start, end = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        if width > 1 and counts[b] > max(before, first):
            yield from _leaves(rows, key, start, end, before, first, bins)
        else:
            yield end, counts[b]
        before += counts[b]


def key_ranges(rows: DataFrame, key: str, first: int = FIRST, bins: int = BINS) -> list[tuple[int, int, int]]:
    """``first key, last key, rows``: ranges of which none has more rows than all before it, or ``first``.

    Only a single key with more rows is a larger range. Null keys are in no range.
    """
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return []
    found: list[tuple[int, int, int]] = []
    start, before, own = int(ends["lo"]), 0, 0
    last = start - 1
    for end, n in _leaves(rows.select(key), key, start, int(ends["hi"]), 0, first, bins):
        if own and own + n > max(first, before):
            found.append((start, last, own))
            start, before, own = last + 1, before + own, 0
        last, own = end, own + n
    return [*found, (start, last, own)]


def ordered_ranges(
    rows: DataFrame, key: str, *order: str, first: int = FIRST, expand: Callable[[DataFrame], DataFrame] | None = None
) -> Iterator[Range]:
    """Ranges of rows by an integer key, numbered from 1 on by ``order`` (the key comes first in it).

    ``expand`` makes the scanned rows of source rows, as the passages of documents. Rows without a key come first.
    """
    position = read = 0
    nulls = rows.filter(F.col(key).isNull())
    parts = [(nulls, nulls.count())]
    parts += [(rows.filter(F.col(key).between(lo, hi)), n) for lo, hi, n in key_ranges(rows, key, first)]
    for own, n in parts:
        read += n
        if n:
            placed = with_position(own if expand is None else expand(own), *(order or (key,)))
            placed = placed.withColumn("position", F.col("position") + F.lit(position))
            position += placed.count()
            yield Range(placed, position, read)


def positioned_ranges(rows: DataFrame, first: int = FIRST) -> Iterator[Range]:
    """Ranges of rows that have a ``position`` from 1 on; stored as Parquet in that order, each range reads its own part."""
    total = rows.agg(F.max("position")).first()[0] or 0
    done, size = 0, first
    while done < total:
        end = min(total, done + size)
        yield Range(rows.filter(F.col("position").between(done + 1, end)), end, end)
        done, size = end, end
