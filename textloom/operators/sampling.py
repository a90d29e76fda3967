"""Quota-stratified sampling in scan order.

``sample`` gives what a sequential scan would collect: passages of one pool in order, texts seen before are skipped,
abstentions and full buckets are dropped, and the scan ends when all quotas are filled or ``stall_limit`` passages in
a row added nothing. It is computed by ranks, not row by row: the k first of each bucket come from a top-k window, of
which every task passes on k rows at most. ``sample_ranges`` does so range by range (``scan``) and stops where the scan
stops; open quotas, collected texts and the gap since the last one carry over.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.dedup import digest, first_per_norm, not_seen, with_norm
from textloom.operators.labelers import Labeler
from textloom.operators.quotas import bucket
from textloom.operators.scan import Range

STALL_LIMIT = 1_000_000


@dataclass(frozen=True)
class Sampled:
    """Collected rows (``position, text, labels, spans, bucket, norm``), passages scanned, whether the scan stalled.

    ``read`` counts the source rows of the ranges that were read.
    """

    rows: DataFrame
    scanned: int
    stalled: bool
    read: int = 0


def candidates(passages: DataFrame, labeler: Labeler, pool: str, quotas: dict[str, int], seen: DataFrame, norm=None):
    """Labeled passages of a pool that a quota could take; cheap filters run before the labeler."""
    own = not_seen(with_norm(passages.filter(F.col("pool") == pool), norm=norm), seen)
    labeled = labeler(own).filter("not abstained").withColumn("bucket", bucket(F.col("labels"), F.col("spans")))
    return labeled.filter(F.col("bucket").isin([k for k, n in quotas.items() if n > 0]))


def quota_of(quotas: dict[str, int], extra: int = 0):
    """The quota of a row's bucket as an expression."""
    pairs = [F.lit(x) for k, n in quotas.items() if n > 0 for x in (k, n + extra)]
    return F.element_at(F.create_map(*pairs), F.col("bucket"))


def first_per_bucket(found: DataFrame, quotas: dict[str, int], order: str, extra: int = 0) -> DataFrame:
    """The first ``quota + extra`` rows of each bucket."""
    most = max(quotas.values()) + extra
    by_order = Window.partitionBy("bucket").orderBy(order)
    ranked = found.withColumn("__rank", F.row_number().over(by_order)).filter(F.col("__rank") <= most)
    return ranked.filter(F.col("__rank") <= quota_of(quotas, extra)).drop("__rank")


def unique_per_bucket(found: DataFrame, order: str) -> DataFrame:
    """First row of each (norm, bucket)."""
    return first_per_norm(found, order, "bucket")


def collect(found: DataFrame, quotas: dict[str, int], order: str = "position") -> DataFrame:
    """Rows that the scan collects, before the stall rule.

    A text is skipped once it is collected, not once it is seen. So equal texts with different labels may fill two
    buckets' candidates. The first rows of each bucket are replayed on the driver, as many as its quota; where skipped
    texts leave a bucket short that has more rows, the first twice as many are, and so on. So the driver holds
    digests of a few times the quotas, whatever the data.
    """
    unique = unique_per_bucket(found, order).checkpoint()
    extra = 0
    while True:
        chosen = first_per_bucket(unique, quotas, order, extra)
        left, used, places, met = dict(quotas), set(), [], dict.fromkeys(quotas, 0)
        for row in chosen.select(order, digest().alias("d"), "bucket").orderBy(order).collect():
            met[row["bucket"]] += 1
            if row["d"] not in used and left[row["bucket"]] > 0:
                used.add(row["d"])
                left[row["bucket"]] -= 1
                places.append((row[order],))
        if not any(left[b] and met[b] >= quotas[b] + extra for b in quotas):
            break
        extra = max(16, 2 * extra)
    if len(places) == sum(met.values()):
        return chosen
    kept = found.sparkSession.createDataFrame(places, f"{order} long")
    return chosen.join(F.broadcast(kept), order, "left_semi")


def sample(
    passages: DataFrame,
    labeler: Labeler,
    pool: str,
    quotas: dict[str, int],
    seen: DataFrame,
    stall_limit: int = STALL_LIMIT,
    norm=None,
) -> Sampled:
    """``passages``: ``position`` (1.. over both pools, see ``pools.with_position``), ``pool``, ``text``; one range."""
    total = passages.agg(F.max("position")).first()[0] or 0
    return sample_ranges([Range(passages, total, total)], labeler, pool, quotas, seen, stall_limit, norm)


def sample_ranges(
    ranges: Iterable[Range],
    labeler: Labeler,
    pool: str,
    quotas: dict[str, int],
    seen: DataFrame,
    stall_limit: int = STALL_LIMIT,
    norm=None,
) -> Sampled:
    """What a scan of all ranges in order collects; no range is asked for after the one in which it stops.

    The driver holds places and digests of the collected rows, as many as there are quotas to fill. Each range must have
    the columns of the others; without any range, ``rows`` has those of ``seen``.
    """
    left = {k: n for k, n in quotas.items() if n > 0}
    used: list[tuple[bytes]] = []
    parts: list[DataFrame] = []
    last = end = read = 0
    for own, end, read in ranges if left else ():
        found = candidates(own, labeler, pool, left, seen, norm)
        if used:
            known = seen.sparkSession.createDataFrame(used, "__digest binary")  # rows of the quotas at most
            found = found.withColumn("__digest", digest()).join(F.broadcast(known), "__digest", "left_anti").drop("__digest")
        chosen = collect(found, {k: n for k, n in left.items() if n}).checkpoint()
        parts.append(chosen)
        rows = chosen.select("position", "bucket", digest().alias("d")).orderBy("position").collect()
        for row in rows:
            if row["position"] - last > stall_limit:
                break
            last = row["position"]
            left[row["bucket"]] -= 1
            used.append((bytes(row["d"]),))
        left = {k: n for k, n in left.items() if n}
        if not left or end > last + stall_limit:
            break
    if not parts:
        return Sampled(seen.limit(0), 0, False)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    stalled = bool(left) and end > last + stall_limit
    scanned = last + stall_limit if stalled else end if left else last
    return Sampled(rows.filter(F.col("position") <= last), scanned, stalled, read)
