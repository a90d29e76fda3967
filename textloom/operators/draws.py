"""Samples without replacement from one pool for each of many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.pools import with_position


def _place(key: Column, below: Column) -> Column:
    """A number from 0 to ``below - 1`` that hashes of the key give."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long") % below


def places(key: Column, n: Column, k: Column) -> Column:
    """``min(k, n)`` distinct numbers from 0 to ``n - 1``; every set of that size is as likely as any other.

    Floyd's sampling as a fold: for each j from n - k to n - 1 draw a number up to j, and take j itself if the
    number is taken. So what a request costs does not depend on the pool.
    """
    first = F.greatest(n - k, F.lit(0).cast("long"))
    turns = F.when(n > 0, F.sequence(first, n - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(taken: Column, j: Column) -> Column:
        drawn = _place(F.concat_ws("/", key, j.cast("string")), j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, drawn), j).otherwise(drawn)))

    return F.aggregate(turns, F.array().cast("array<bigint>"), step)


def drawn(requests: DataFrame, request: str, pool: DataFrame, order: str, k: int, seed: int, excluded: DataFrame | None = None) -> DataFrame:
    """``request`` and ``order`` of ``k`` pool rows for each request, or of all that there are.

    ``requests`` has distinct keys, ``pool`` is told apart by ``order``. ``excluded`` names rows (``request, order``)
    that a request must not get: as many more are drawn, what is excluded goes, the least hashes stay. Requests meet
    the pool by an equality of places, with ``k`` rows for each request and its exclusions; nothing is sorted but the
    pool, once. Null requests and null places in the pool are no rows.
    """
    placed = with_position(pool.select(order).filter(F.col(order).isNotNull()), order).select(order, (F.col("position") - 1).alias("__place"))
    placed = placed.checkpoint()
    n = placed.count()
    asked = requests.select(request).filter(F.col(request).isNotNull())
    more = F.lit(0)
    if excluded is not None:
        excluded = excluded.select(request, order).filter(F.col(order).isNotNull()).distinct()
        counts = excluded.groupBy(request).agg(F.count(F.lit(1)).alias("__more"))
        asked, more = asked.join(counts, request, "left"), F.coalesce("__more", F.lit(0))
    key = F.concat_ws("/", F.lit(str(seed)), F.col(request).cast("string"))
    each = asked.select(request, F.explode(places(key, F.lit(n).cast("long"), (more + k).cast("long"))).alias("__place"))
    met = each.join(placed, "__place").select(request, order)
    if excluded is None:
        return met
    left = met.join(excluded, [request, order], "left_anti")
    rank = F.sha2(F.concat_ws("/", F.lit("kept"), key, F.col(order).cast("string")), 256)
    by = Window.partitionBy(request).orderBy(rank, order)  # a request's draws
    return left.withColumn("__rank", F.row_number().over(by)).filter(F.col("__rank") <= k).select(request, order)
