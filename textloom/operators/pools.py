"""Partition and split assignment by hashes: the same row always lands in the same place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import normalized_blake_share, normalized_latin, sha_share
from textloom.types import Pool, Split

TEST_SHARE = 0.2


def pool(document: Column, share: float = TEST_SHARE) -> Column:
    """Pool of a whole document by a blake2b hash of its normalized text."""
    return F.when(normalized_blake_share(document) < share, Pool.TEST.value).otherwise(Pool.TRAIN.value)


def portable_pool(document: Column, share: float = TEST_SHARE) -> Column:
    """Pool by SHA-256, by built-in functions only."""
    return F.when(sha_share(normalized_latin(document)) < share, Pool.TEST.value).otherwise(Pool.TRAIN.value)


def shuffle_key(text: Column, seed: int) -> Column:
    """A fixed pseudo-random order of texts."""
    return F.sha2(F.concat_ws(":", text, F.lit(str(seed))), 256)


def fixed_shuffle(rows: DataFrame, text: str, seed: int) -> DataFrame:
    """Rows in the order of ``shuffle_key``; a distributed sort by range."""
    return rows.orderBy(shuffle_key(F.col(text), seed), F.col(text))


def smallest_prefix(rows: DataFrame, key: Column, k: int, length: int = 64, digits: int = 4) -> str:
    """Radix selection: the shortest prefix ``p`` so that the rows with ``key`` up to ``p`` are the ``k`` smallest.

    ``key`` is a hexadecimal text of ``length`` digits. Every round counts rows by the next ``digits`` of it, under the
    prefix that holds the k-th: at most ``16 ** digits`` counts, no row moves. Rows are up to ``p`` where the first
    ``len(p)`` digits are. Rows with the k-th key are all taken, also where that makes more than ``k``; a ``k`` beyond all
    rows gives the largest key's prefix.
    """
    keyed = rows.select(key.alias("__key"))
    prefix, left = "", k
    while len(prefix) < length:
        own = keyed.filter(F.startswith("__key", F.lit(prefix))) if prefix else keyed
        step = F.substring("__key", len(prefix) + 1, digits).alias("d")
        counts = own.groupBy(step).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
        for row in counts:
            if row["n"] >= left or row is counts[-1]:
                break
            left -= row["n"]
        if not counts:
            return prefix
        prefix += row["d"]
        if row["n"] <= left:
            break
    return prefix


def split_train_valid(rows: DataFrame, key: str, seed: int, valid_ratio: float = 0.15) -> DataFrame:
    """Add ``split``: of n rows the ``max(1, round(n * valid_ratio))`` with the smallest hashes are for validation.

    The cut is found by radix selection; rows with one key are in one split. Null keys are for training and do not count.
    """
    hashed = shuffle_key(F.col(key), seed)
    n = rows.agg(F.count(key)).first()[0]
    cut = smallest_prefix(rows.filter(F.col(key).isNotNull()), hashed, max(1, round(n * valid_ratio)))
    first = F.col(key).isNotNull() & (F.substring(hashed, 1, len(cut)) <= cut)
    return rows.withColumn("split", F.when(first & F.lit(bool(cut)), Split.VALID.value).otherwise(Split.TRAIN.value))


def chunk_id(order: str, size: int) -> Column:
    """Number of the chunk of ``size`` rows in an order; for sets that are small (a batch of requests)."""
    return F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size)


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``position`` from 1 on in a total order, without ranking all rows in one task.

    Rows are sorted by range; the partitions' sizes (a number each) give the offsets, as a table of their own.
    """
    numbered = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__id", F.monotonically_increasing_id())
        .checkpoint()
    )
    offset, starts = 0, []
    for row in numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():
        starts.append((row["__part"], offset))
        offset += row["n"]
    shifts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part int, __shift long"))  # a row for each partition
    place = F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33) + F.col("__shift") + 1
    joined = numbered.join(shifts, "__part").withColumn("position", place.cast("long"))
    return joined.drop("__part", "__id", "__shift")
