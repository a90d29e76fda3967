"""Bounded samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The remainder of crc32(doc_id as text) by 4 that is kept out of every fit.
HELD_OUT = 2
#: Bytes of text that all documents of a sample hold at most.
FIT_BYTES = 64 << 20
#: Documents longer than this are taken for a language only if it has too few others.
LONG_BYTES = 1 << 16


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept out of the fit; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", limit_bytes: int = FIT_BYTES
) -> DataFrame:
    """``key, text, label`` of at most ``limit`` labelled rows, those with the smallest hashes of the id.

    Of these, in that order, documents that ``limit_bytes`` of text have room for are taken. The ids of the sample are
    ``limit`` rows at most, so they may be broadcast. A repeated id counts once.
    """
    chosen = (
        labels.select(key, F.col(label).alias("label"))
        .filter(F.col(key).isNotNull() & F.col("label").isNotNull() & ~held_out(key))
        .groupBy(key)
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(key), key)
        .limit(limit)
    )
    size = F.max(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size")
    sized = docs.select(key, "text").join(F.broadcast(chosen), key).groupBy(key).agg(size, F.max("label").alias("label"))
    room, ids = limit_bytes, []
    for row in sized.orderBy(F.xxhash64(key), key).collect():  # limit rows at most
        if row["size"] <= room:
            ids.append((row[key], row["label"]))
            room -= row["size"]
    kinds = chosen.select(key, "label").schema
    found = docs.select(key, "text").join(F.broadcast(docs.sparkSession.createDataFrame(ids, kinds)), key)
    return found.groupBy(key).agg(F.min("text").alias("text"), F.max("label").alias("label"))


def texts_of_each(docs: DataFrame, label: str, limit: int, key: str = "doc_id") -> DataFrame:
    """``key, text, label`` of at most ``limit`` rows of each label, so that no rare label is missed.

    Ids are ranked, long texts last and by hash; texts only move for the sample. A repeated id counts once.
    """
    usable = docs.select(key, "text", F.col(label).alias("label")).filter(
        F.col(key).isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(key)
    )
    order = [F.octet_length("text") > LONG_BYTES, F.xxhash64(key), F.col(key)]
    ranked = usable.select(key, "label", *[c.alias(f"__{i}") for i, c in enumerate(order)])
    place = F.row_number().over(Window.partitionBy("label").orderBy("__0", "__1", "__2"))
    ids = ranked.withColumn("__place", place).filter(F.col("__place") <= limit).select(key, "label").distinct()
    found = usable.join(F.broadcast(ids), [key, "label"])
    row = F.min(F.struct("text", "label")).alias("r")
    return found.groupBy(key).agg(row).select(key, "r.*")
