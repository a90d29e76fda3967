"""An index of the normalized texts of a store: segments of digests, so that an insert does not read the store.

A segment holds the digests of some commits in hash buckets (partition folders), and for each bucket a Bloom filter
as rows of 64-bit words: a digest sets four bits of one word, so a filter is built by ``bit_or`` before the shuffle and
probed by an equality join on bucket and word. An insert reads the filters of the buckets that it meets, about ten
bits a stored text, and digests only of buckets where a filter says "perhaps"; a digest decides, so the answer is exact.
Buckets grow with the segment (``BUCKET_ROWS`` digests each, ``MOST_BUCKETS`` at most), digests are uniform, so no bucket
is hot whatever the texts are. A new segment is merged with the last ones as long as these are not much larger, so there
are logarithmically many and a digest is rewritten logarithmically often.

Defined results: null norms are never held and never met; an empty insert meets nothing and adds no segment.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.dedup import digest, first_per_norm

#: Digests of a bucket, 20 MB; a segment of up to that many has one.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 4096
#: Bits of the filter for each digest.
FILTER_BITS = 10
#: The last segment joins a new one unless it is more than so many times larger.
GROWTH = 2


def _placed(digests: DataFrame, segment: dict) -> DataFrame:
    """``digest`` with its ``bucket``, ``word`` in the bucket's filter and ``mask`` in that word."""
    hashed = digests.select("digest", F.xxhash64("digest").alias("h"))
    four = " | ".join(f"shiftleft(1L, cast(shiftright(h, {k}) & 63 AS INT))" for k in (0, 6, 12, 18))
    return hashed.select(
        "digest",
        F.expr(f"cast(shiftrightunsigned(h, 52) % {segment['buckets']} AS INT)").alias("bucket"),
        F.expr(f"(shiftrightunsigned(h, 24) & {(1 << 28) - 1}) % {segment['words']}").alias("word"),
        F.expr(four).alias("mask"),
    )


class NormIndex:
    """Segments under a folder; which of them count is told by the store's manifest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _digests(self, segment: dict) -> DataFrame:
        return self.spark.read.schema("digest binary, bucket int").parquet(f"{self.path}/{segment['name']}/digests")

    def _filters(self, segment: dict) -> DataFrame:
        return self.spark.read.schema("word long, bits long, bucket int").parquet(f"{self.path}/{segment['name']}/filters")

    def met(self, digests: DataFrame, segments: list[dict]) -> DataFrame:
        """The given digests that a segment holds, each once."""
        found = digests.filter("false").select("digest")
        for segment in segments:
            keys = _placed(digests.filter("digest is not null"), segment)
            filters = self._filters(segment).filter(F.col("bucket").isin(_buckets(keys)))
            perhaps = keys.join(filters, ["bucket", "word"]).filter("bits & mask = mask").select("bucket", "digest").checkpoint()
            held = self._digests(segment).filter(F.col("bucket").isin(_buckets(perhaps)))
            found = found.unionByName(perhaps.join(held, ["bucket", "digest"], "left_semi").select("digest"))
        return found.distinct()

    def insertable(self, rows: DataFrame, segments: list[dict], order: str = "seq") -> DataFrame:
        """Of rows with ``norm`` the first of each norm, none that a segment holds; rows should be cheap to read twice."""
        keyed = rows.withColumn("__digest", digest())
        seen = self.met(keyed.select(F.col("__digest").alias("digest")), segments).withColumnRenamed("digest", "__digest")
        return first_per_norm(keyed.join(seen, "__digest", "left_anti").select(*rows.columns), order)

    def extended(self, segments: list[dict], rows: DataFrame, n: int) -> list[dict]:
        """The segments with ``n`` new rows (with ``norm``, none held yet) in them: those kept, and a new one."""
        kept, new, total = list(segments), rows.select(digest().alias("digest")).filter("digest is not null"), n
        while kept and kept[-1]["rows"] <= GROWTH * total:
            last = kept.pop()
            new, total = new.unionByName(self._digests(last).select("digest")), total + last["rows"]
        buckets = min(MOST_BUCKETS, math.ceil(total / BUCKET_ROWS))
        words = math.ceil(total / buckets * FILTER_BITS / 64)
        segment = {"name": uuid.uuid4().hex, "rows": total, "buckets": buckets, "words": words}
        folder = f"{self.path}/{segment['name']}"
        placed = _placed(new, segment)
        placed.select("digest", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/digests")
        # filters come from what was written: the rows are read once
        again = _placed(self._digests(segment).select("digest"), segment)
        filters = again.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        filters.repartition("bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{folder}/filters")
        return [*kept, segment]


def _buckets(rows: DataFrame) -> list[int]:
    """The distinct buckets of rows: ``MOST_BUCKETS`` small numbers at most."""
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]
