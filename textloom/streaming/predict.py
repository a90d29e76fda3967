"""Predictions over a stream of lines, and dedup of a stream of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.dedup import digest, with_norm
from textloom.plans import model as models
from textloom.types import TaskSpec


def lines_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Non-empty lines of files that arrive in a folder, as ``id, text``."""
    lines = spark.readStream.text(folder).filter(F.trim("value") != "")
    return lines.select(F.xxhash64("value").alias("id"), F.regexp_replace("value", r"\r$", "").alias("text"))


def predict_stream(
    spark: SparkSession, spec: TaskSpec, model, folder: str, emit: Callable[[DataFrame], None], checkpoint: str
) -> StreamingQuery:
    """Predict each micro-batch and hand its JSON lines to ``emit``; stateless, so any batch may be repeated.

    Equal lines of a batch are predicted once and given as often as they came.
    """

    def each(batch: DataFrame, _: int) -> None:
        told = models.prediction_json(models.predict(spec, model, batch.dropDuplicates(["id"])))
        emit(batch.select("id").join(told, "id").select("id", "value"))

    stream = lines_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def spark_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_texts(
    texts: DataFrame, order: str, *carried: str, time: str = "ts", delay: str = "1 day", span: str = "7 days", norm: Column | None = None
) -> DataFrame:
    """The row that is first in ``order`` of equal normalized texts of a stream, in each window of ``span``.

    State is one row for each window and text: a digest, the order and what is carried, never the text; where it outgrows
    memory, name the RocksDB provider in ``spark.sql.streaming.stateStore.providerClass``. A group is given again when
    an earlier row arrives. A window ends, and its state goes, once the watermark (the latest time less ``delay``) is
    past it; rows of ended windows are dropped. Null texts equal no other; rows without a time are no rows.
    """
    keyed = with_norm(texts, norm=norm).withWatermark(time, delay)
    key = F.coalesce(digest(), F.unhex(F.md5(F.concat(F.lit("null "), F.col(order).cast("string")))))
    groups = keyed.groupBy(F.window(time, span), key.alias("digest"))
    first = groups.agg(F.min(F.struct(order, *carried)).alias("first"))
    return first.select(F.col("window.start").alias("since"), "digest", "first.*")


def dedup_stream(firsts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what ``first_texts`` gives, a folder for each batch; a batch that is repeated replaces its folder."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = firsts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def streamed_firsts(spark: SparkSession, out: str) -> DataFrame:
    """What ``dedup_stream`` wrote so far, the last word of each group: its first row."""
    told = spark.read.parquet(out).drop("batch")
    best = told.groupBy("since", "digest").agg(F.min(F.struct(*[c for c in told.columns if c not in ("since", "digest")])).alias("first"))
    return best.select("since", "first.*")
