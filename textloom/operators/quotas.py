"""Label weights and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.types import NONE_KEY, TaskKind, TaskSpec

NONE_SHARE = 0.25


def weight_frame(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """``pos, label, weight`` in the given order, which breaks ties."""
    rows = [(i, k, float(v)) for i, (k, v) in enumerate(weights.items())]
    return spark.createDataFrame(rows, "pos int, label string, weight double")


def as_dict(frame: DataFrame, value: str) -> dict:
    """A small label table as a dict in its order."""
    return {r["label"]: r[value] for r in frame.orderBy("pos").collect()}


def normalized_weights(spark: SparkSession, spec: TaskSpec, raw: dict[str, float]) -> DataFrame:
    """Known labels only; missing or non-positive weights take the mean of the given ones; sum 1."""
    keys = list(spec.names)
    if not spec.exclusive and raw.get(NONE_KEY, 0.0) > 0:
        keys.append(NONE_KEY)
    everything = Window.partitionBy()
    given = F.when(F.col("raw") > 0, F.col("raw"))
    rows = [(i, k, float(raw[k]) if k in raw else None) for i, k in enumerate(keys)]
    return (
        spark.createDataFrame(rows, "pos int, label string, raw double")
        .withColumn("filled", F.coalesce(given, F.avg(given).over(everything), F.lit(1.0)))
        .withColumn("weight", F.col("filled") / F.sum("filled").over(everything))
        .select("pos", "label", "weight")
    )


def corpus_weights(weights: DataFrame, kind: TaskKind) -> DataFrame:
    """Span and multilabel tasks without a weight for nothing: others shrink, nothing gets ``NONE_SHARE``."""
    if kind not in (TaskKind.SPAN, TaskKind.MULTILABEL):
        return weights
    if weights.filter((F.col("label") == NONE_KEY) & (F.col("weight") > 0)).head(1):
        return weights
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy()) * (1 - NONE_SHARE)
    scaled = weights.filter(F.col("label") != NONE_KEY).withColumn("weight", share)
    none = weights.sparkSession.createDataFrame([(1 << 30, NONE_KEY, NONE_SHARE)], "pos int, label string, weight double")
    return scaled.unionByName(none)


def label_quotas(weights: DataFrame, count: int) -> DataFrame:
    """``pos, label, quota``: largest remainders, ties by position; weights need not sum to 1."""
    raw = F.col("weight") / F.sum("weight").over(Window.partitionBy()) * count
    by_remainder = Window.orderBy(F.col("rest").desc(), "pos")
    left = F.lit(count) - F.sum("base").over(Window.partitionBy())
    return (
        weights.withColumn("raw", raw)
        .withColumn("base", F.floor("raw"))
        .withColumn("rest", F.col("raw") - F.col("base"))
        .withColumn("left", left)
        .withColumn("quota", F.col("base") + F.when(F.row_number().over(by_remainder) <= F.col("left"), 1).otherwise(0))
        .select("pos", "label", F.col("quota").cast("long").alias("quota"))
    )


def bucket(labels: Column, spans: Column) -> Column:
    """The first span's label, else the first label, else nothing."""
    return F.coalesce(F.get(spans, 0)["label"], F.get(labels, 0), F.lit(NONE_KEY))


def fill_report(quotas: DataFrame, collected: DataFrame) -> DataFrame:
    """``pos, label, quota, filled`` for every quota; ``collected`` has ``bucket``."""
    counts = collected.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return quotas.join(counts, quotas["label"] == counts["bucket"], "left").select(
        "pos", "label", "quota", F.coalesce("n", F.lit(0)).alias("filled")
    )
