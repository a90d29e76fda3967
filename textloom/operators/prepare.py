"""Corpus preparation: paragraphs, kana projection, dedup, statistics, shuffled export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.dedup import group_dedup
from textloom.operators.segment import paragraphs

MIN_CHARS = 20


def kana(text: Column) -> Column:
    """Kanji and kana of a text alone."""
    return F.regexp_replace(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]", "")


def prepared(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``text, source``: long enough paragraphs, one for each kana projection (or text, where that is empty)."""
    kept = paragraphs(docs.select("text", "source")).filter(F.length("text") >= min_chars)
    projected = kept.withColumn("kana", kana(F.col("text")))
    return group_dedup(projected, F.when(F.col("kana") == "", F.col("text")).otherwise(F.col("kana")))


def source_stats(rows: DataFrame) -> DataFrame:
    """Paragraphs and characters of each source."""
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars")
    ).orderBy("source")


def export_shuffled(rows: DataFrame, path: str, seed: int = 575) -> None:
    """Write JSON lines in a fixed pseudo-random order; one file for each range of the order."""
    rows.orderBy(F.xxhash64("text", F.lit(seed)), "text").write.mode("overwrite").json(path)
