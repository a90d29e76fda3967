"""Cross-verification: an independent annotation must reproduce the label."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import signature
from textloom.types import Outcome

CHUNK = 20

#: Texts in, annotations out: (index, labels, [(quote, label), ...]) in any order.
Annotator = Callable[[list[str]], list[tuple[int, list[str], list[tuple[str, str]]]]]

_SCHEMA = "seq long, annotated string"


def _key(labels: list[str], quotes: list[tuple[str, str]]) -> str:
    """The signature of an annotation, as JSON."""
    if quotes:
        return json.dumps(sorted(json.dumps(list(q), ensure_ascii=False, separators=(",", ":")) for q in quotes), ensure_ascii=False, separators=(",", ":"))
    return json.dumps(sorted(set(labels)), ensure_ascii=False, separators=(",", ":"))


def annotations(rows: DataFrame, annotator: Annotator, chunk: int = CHUNK, workers: int = 4) -> DataFrame:
    """``seq, annotated`` for the rows (``seq, text``) that the annotator answers.

    Chunks of texts go to the annotator in order of ``seq`` within a partition, so a request is one call. Of several
    answers to one text the first counts; a call that fails loses its chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), chunk):
                part = frame.iloc[lo : lo + chunk]
                try:
                    answers = annotator(part["text"].tolist())
                except RuntimeError:
                    continue
                first: dict[int, str] = {}
                for index, labels, quotes in answers:
                    first.setdefault(index, _key(labels, quotes))
                ids = part["seq"].tolist()
                found = [(ids[i], key) for i, key in first.items() if 0 <= i < len(ids)]
                yield pd.DataFrame(found, columns=["seq", "annotated"])

    spread = rows.select("seq", "text").repartition(workers, "seq").sortWithinPartitions("seq")
    return spread.mapInPandas(run, _SCHEMA)


def matching(rows: DataFrame, annotated: DataFrame) -> DataFrame:
    """Rows whose own signature equals the annotation's."""
    own = F.to_json(signature(F.col("text"), F.col("labels"), F.col("spans")))
    signed = rows.withColumn("__own", own)
    agree = (signed["seq"] == annotated["seq"]) & (F.col("__own") == F.col("annotated"))
    return signed.join(annotated, agree, "left_semi").drop("__own")


def verified(rows: DataFrame, annotator: Annotator, chunk: int = CHUNK, workers: int = 4) -> DataFrame:
    """Rows whose label the annotator reproduces exactly."""
    return matching(rows, annotations(rows, annotator, chunk, workers))


def gate(consulted: DataFrame, annotator: Annotator, verify: bool = True, **options) -> DataFrame:
    """Verify what no labeler settled (``outcome`` null or abstained); all else passes."""
    if not verify:
        return consulted
    settled = F.coalesce(F.col("outcome") != Outcome.ABSTAINED.value, F.lit(False))
    return consulted.filter(settled).unionByName(verified(consulted.filter(~settled), annotator, **options))


def agreement(consulted: DataFrame, *by: str) -> DataFrame:
    """``agreed, disagreed, abstained, labeled, rate``, for each group of ``by``; rate is null when nothing was labeled."""
    counts = [F.count_if(F.col("outcome") == o.value).alias(o.value) for o in Outcome]
    labeled = F.col(Outcome.AGREED.value) + F.col(Outcome.DISAGREED.value)
    return (
        consulted.groupBy(*by)
        .agg(*counts)
        .withColumn("labeled", labeled)
        .withColumn("rate", F.try_divide(F.col(Outcome.AGREED.value), F.col("labeled")))
    )
