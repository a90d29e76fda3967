"""Classification and span metrics as aggregates.

Predictions are a frame with ``id, labels, pred_labels`` (classification) or ``id, spans, pred_spans`` (spans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import describe
from textloom.operators.pools import with_position
from textloom.types import LabelScore, Metrics, TaskKind, TaskSpec

MAX_ERRORS = 20


def _label_dim(frame: DataFrame, names: list[str]) -> DataFrame:
    return F.broadcast(frame.sparkSession.createDataFrame(list(enumerate(names)), "pos int, label string"))


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``tp, fp, fn``, 0 on a zero denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return (
        counts.withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
        .withColumn("support", tp + fn)
    )


def confusion(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``pos, label, tp, fp, fn, tn`` for every label, in one pass over the predictions."""

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    columns = []
    for i, name in enumerate(names):
        gold, guess = F.array_contains("labels", name), F.array_contains("pred_labels", name)
        columns += [
            count(gold & guess).alias(f"tp{i}"), count(~gold & guess).alias(f"fp{i}"),
            count(gold & ~guess).alias(f"fn{i}"), count(~gold & ~guess).alias(f"tn{i}"),
        ]
    each = [
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("label"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")])
        for i, n in enumerate(names)
    ]
    return pairs.agg(*columns).select(F.explode(F.array(*each)).alias("r")).select("r.*")


def class_scores(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Scores of every label."""
    return with_scores(confusion(pairs, names)).select("pos", "label", "precision", "recall", "f1", "support", "tp", "fp", "fn")


def macro_f1(scores: DataFrame) -> DataFrame:
    """One row: mean F1 of the labels that occur in gold or prediction, 0 without any."""
    seen = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return scores.agg(F.coalesce(F.avg(F.when(seen, F.col("f1"))), F.lit(0.0)).alias("primary"))


def same_set(a: str, b: str) -> Column:
    """Whether two label arrays hold the same labels."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def same_spans(a: str, b: str) -> Column:
    """Whether two span arrays hold the same spans."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset_accuracy(pairs: DataFrame) -> DataFrame:
    """One row: share of rows whose label sets are equal, 0 without rows."""
    return pairs.agg(F.coalesce(F.avg(same_set("labels", "pred_labels").cast("double")), F.lit(0.0)).alias("accuracy"))


def span_counts(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``pos, label, tp, fp, fn`` of exact spans, per row by array functions: no join and no shuffle of spans."""
    gold, guess = F.array_distinct("spans"), F.array_distinct("pred_spans")
    hits = F.transform(F.array_intersect(gold, guess), lambda s: F.struct(s["label"].alias("label"), F.lit("tp").alias("kind")))
    extra = F.transform(F.array_except(guess, gold), lambda s: F.struct(s["label"].alias("label"), F.lit("fp").alias("kind")))
    missed = F.transform(F.array_except(gold, guess), lambda s: F.struct(s["label"].alias("label"), F.lit("fn").alias("kind")))
    counts = pairs.select(F.explode(F.concat(hits, extra, missed)).alias("r")).groupBy("r.label").agg(
        *[F.count_if(F.col("r.kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    )
    dim = _label_dim(pairs, names)
    return dim.join(counts, "label", "left").select(
        "pos", "label", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("tp", "fp", "fn")]
    )


def span_scores(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Scores of every span label."""
    return with_scores(span_counts(pairs, names)).select("pos", "label", "precision", "recall", "f1", "support", "tp", "fp", "fn")


def micro_f1(scores: DataFrame) -> DataFrame:
    """One row: F1 of the counts summed over labels."""
    total = scores.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    return with_scores(total).select(F.col("f1").alias("primary"))


def errors(pairs: DataFrame, kind: TaskKind) -> DataFrame:
    """Rows predicted wrongly."""
    if kind is TaskKind.SPAN:
        return pairs.filter(~same_spans("spans", "pred_spans"))
    return pairs.filter(~same_set("labels", "pred_labels"))


def error_sample(wrong: DataFrame, order: str, most: int = MAX_ERRORS) -> DataFrame:
    """Every stride-th error in order, at most ``most``, stride ``max(1, n // most)``."""
    stride = max(1, wrong.count() // most)
    placed = with_position(wrong.select(order), order)
    chosen = placed.filter(((F.col("position") - 1) % stride == 0) & (F.col("position") <= stride * most))
    return wrong.join(F.broadcast(chosen.select(order)), order, "left_semi")  # at most ``most`` rows


def evaluate(pairs: DataFrame, spec: TaskSpec, text: str = "text", keep_errors: int = MAX_ERRORS) -> Metrics:
    """All metrics of predictions; at most ``keep_errors`` errors are kept as examples."""
    n = pairs.count()
    if spec.kind is TaskKind.SPAN:
        scores = span_scores(pairs, spec.names)
        primary = micro_f1(scores).first()[0]
        accuracy = pairs.agg(F.coalesce(F.avg(same_spans("spans", "pred_spans").cast("double")), F.lit(0.0))).first()[0]
    else:
        scores = class_scores(pairs, spec.names)
        primary = macro_f1(scores).first()[0]
        accuracy = subset_accuracy(pairs).first()[0]
    empty = F.array()
    gold_labels, gold_spans, guess_labels, guess_spans = (
        F.col(c) if c in pairs.columns else empty for c in ("labels", "spans", "pred_labels", "pred_spans")
    )
    wrong = errors(pairs, spec.kind).orderBy("id").limit(keep_errors)
    listed = wrong.select(
        F.col(text).alias("text"),
        describe(F.col(text), gold_labels.cast("array<string>"), gold_spans.cast("array<struct<start:int,end:int,label:string>>")).alias("gold"),
        describe(F.col(text), guess_labels.cast("array<string>"), guess_spans.cast("array<struct<start:int,end:int,label:string>>")).alias("predicted"),
    ).collect()
    rows = scores.orderBy("pos").collect()
    per_label = tuple(LabelScore(r["label"], r["precision"], r["recall"], r["f1"], r["support"]) for r in rows)
    return Metrics(primary, accuracy, per_label, n, errors=tuple(r.asDict() for r in listed))


def best_round(rounds: DataFrame) -> DataFrame:
    """The round with the best test score, then validation score, then the earliest."""
    return rounds.orderBy(F.col("primary").desc(), F.coalesce("valid", F.lit(0.0)).desc(), "round").limit(1)


def argmax_label(names: list[str], probabilities: Column) -> Column:
    """The first label with the largest probability."""
    return F.get(F.array(*map(F.lit, names)), (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def above_half(names: list[str], probabilities: Column, threshold: float = 0.5) -> Column:
    """Labels with a probability over the threshold."""
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("n"), probabilities.alias("p"))
    return F.transform(F.filter(pairs, lambda x: x["p"] > threshold), lambda x: x["n"])


def softmax(logits: Column) -> Column:
    """Softmax of an array."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid(logits: Column) -> Column:
    """Logistic function of each element of an array."""
    return F.transform(logits, lambda x: 1.0 / (1.0 + F.exp(-x)))
