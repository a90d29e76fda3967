"""Models on MLlib: a text classifier, one logistic regression a label for multilabel tasks, a token tagger for spans.

Encoder fine-tuning plugs in as another ``train`` and ``predict`` pair; the torch stack is not needed here.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark import SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import characters, metrics, spans
from textloom.types import LABELS, SPANS, TaskKind, TaskSpec, TrainConfig

FEATURES = 1 << 16
#: Sizes and languages to base models (fixed values of the model hubs).
PRESETS = {
    "en-base": "answerdotai/ModernBERT-base",
    "en-large": "answerdotai/ModernBERT-large",
    "ja-70m": "sbintuitions/modernbert-ja-70m",
    "ja-130m": "sbintuitions/modernbert-ja-130m",
    "ja-310m": "sbintuitions/modernbert-ja-310m",
    "llm-jp-base": "llm-jp/llm-jp-modernbert-base",
    "mm-small": "jhu-clsp/mmBERT-small",
    "mm-base": "jhu-clsp/mmBERT-base",
}
BY_LANGUAGE = {
    ("en", "base"): "en-base",
    ("en", "large"): "en-large",
    ("ja", "base"): "llm-jp-base",
    ("ja", "large"): "ja-310m",
    ("", "base"): "mm-small",
    ("", "large"): "mm-base",
}


def base_model(choice: str, language: str) -> str:
    """A hub id for a size, a preset or a hub id; other languages take the multilingual models."""
    if "/" in choice:
        return choice
    if choice in PRESETS:
        return PRESETS[choice]
    if choice not in ("base", "large"):
        raise ValueError(f"unknown base model {choice!r}: use base, large, {', '.join(PRESETS)} or a hub id")
    primary = language.lower().replace("_", "-").split("-")[0]
    return PRESETS[BY_LANGUAGE.get((primary, choice)) or BY_LANGUAGE["", choice]]


def _features(column: str, words: bool) -> list:
    if words:
        return [
            RegexTokenizer(inputCol=column, outputCol="__words", pattern=r"\W+", toLowercase=True),
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=FEATURES),
            IDF(inputCol="__tf", outputCol="features"),
        ]
    return [
        RegexTokenizer(inputCol=column, outputCol="__chars", pattern=".", gaps=False, toLowercase=False, minTokenLength=0),
        NGram(inputCol="__chars", outputCol="__grams", n=3),
        HashingTF(inputCol="__grams", outputCol="features", numFeatures=FEATURES),
    ]


#: Steps of the optimizer in an epoch.
STEPS = 10


def _regression(label: str, config: TrainConfig, name: str = "") -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=max(1, round(STEPS * config.epochs)), regParam=config.weight_decay / 10,
        rawPredictionCol=f"raw{name}", probabilityCol=f"probability{name}", predictionCol=f"prediction{name}",
    )


#: The column of token contexts tells what the tokens are, also in a stored model.
WORDS, CHARACTERS = "context", "character_context"
WEIGHT = "weight"


#: Characters are counted by neighbourhood and tag; a count over its share of all of this many becomes several rows.
LEAST_ROWS = 1_000_000


def _tokens(context: str) -> Column:
    return spans.character_tokens(F.col("text")) if context == CHARACTERS else spans.word_tokens(F.col("text"))


def _character_rows(rows: DataFrame) -> DataFrame:
    """A row for characters with equal neighbourhoods and tags, which ``weight`` counts.

    The loss and its gradient are those of a row for each character. Of weighted rows MLlib takes a variance over
    n - sum(weight^2) / n instead of n - 1, and scales the optimizer's steps by it. With at most n / LEAST_ROWS a row
    that is a part in LEAST_ROWS; up to LEAST_ROWS characters have a row each, as listed.
    """
    counted = characters.neighbourhoods(rows).persist(StorageLevel.DISK_ONLY)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(1, -(-total // LEAST_ROWS))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))
    each = counted.select(characters.context().alias(CHARACTERS), "tag", "n", F.explode(parts).alias("part"))
    weight = F.least(F.lit(most).cast("long"), F.col("n") - F.col("part") * most).cast("double")
    return each.select(CHARACTERS, "tag", weight.alias(WEIGHT))


def _word_rows(rows: DataFrame) -> DataFrame:
    """A row for each word of a text: its neighbourhood as a string, its offsets and its tag's id if spans are known.

    Neighbours come from shifted arrays of the words, so that a row holds its own token only and a text costs its length.
    """
    reach = 1
    words = F.split("text", f"[{spans.WS}]+")
    own = rows.withColumn("__tokens", _tokens(WORDS)).withColumn("__words", F.filter(words, lambda w: w != ""))
    outside = F.array_repeat(F.lit(spans.OUTSIDE), F.size("__tokens"))
    tags = spans.bio_tags(F.col("spans"), F.col("__tokens")) if "spans" in rows.columns else outside
    edge = F.array_repeat(F.lit("_"), reach)

    def shape(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(w, r"\p{N}", "9"), r"\p{Lu}", "A")

    def near(padded: Column, shapes: Column) -> Column:
        def parts(i: Column) -> list[Column]:
            places = [(k, i + (reach + k)) for k in range(-reach, reach + 1)]
            return [c for k, at in places for c in (F.lit(f" w{k}="), F.get(padded, at), F.lit(f" s{k}="), F.get(shapes, at))]

        return F.transform("__words", lambda _, i: F.concat(*parts(i)))

    padded = F.concat(edge, F.col("__words"), edge)
    contexts = spans.let(padded, lambda p: spans.let(F.transform(p, shape), lambda shapes: near(p, shapes)))
    zipped = F.arrays_zip(F.col("__tokens").alias("token"), tags.alias("tag"), contexts.alias("context"))
    each = own.select("id", F.posexplode(zipped).alias("pos", "t"))
    return each.select("id", "pos", "t.token", "t.tag", F.col("t.context").alias(WORDS))


def token_context(rows: DataFrame) -> str:
    """What the tokens of a span task are: words, or characters if too many gold spans cut through words."""
    lost = spans.unreachable(F.col("text"), F.col("spans"), spans.word_tokens(F.col("text")))
    total = rows.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n"), F.coalesce(F.sum(lost), F.lit(0)).alias("lost")).first()
    return CHARACTERS if spans.needs_characters(total["n"], total["lost"]) else WORDS


@dataclass(frozen=True)
class Trained:
    """A model, the loss on the validation rows after each epoch (null without any), and the epoch that was kept."""

    model: PipelineModel
    losses: tuple[float | None, ...]
    best: int


def _steps(config: TrainConfig, several: bool) -> list[int]:
    """Optimizer steps of each epoch, the last one in part; all in one where nothing is compared."""
    total = max(1, round(STEPS * config.epochs))
    return [min(STEPS, total - at) for at in range(0, total, STEPS)] if several else [total]


def _marked(spec: TaskSpec, rows: DataFrame, context: str) -> tuple[DataFrame, list, list[str]]:
    """Rows with their targets, the stages that make features of them, and the targets' names."""
    if spec.kind is TaskKind.SPAN:
        tagged = _character_rows(rows) if context == CHARACTERS else _word_rows(rows).withColumn(WEIGHT, F.lit(1.0))
        tagged = tagged.withColumn("label", spans.class_id(spec, F.col("tag")).cast("double"))
        tokens = RegexTokenizer(inputCol=context, outputCol="__words", pattern=" ", toLowercase=False)
        return tagged, [tokens, HashingTF(inputCol="__words", outputCol="features", numFeatures=FEATURES)], ["label"]
    if spec.kind is TaskKind.MULTILABEL:
        targets = {f"label{i}": F.array_contains("labels", name).cast("double") for i, name in enumerate(spec.names)}
        return rows.withColumns(targets), _features("text", True), list(targets)
    return rows.withColumn("label", spans.class_id(spec, F.get("labels", 0)).cast("double")), _features("text", True), ["label"]


def _loss(spec: TaskSpec, regressions: list[LogisticRegressionModel], featured: DataFrame, targets: list[str]) -> float | None:
    """Mean logarithmic loss of the targets (of each label where several may hold)."""
    total, scored = F.lit(0.0), featured
    for target, fitted in zip(targets, regressions, strict=True):
        scored = fitted.transform(scored)
        chance = F.get(vector_to_array(fitted.getProbabilityCol()), F.col(target).cast("int"))
        total = total - F.log(F.greatest(F.coalesce(chance, F.lit(0.0)), F.lit(1e-15)))
    weight = F.when(total.isNotNull(), F.col(WEIGHT) if WEIGHT in featured.columns else F.lit(1.0))
    return scored.agg((F.sum(total / len(targets) * weight) / F.sum(weight)).alias("loss")).first()["loss"]


def train_epochs(
    spec: TaskSpec,
    rows: DataFrame,
    config: TrainConfig,
    valid: DataFrame | None = None,
    start: PipelineModel | None = None,
    patience: int | None = None,
) -> Trained:
    """Fit on ``id, text, labels, spans``, from the coefficients of ``start`` if given.

    After each epoch the loss on ``valid`` is taken, and the model with the smallest one is kept (the earlier at a tie);
    ``patience`` epochs without a smaller one end the fit. Without validation rows the last model is kept. Texts
    are tokenized and hashed once; gradients are summed over all partitions of the hashed features.
    Of the options, epochs (optimizer steps) and weight decay (ridge) have a meaning here; learning rate, batch size,
    length and warm-up are those of an encoder and are kept for one that plugs in.
    """
    context = ""
    if spec.kind is TaskKind.SPAN:
        context = start.stages[0].getInputCol() if start is not None else token_context(rows)
    marked, stages, targets = _marked(spec, rows, context)
    if valid is not None and valid.isEmpty():
        valid = None
    hashing = stages[:2]
    inputs = PipelineModel(hashing).transform
    kept = [*targets, stages[1].getOutputCol(), *([WEIGHT] if spec.kind is TaskKind.SPAN else [])]
    hashed = inputs(marked).select(kept).persist(StorageLevel.DISK_ONLY)
    held = inputs(_marked(spec, valid, context)[0]).select(kept).persist(StorageLevel.DISK_ONLY) if valid is not None else None
    weighing = [stage.fit(hashed) for stage in stages[2:]]
    featured = PipelineModel(weighing).transform(hashed)
    names = [t.removeprefix("label") for t in targets]
    before = [s for s in (start.stages if start is not None else ()) if isinstance(s, LogisticRegressionModel)]
    current: list[LogisticRegressionModel] = before if len(before) == len(targets) else []
    best, losses, at = current, [], 0
    for epoch, steps in enumerate(_steps(config, held is not None)):
        fits = []
        for i, (target, name) in enumerate(zip(targets, names, strict=True)):
            regression = _regression(target, config, name).setMaxIter(steps)
            if WEIGHT in kept:
                regression.setWeightCol(WEIGHT)
            if current:
                regression._java_obj.setInitialModel(current[i]._java_obj)
            fits.append(regression.fit(featured))
        current = fits
        loss = _loss(spec, current, PipelineModel(weighing).transform(held), targets) if held is not None else None
        if loss is None or all(old is None or loss < old for old in losses):
            best, at = current, epoch
        losses.append(loss)
        if patience is not None and epoch - at >= patience:
            break
    for frame in (hashed, held):
        if frame is not None:
            frame.unpersist()
    return Trained(PipelineModel([*hashing, *weighing, *best]), tuple(losses), at)


def train(
    spec: TaskSpec, rows: DataFrame, config: TrainConfig, start: PipelineModel | None = None, valid: DataFrame | None = None
) -> PipelineModel:
    """The model of ``train_epochs``."""
    return train_epochs(spec, rows, config, valid, start).model


def _predicted_characters(spec: TaskSpec, fitted: LogisticRegressionModel, plain: DataFrame) -> DataFrame:
    """``predict`` with characters as tokens: only those that are in a span, and the one after, leave the tagger."""
    weights, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(weights) == 1:  # of two classes only the second has a row
        weights, intercepts = np.vstack([0 * weights, weights]), np.concatenate([[0.0], intercepts])
    limit = 1e4  # a class that was never met has an infinite intercept
    find = characters.tagger(weights, np.clip(intercepts, -limit, limit), spans.label_names(spec))
    each = plain.withColumn("t", find(F.col("text"))).withColumn("tokens", F.col("t.token"))
    nothing = F.array().cast(SPANS)
    found = F.when(F.size("t") == 0, nothing).otherwise(F.coalesce(spans.decoded(F.col("text"), F.col("tokens"), F.col("t.tag")), nothing))
    scored = each.withColumn("pred_spans", found)
    return scored.select(
        "id", "text", F.array().cast(LABELS).alias("pred_labels"), "pred_spans",
        F.lit(None).cast("map<string,double>").alias("scores"), spans.span_scores(F.col("pred_spans"), F.col("tokens")).alias("span_scores"),
    )


def predict(spec: TaskSpec, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``id, text`` with ``pred_labels, pred_spans``, ``scores`` (map) and ``span_scores``."""
    names = spec.names
    if spec.kind is TaskKind.SPAN:
        plain = rows.select("id", "text")
        if model.stages[0].getInputCol() == CHARACTERS:
            return _predicted_characters(spec, model.stages[-1], plain)
        tags = model.transform(_word_rows(plain)).withColumn("p", vector_to_array("probability"))
        tag_name = F.get(F.array(*map(F.lit, spans.label_names(spec))), F.col("prediction").cast("int"))
        item = F.struct(
            "pos", F.struct("token.start", "token.end", "token.special", F.array_max("p").alias("prob")).alias("token"), tag_name.alias("tag")
        )
        tags = tags.select("id", item.alias("item"))
        each = tags.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("t"))
        joined = plain.join(each, "id", "left").withColumn("tokens", F.col("t.token"))
        found = F.coalesce(spans.decoded(F.col("text"), F.col("tokens"), F.col("t.tag")), F.array().cast(SPANS))
        scored = joined.withColumn("pred_spans", found)
        scores = spans.span_scores(F.col("pred_spans"), F.col("tokens"))
        return scored.select(
            "id", "text", F.array().cast(LABELS).alias("pred_labels"), "pred_spans",
            F.lit(None).cast("map<string,double>").alias("scores"), scores.alias("span_scores"),
        )
    out = model.transform(rows.select("id", "text"))
    if spec.kind is TaskKind.MULTILABEL:
        probabilities = F.array(*[F.get(vector_to_array(f"probability{i}"), 1) for i in range(len(names))])
        labels = metrics.above_half(names, F.col("__p"))
    else:
        probabilities = vector_to_array("probability")
        labels = F.array(metrics.argmax_label(names, F.col("__p")))
    scored = out.withColumn("__p", probabilities)
    return scored.select(
        "id", "text", labels.alias("pred_labels"), F.array().cast(SPANS).alias("pred_spans"),
        F.map_from_arrays(F.array(*map(F.lit, names)), F.col("__p")).alias("scores"),
        F.array().cast("array<double>").alias("span_scores"),
    )


def prediction_json(predicted: DataFrame) -> DataFrame:
    """One JSON line each: spans with their text and score, else labels with scores; four digits, half to even."""

    def one(s: Column, i: Column) -> Column:
        text = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("text")
        return F.struct(text, s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.bround(F.get("span_scores", i), 4).alias("score"))

    marked = F.to_json(F.struct("text", F.transform("pred_spans", one).alias("spans")))
    rounded = F.transform_values("scores", lambda _, v: F.bround(v, 4))
    plain = F.to_json(F.struct("text", F.col("pred_labels").alias("labels"), rounded.alias("scores")))
    return predicted.select("id", F.when(F.size("pred_spans") > 0, marked).otherwise(plain).alias("value"))


def save(model: PipelineModel, path: Path) -> None:
    """Save beside, then rename, so a model folder is whole; in whatever file system Spark names the path in."""
    beside = f"{path}.tmp"
    model.write().overwrite().save(beside)
    context = SparkContext._active_spark_context
    made, named = (context._jvm.org.apache.hadoop.fs.Path(str(p)) for p in (beside, path))
    system = made.getFileSystem(context._jsc.hadoopConfiguration())
    system.delete(named, True)
    if not system.rename(made, named):
        raise OSError(f"cannot rename {beside} to {path}")


def evaluate(spec: TaskSpec, model: PipelineModel, rows: DataFrame):
    """Metrics of a model on ``id, text, labels, spans``."""
    predicted = predict(spec, model, rows).drop("text")
    found = metrics.evaluate(rows.join(predicted, "id"), spec)
    if spec.kind is not TaskKind.SPAN:
        return found
    lost = spans.unreachable(F.col("text"), F.col("spans"), _tokens(model.stages[0].getInputCol()))
    return replace(found, unreachable_spans=rows.agg(F.coalesce(F.sum(lost), F.lit(0))).first()[0])
