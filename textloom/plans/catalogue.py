"""Queries over the provided tables, one or more for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import describe, normalized_latin, signature
from textloom.operators import dedup, draws, labelers, metrics, pools, prepare, quotas, sampling, scan, segment, spans, verify
from textloom.plans import generation, model
from textloom.session import ensure_checkpoint_dir
from textloom.sources.store import ExampleStore, label_counts
from textloom.streaming import predict
from textloom.types import NONE_KEY, Axis, DataPlan, LabelDef, Pool, Split, TaskKind, TaskSpec, TrainConfig

MAX_CHARS = 300
SEED = 42
LANGS = ("de", "en", "es", "fr")
#: Words by which the plain language rule goes (fixed values), and words that mark a toxic text.
STOP_WORDS = {"de": "der|die|das|und", "en": "the|and|of|that", "es": "el|los|que|para", "fr": "le|les|des|une"}
TOXIC = "idiot|moron|clown|pathetic|worthless"
LANG_SPEC = TaskSpec("Name the language.", TaskKind.MULTICLASS, tuple(LabelDef(n) for n in LANGS))
FLAG_SPEC = TaskSpec("Flag the text.", TaskKind.MULTILABEL, (LabelDef("quality"), LabelDef("toxic")))
DIGIT_SPEC = TaskSpec("Mark the numbers.", TaskKind.SPAN, (LabelDef("NUMBER"),))
QUOTAS = {"short": 40, "medium": 60, "long": 30, NONE_KEY: 0}
STALLING, STALL = {"medium": 25, "long": 1_000_000}, 20
FIRST_RANGE = 128
PLAN = DataPlan({"de": 0.4, "en": 0.1, "es": 0.3, "fr": 0.2}, (Axis("tone", ("dry", "warm", "odd")), Axis("form", ("note", "talk", "list", "tale"))))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated documents, their pools, their passages: counts by pool and language."""
    docs = dedup.with_norm(_docs(spark, sf_dir), norm=normalized_latin(F.col("text")))
    pooled = docs.withColumn("pool", pools.portable_pool(F.col("text")))  # beside the norm, which is computed once for both
    unique = dedup.first_per_norm(pooled, "doc_id")
    each = segment.explode_passages(unique.select("lang", "pool", "text"), MAX_CHARS)
    return each.groupBy("pool", "lang").agg(
        F.count(F.lit(1)).alias("passages"), F.sum(F.length("text")).cast("long").alias("chars")
    )


# --- text, dedup, preparation --------------------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", dedup.normalized(F.col("text")).alias("norm"))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup.with_norm(_docs(spark, sf_dir), norm=normalized_latin(F.col("text")))
    return dedup.first_per_norm(docs, "doc_id").select("doc_id", "lang")


def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup.with_norm(_docs(spark, sf_dir), norm=normalized_latin(F.col("text")))
    stored, new = docs.filter("source = 'src0'"), docs.filter("source <> 'src0'")
    return dedup.insertable(new, stored, "doc_id").select("doc_id", "source")


def store_norm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``store_insert``, found by the index of a store that two inserts filled instead of by its texts."""
    ensure_checkpoint_dir(spark)
    store = ExampleStore(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    docs = dedup.with_norm(_docs(spark, sf_dir), norm=normalized_latin(F.col("text")))
    first = docs.filter("source = 'src0'").select(
        F.col("doc_id").alias("seq"), "text", "norm", F.array("lang").alias("labels"), labelers.no_spans().alias("spans"), F.lit(Split.TRAIN.value).alias("split")
    )
    for half in (0, 1):
        store.add(first.filter(F.col("seq") % 2 == half), half, "documents")
    new = docs.filter("source <> 'src0'").select("doc_id", "source", "norm").checkpoint()
    return store.index.insertable(new, store.segments(), "doc_id").select("doc_id", "source")


def store_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers at once, whose texts overlap, fill a store: every norm once, under ids of its own."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    docs = dedup.with_norm(_docs(spark, sf_dir), norm=normalized_latin(F.col("text")))
    split = F.when(F.col("doc_id") % 5 == 0, Split.TEST.value).otherwise(Split.TRAIN.value)
    drafts = docs.select(F.col("doc_id").alias("seq"), "text", "norm", F.array("lang").alias("labels"), labelers.no_spans().alias("spans"), split.alias("split"))
    parts = [drafts.filter(F.col("seq") % 3 != k) for k in (0, 1)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: ExampleStore(spark, path).add(rows, 0, "documents"), parts))
    by_norm = ExampleStore(spark, path).rows().withColumn("ids", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return by_norm.groupBy(F.md5("norm").alias("norm_md5")).agg(F.count(F.lit(1)).alias("rows"), F.max("ids").alias("rows_of_id"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``dedup_first_wins`` by a stream of files: the documents arrive in two parts, each to a query that
    starts from the other's checkpoint."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text", F.timestamp_seconds(F.pmod("doc_id", F.lit(86400))).alias("ts"))
    for part in (1, 0):
        docs.filter(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
        arrived = predict.spark_stream(spark, f"{base}/in", "doc_id long, lang string, text string, ts timestamp")
        firsts = predict.first_texts(arrived, "doc_id", "lang", norm=normalized_latin(F.col("text")))
        predict.dedup_stream(firsts, f"{base}/out", f"{base}/state").awaitTermination()
    return predict.streamed_firsts(spark, f"{base}/out").select("doc_id", "lang")


def held_out_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = normalized_latin(F.col("text"))
    held = dedup.with_norm(_table(spark, sf_dir, "benchmark"), norm=norm)
    turns = dedup.with_norm(_table(spark, sf_dir, "conversations"), norm=norm)
    held = held.select("norm").unionByName(turns.select("norm"))
    return dedup.isolated(dedup.with_norm(_docs(spark, sf_dir), norm=norm), held).select("doc_id")


def clean_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    return dedup.clean_seeds(seeds).select("pos", F.length("text").cast("long").alias("chars"))


def prepare_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepared(_docs(spark, sf_dir)).select("text", "source")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.source_stats(prepare.prepared(_docs(spark, sf_dir)))


# --- segmentation and pools ----------------------------------------------------------------------------------------


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(segment.lines(F.col("text"))).alias("line_idx", "line"))
    each = lines.select("doc_id", "line_idx", F.posexplode(segment.sentences(F.col("line"))).alias("sentence_idx", "sentence"))
    return each.filter("sentence <> ''")


def split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.explode_passages(_docs(spark, sf_dir).select("doc_id", "text"), MAX_CHARS)


def pool_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", pools.portable_pool(F.col("text")).alias("pool"))


def pool_assignment_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", pools.pool(F.col("text")).alias("pool"))


def fixed_hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    keyed = _docs(spark, sf_dir).select("doc_id", pools.shuffle_key(F.col("text"), SEED).alias("key"))
    return pools.with_position(keyed, "key", "doc_id").select("doc_id", "position")


def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    placed = pools.with_position(turns, "conv_id", "turn")
    return placed.select("conv_id", "turn", F.floor((F.col("position") - 1) / verify.CHUNK).cast("long").alias("chunk"))


def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _docs(spark, sf_dir).select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), "source").alias("key"))
    return pools.split_train_valid(keyed, "key", SEED).select("doc_id", "split")


# --- weights, quotas, sampling -------------------------------------------------------------------------------------


def normalized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {r["lang"]: float(r["count"]) for r in _docs(spark, sf_dir).groupBy("lang").count().collect()}
    weights = quotas.normalized_weights(spark, LANG_SPEC, {k: v for k, v in counts.items() if k != "es"})
    return weights.select("label", F.round("weight", 12).alias("weight"))


def label_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("weight"))
    weights = counts.select(F.rank().over(_by("lang")).alias("pos"), F.col("lang").alias("label"), "weight")
    return quotas.label_quotas(weights, 777).select("label", "quota")


def _by(column: str):
    return Window.orderBy(column)  # a row for each language


def corpus_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "labels").agg(F.sum("quality").alias("q"), F.sum("toxic").alias("t")).first()
    raw = quotas.weight_frame(spark, {"quality": counts["q"], "toxic": counts["t"]})
    return quotas.corpus_weights(raw, TaskKind.MULTILABEL).select("label", F.round("weight", 12).alias("weight"))


def length_labeler() -> labelers.Labeler:
    """Short, medium or long; abstains on texts with an @."""
    n = F.length("text")
    label = F.when(n < 500, "short").when(n < 2000, "medium").when(n < 6000, "long")
    return labelers.rule(label, F.contains("text", F.lit("@")))


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = length_labeler()(_docs(spark, sf_dir))
    return labeled.select("doc_id", quotas.bucket(F.col("labels"), F.col("spans")).alias("bucket"), "abstained")


def _sampled(spark: SparkSession, sf_dir: str, wanted: dict = QUOTAS, stall_limit: int = sampling.STALL_LIMIT) -> sampling.Sampled:
    ensure_checkpoint_dir(spark)
    docs = _docs(spark, sf_dir).withColumn("pool", pools.portable_pool(F.col("text")))
    ranges = scan.ordered_ranges(docs.select("doc_id", "pool", "text"), "doc_id", first=FIRST_RANGE)
    norm = normalized_latin(F.col("text"))
    seen = dedup.with_norm(_table(spark, sf_dir, "benchmark"), norm=norm).select("norm")
    return sampling.sample_ranges(ranges, length_labeler(), Pool.TRAIN.value, wanted, seen, stall_limit, norm=norm)


def sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).rows.select("doc_id", "bucket")


def sample_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(QUOTAS.items())], "pos int, label string, quota long")
    return quotas.fill_report(wanted, _sampled(spark, sf_dir).rows).select("label", "quota", "filled")


def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _sampled(spark, sf_dir)
    return got.rows.agg(F.count(F.lit(1)).alias("collected")).withColumns({"scanned": F.lit(got.scanned).cast("long"), "stalled": F.lit(got.stalled)})


def sample_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that stalls: it asks for more long texts than there are, and gives up after 20 texts without one."""
    got = _sampled(spark, sf_dir, STALLING, STALL)
    told = {"scanned": F.lit(got.scanned).cast("long"), "stalled": F.lit(got.stalled)}
    return got.rows.select("doc_id", "position", "bucket").withColumns(told)


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents for each turn of a user, drawn without replacement from all but the one with the talk's number."""
    ensure_checkpoint_dir(spark)
    request = F.concat_ws("/", "conv_id", "turn").alias("request")
    turns = _table(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    own = turns.select(request, F.col("conv_id").alias("doc_id")).distinct()
    return draws.drawn(own, "request", _docs(spark, sf_dir), "doc_id", 3, SEED, own)


def cell_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"))
    return generation.sampled_cells(keys, "key", PLAN, SEED)


# --- labeling and verification -------------------------------------------------------------------------------------


def language_rule(text: Column) -> Column:
    """The language with the most stop words; the first in order at a tie."""
    low = F.lower(text)
    counts = F.array(*[F.regexp_count(low, F.lit(rf"(^|[ \n])({STOP_WORDS[n]})[ .,\n]")) for n in LANGS])
    return metrics.argmax_label(list(LANGS), counts)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    label = F.when(F.col("quality") == 1, "good").otherwise("bad")
    return docs.select("doc_id", F.col("doc_id").alias("seq"), "text", "n_chars", F.array(label).alias("labels"), labelers.no_spans().alias("spans"))


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|!]"))


def quality_labeler() -> labelers.Labeler:
    label = F.when(symbols(F.col("text")) > 10, "bad").otherwise("good")
    return labelers.rule(label, F.col("n_chars") < 200)


def consult_labeler(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelers.consulted(_written(spark, sf_dir), quality_labeler())
    return found.select("doc_id", F.get("labels", 0).alias("label"), F.get("written_labels", 0).alias("written"), "outcome")


def labeler_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelers.consulted(_written(spark, sf_dir), quality_labeler())
    counted = verify.agreement(found.withColumn("split", F.when(F.col("n_chars") < 2000, "short").otherwise("long")), "split")
    return counted.withColumn("rate", F.round("rate", 12))


def verify_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("seq"), "text", F.array("lang").alias("labels"), labelers.no_spans().alias("spans"))
    answers = own.select("seq", F.to_json(F.array(language_rule(F.col("text")))).alias("annotated"))
    return verify.matching(own, answers).select("doc_id")


def verification_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelers.consulted(_written(spark, sf_dir), quality_labeler())

    def second(texts: list[str]):
        return [(i, ["good" if t.count("!") < 3 else "bad"], []) for i, t in enumerate(texts)]

    return verify.gate(found, second).select("doc_id", "outcome")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.to_json(signature(F.col("text"), _flags(), labelers.no_spans())).alias("signature"))


def describe_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = labelers.pattern_spans("[0-9]+", "NUMBER")(_docs(spark, sf_dir))
    labels = F.when(F.col("lang") == "en", F.array(F.lit("english"))).otherwise(labelers.no_labels())
    return marked.select("doc_id", describe(F.col("text"), labels, F.col("spans")).alias("described"))


def class_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TaskSpec("Who speaks?", TaskKind.BINARY, (LabelDef("user"), LabelDef("assistant")))
    items = _table(spark, sf_dir, "conversations").withColumn("labels", F.array("role", "role"))
    return spans.class_items(items, spec).select("conv_id", "turn", F.get("labels", 0).alias("label"))


def span_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.regexp_extract("text", r"[^ \n]+", 0)
    items = _docs(spark, sf_dir).select("doc_id", "text", F.array(F.struct(first.alias("text"), F.lit("NUMBER").alias("label"))).alias("quoted"))
    found = spans.span_items(items, DIGIT_SPEC)
    return found.select("doc_id", F.get("spans", 0)["start"].alias("start_at"), F.get("spans", 0)["end"].alias("end_at"))


def locate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several quotes a document: its first words (twice), two that overlap them, and one word wherever it is free."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    pair = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    quotes = [(F.get(words, 1), "b"), (F.get(words, 0), "a"), (F.get(words, 0), "again"), (pair(F.lit(3)), "pair"), (F.get(words, 4), "in")]
    items = F.array(*[F.struct(q.alias("text"), F.lit(label).alias("label")) for q, label in quotes])
    own = _docs(spark, sf_dir).filter(F.size(words) > 5).select("doc_id", spans.located(F.col("text"), items).alias("spans"))
    each = own.select("doc_id", F.col("spans").isNotNull().alias("found"), F.explode_outer("spans").alias("s"))
    return each.select("doc_id", "found", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.label").alias("label"))


# --- spans and tags ------------------------------------------------------------------------------------------------


def _digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelers.pattern_spans("[0-9]+", "NUMBER")(_docs(spark, sf_dir)).filter(F.size("spans") > 0)


def digit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _digits(spark, sf_dir).select("doc_id", F.explode("spans").alias("s"))
    return each.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _digits(spark, sf_dir).withColumn("tokens", spans.character_tokens(F.col("text")))
    return rows.withColumn("tags", spans.bio_tags(F.col("spans"), F.col("tokens")))


def bio_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an inner explode would infer filters on its input, which would tag every text two more times
    each = _tagged(spark, sf_dir).select("doc_id", F.posexplode_outer("tags").alias("pos", "tag"))
    return each.filter(F.col("tag") != spans.OUTSIDE)


def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _tagged(spark, sf_dir).select("doc_id", F.explode(spans.decoded(F.col("text"), F.col("tokens"), F.col("tags"))).alias("s"))
    return back.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.label").alias("label"))


def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", spans.encoded_labels(LANG_SPEC, F.array("lang")).cast("long").alias("class_id"))


def unreachable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _digits(spark, sf_dir)
    lost = spans.unreachable(F.col("text"), F.col("spans"), spans.word_tokens(F.col("text")))
    return rows.select("doc_id", lost.cast("long").alias("unreachable"))


# --- metrics -------------------------------------------------------------------------------------------------------


def _flags() -> Column:
    given = [F.when(F.col(n) == 1, F.lit(n)) for n in FLAG_SPEC.names]
    return F.array_compact(F.array(*given))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("id"), "text", F.array("lang").alias("labels"), F.array(language_rule(F.col("text"))).alias("pred_labels"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id")
    guess = F.array_compact(F.array(
        F.when(symbols(F.col("text")) <= 10, F.lit("quality")), F.when(F.rlike("text", F.lit(rf"\b({TOXIC})\b")), F.lit("toxic")),
    ))
    return docs.select(F.col("doc_id").alias("id"), _flags().alias("labels"), guess.alias("pred_labels"))


def _scores(scores: DataFrame) -> DataFrame:
    rounded = [F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")]
    return scores.select("label", *rounded, F.col("support").cast("long").alias("support"))


def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(metrics.class_scores(_languages(spark, sf_dir), list(LANGS)))


def multiclass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _languages(spark, sf_dir)
    primary = metrics.macro_f1(metrics.class_scores(pairs, list(LANGS)))
    both = primary.crossJoin(metrics.subset_accuracy(pairs))  # a row each
    return both.select(F.round("primary", 12).alias("primary"), F.round("accuracy", 12).alias("accuracy"))


def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(metrics.class_scores(_flagged(spark, sf_dir), FLAG_SPEC.names))


def _span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = labelers.pattern_spans("[0-9]+", "NUMBER")(_docs(spark, sf_dir)).withColumn("gold", F.col("spans"))
    both = labelers.pattern_spans("[0-9][0-9]+", "NUMBER")(gold)
    return both.select(F.col("doc_id").alias("id"), F.col("gold").alias("spans"), F.col("spans").alias("pred_spans"))


def span_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(metrics.span_scores(_span_pairs(spark, sf_dir), DIGIT_SPEC.names))


def error_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors(_flagged(spark, sf_dir), TaskKind.MULTILABEL).select("id")


def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_sample(metrics.errors(_flagged(spark, sf_dir), TaskKind.MULTILABEL), "id").select("id")


def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round for each language: share of labeled-looking texts, one without a validation score."""
    rounds = _docs(spark, sf_dir).groupBy("lang").agg(
        F.min("doc_id").alias("round"), F.round(F.avg((F.col("n_chars") > 1000).cast("double")), 1).alias("primary"),
        F.round(F.avg((F.col("n_chars") > 2000).cast("double")), 3).alias("valid"),
    )
    rounds = rounds.withColumn("valid", F.when(F.col("lang") != "en", F.col("valid")))
    return metrics.best_round(rounds).select("round", "primary")


def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    over = metrics.above_half(list(LANGS), metrics.sigmoid(logits))
    best = metrics.argmax_label(list(LANGS), metrics.softmax(logits))
    return vectors.select("vec_id", best.alias("best"), F.array_join(over, ",").alias("over"))


def store_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    marked = labelers.pattern_spans("[0-9]+", "NUMBER")(labels)
    split = F.when(pools.sha_share(F.col("doc_id").cast("string")) < 0.2, Split.TEST.value).otherwise(Split.TRAIN.value)
    # rows with numbers are span rows, all others label rows
    rows = marked.select(F.when(F.size("spans") > 0, labelers.no_labels()).otherwise(_flags()).alias("labels"), "spans", split.alias("split"))
    return label_counts(rows)


# --- models --------------------------------------------------------------------------------------------------------


def train_predict_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier trained on the train pool, applied to the test pool: predictions as JSON lines."""
    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "text", F.array("lang").alias("labels"), pools.portable_pool(F.col("text")).alias("pool")
    )
    fitted = model.train(LANG_SPEC, rows.filter("pool = 'train'"), TrainConfig("mllib", epochs=1))
    return model.prediction_json(model.predict(LANG_SPEC, fitted, rows.filter("pool = 'test'")))


def train_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss on the validation split after each epoch over all documents, and which epoch's model is kept."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("key"), "text", F.array("lang").alias("labels"))
    split = pools.split_train_valid(rows, "key", SEED)
    train, valid = (split.filter(F.col("split") == s.value) for s in (Split.TRAIN, Split.VALID))
    found = model.train_epochs(LANG_SPEC, train, TrainConfig("mllib", epochs=3), valid, patience=2)
    told = [(i, loss, i == found.best) for i, loss in enumerate(found.losses)]
    return spark.createDataFrame(told, "epoch int, valid_loss double, kept boolean")


def span_tagger_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a tagger trained on the train pool finds in the test pool, with scores."""
    rows = labelers.pattern_spans("[0-9]+", "NUMBER")(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    pooled = rows.withColumn("pool", pools.portable_pool(F.col("text")))
    fitted = model.train(DIGIT_SPEC, pooled.filter("pool = 'train'"), TrainConfig("mllib", epochs=0.3, weight_decay=0.0))
    found = model.predict(DIGIT_SPEC, fitted, pooled.filter("pool = 'test'"))
    each = found.select("id", F.explode(F.arrays_zip(F.col("pred_spans").alias("s"), F.col("span_scores").alias("p"))).alias("x"))
    return each.select(
        F.col("id").alias("doc_id"), F.col("x.s.start").alias("start_at"), F.col("x.s.end").alias("end_at"), F.col("x.s.label").alias("label"),
        F.round("x.p", 6).alias("score"),
    )


_QUERIES = [
    flagship, normalize_text, dedup_first_wins, stream_dedup, store_insert, store_norm_index, store_two_writers, held_out_isolation, clean_seeds, prepare_paragraphs, source_stats,
    split_sentences, split_passages, pool_assignment, pool_assignment_blake, fixed_hash_shuffle, chunk_requests,
    train_valid_split, normalized_weights, label_quotas, corpus_weights, rule_labels, sample_quota, sample_fill_report,
    sample_stats, sample_stall, request_samples, cell_sampling, consult_labeler, labeler_agreement, verify_filter, verification_gate, signatures,
    describe_examples, class_items, span_items, locate_quotes, digit_spans, bio_encode, bio_decode, encode_labels, unreachable_spans,
    multiclass_metrics, multiclass_summary, multilabel_metrics, span_metrics, error_listing, error_sample, best_round,
    decision_rules, store_label_counts, train_predict_language,
    train_best_checkpoint, span_tagger_predictions,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of (spark, sf_dir)."""
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL over the same tables."""
    from textloom.plans.oracles import SQL

    return dict(SQL)
