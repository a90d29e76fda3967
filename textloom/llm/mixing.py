"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words: its share of all words by weight, at most ``max_repeat`` times what it
has, the excess shared anew by weight. A document of a source with rate ``r = target / source words`` is taken
``floor(r)`` times for certain and once more with probability ``r - floor(r)``. Which documents get the extra copy
is drawn by the cube method: the vector of probabilities moves through the null-space of the balancing constraints
(number of documents, number of words) until all but two documents of a block are decided. The undecided ones of
all blocks of a source meet in the next level, and the last two of a source are landed by giving up the word
constraint first, then the document constraint.

Blocks hold about ``BLOCK`` documents each, whatever the source, so a source with a third of all rows is many
blocks. Each level passes on two rows a block. All draws come from the source's name and the block number: reruns
agree, and a lost task repeats its draws.

Defined results: null and empty texts have size 0 and take 0 words; a null source is a source of its own, ranked
last; a source without words has target 0; repeated rows are documents of their own; an empty table gives an empty
result. Ids and sources of any type keep their exact values. Other columns of the input are not touched, whatever their
names (``mix`` selects what it needs, ``take`` adds none).
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.columns import unused
from textloom.operators.pools import with_position
from textloom.session import ensure_checkpoint_dir

#: Documents in a block of the flight phase, on average.
BLOCK = 1000
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target, n_docs`` with a row for each source.

    The level (words for a unit of weight) rises in rounds: sources whose cap it reaches stop there, all others share
    what these leave. Sources may be many: they are numbered by a distributed sort, and a round is one aggregate.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    numbered = with_position(totals.withColumn("__last", F.col("source").isNull()), "__last", "source")
    at = F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int")
    ranked = numbered.select(
        "source", "source_size", "n_docs", F.get(F.array(*map(F.lit, weights)), at).alias("weight"),
        (F.col("source_size") * max_repeat).cast("double").alias("cap"),
    ).checkpoint()
    level, capped = -1.0, -1
    while True:
        stops = F.col("cap") <= F.col("weight") * level
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.count(F.when(stops, 1)).alias("capped"),
            F.sum(F.when(stops, F.col("cap")).otherwise(0.0)).alias("caps"),
            F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if row["capped"] == capped or not row["weights"]:
            break
        capped, level = row["capped"], (row["all"] - row["caps"]) / row["weights"]
    target = F.least("cap", F.col("weight") * level)
    return ranked.select("source", "source_size", target.alias("target"), "n_docs")


def null_direction(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """A direction that moves the first unit and keeps the sum and the size-weighted sum of all.

    The other units share the compensation, those with chances near one half most. If the others all have one
    size and the first has not, two of the others move against each other.
    """
    both = np.stack([np.ones_like(sizes), sizes / max(sizes[0], 1.0)])
    spread = chances[1:] * (1 - chances[1:])
    rest = both[:, 1:]
    share = np.linalg.pinv((rest * spread) @ rest.T, rcond=1e-12) @ both[:, 0]
    u = np.concatenate([[1.0], -spread * (rest.T @ share)])
    if np.abs(both @ u).max() > 1e-7:
        u = np.zeros_like(sizes)
        u[-2:] = 1.0, -1.0
    return u


def flight(sizes: list[float], chances: list[float], rng: random.Random, land: bool) -> np.ndarray:
    """Move ``chances`` to 0 or 1, keeping their sum and their sum weighted by ``sizes``.

    The largest undecided document moves in each step and all others make up for it, so large documents are
    decided while there are many to balance them. At most two, the smallest, stay undecided, or none with
    ``land``.
    """
    sizes, out = np.asarray(sizes, dtype=float), np.array(chances, dtype=float)
    open_ = np.argsort(-sizes, kind="stable")
    open_ = open_[(out[open_] > EPS) & (out[open_] < 1 - EPS)]
    while len(open_):
        p = out[open_]
        if len(open_) > 2:
            u = null_direction(sizes[open_], p)
        elif len(open_) == 2 and (land or sizes[open_[0]] == sizes[open_[1]]):
            u = np.array([1.0, -1.0])
        elif len(open_) == 1 and land:
            u = np.array([1.0])
        else:
            break
        moves = np.abs(u) > 1e-12
        to_one, to_zero = ((1 - p[moves]) / np.abs(u[moves])), (p[moves] / np.abs(u[moves]))
        positive = u[moves] > 0
        up, down = np.where(positive, to_one, to_zero).min(), np.where(positive, to_zero, to_one).min()
        p = p + u * (up if rng.random() * (up + down) < down else -down)
        p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
        out[open_] = p
        open_ = open_[(p > 0) & (p < 1)]
    return out


def _fly(level: int, last: bool):
    def run(frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values(["size", "row_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        name, block = frames["source"].iloc[0], int(frames["block"].iloc[0])
        seed = zlib.crc32(f"{'' if name is None else 's' + str(name)}|{level}|{block}".encode())
        frames["chance"] = flight(frames["size"], frames["chance"], random.Random(seed), last)
        return frames

    return run


def level_blocks(largest: int, block: int = BLOCK) -> Iterator[int]:
    """How many documents a block stands for at each level, up to the level at which a source is one block."""
    span = block
    while span < largest:
        yield span
        span *= block // 2
    yield span


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, row_key`` for every document.

    ``row_key`` hashes id, source and text.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    kinds = dict(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source")).dtypes)
    # as text: pandas would make floats of whole numbers beside nulls
    sized = docs.select(
        F.col(key).cast("string").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size"),
        F.xxhash64(key, source, text).alias("row_key"),
    )
    targets = source_targets(sized, weights, max_repeat).checkpoint()
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.least(rate, F.lit(float(max_repeat)))
    state = (
        sized.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", "d.row_key", "t.source_size", "t.target", "t.n_docs", rate.alias("rate"))
        .withColumn("whole", F.floor(F.col("rate") + EPS).cast("long"))
        .withColumn("chance", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    )
    spans, done = list(level_blocks(largest, block)), []
    for level, span in enumerate(spans):
        last = level == len(spans) - 1
        n_blocks = F.greatest(F.ceil(F.col("n_docs") / span), F.lit(1)).cast("long")
        number = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("doc_id", "row_key", F.lit(level)), n_blocks)
        blocked = state.withColumn("block", number)
        # one key for a block: two would let Spark keep all blocks of a source in the source's partition
        blocked = blocked.withColumn("unit", F.struct("source", "block"))
        state = blocked.groupBy("unit").applyInPandas(_fly(level, last), blocked.schema).drop("block", "unit")
        if not last:
            state = state.checkpoint()
            undecided = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
            done.append(state.filter(~undecided))
            state = state.filter(undecided)
    for part in done:
        state = state.unionByName(part)
    copies = (F.col("whole") + F.when(F.col("chance") > 0.5, 1).otherwise(0)).cast("long")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    own = [F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]
    return state.withColumn("copies", copies).select(*own, "size", "source_size", "target", "copies", taken, "row_key")


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Rows that agree in id, source and text share their copies evenly.
    """
    row, copies, rows, own = (unused(docs.columns, f"__{n}") for n in ("row", "copies", "rows", "own"))
    drawn = mix(docs, key, text, source, **options)
    totals = drawn.groupBy(F.col("row_key").alias(row)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    keyed = docs.withColumn(row, F.xxhash64(key, source, text)).join(totals.filter(F.col(copies) > 0), row)
    rank = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1)))
    whole = F.floor(F.col(copies) / F.col(rows)).cast("int")
    counted = keyed.withColumn(own, whole + F.when(rank <= F.col(copies) % F.col(rows), 1).otherwise(0)).filter(F.col(own) > 0)
    return counted.withColumn(rows, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*docs.columns)


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; weights 5, 2, 1 over the sources in order."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
