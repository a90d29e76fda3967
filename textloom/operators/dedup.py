"""First-wins dedup by normalized text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import normalized, strip
from textloom.types import Split

MAX_SEED_CHARS = 200
MAX_SEEDS = 40


def with_norm(rows: DataFrame, text: str = "text", norm: Column | None = None) -> DataFrame:
    """Add ``norm``; a given expression replaces the exact normalization."""
    return rows.withColumn("norm", normalized(F.col(text)) if norm is None else norm)


def digest(norm: str | Column = "norm") -> Column:
    """128 bits that stand for a normalized text, so that no text is a key of a shuffle."""
    return F.unhex(F.md5(norm))


def first_per_norm(rows: DataFrame, order: str = "seq", *also: str) -> DataFrame:
    """Of rows with equal ``norm`` (and ``also``) the first in order, which tells all rows apart.

    Only digests are grouped, combined before the shuffle; groups of several rows are joined back, the rest pass.
    """
    keyed = rows.withColumn("__digest", digest())
    names = ["__digest", *also]
    groups = keyed.groupBy(*names).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    joined = keyed.join(groups, names, "left").filter(F.col("__first").isNull() | (F.col(order) == F.col("__first")))
    return joined.select(*rows.columns)


def not_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose ``norm`` is not among ``seen``'s; null norms are not."""
    known = seen.select(digest().alias("__digest")).distinct()
    return rows.withColumn("__digest", digest()).join(known, "__digest", "left_anti").drop("__digest")


def insertable(rows: DataFrame, stored: DataFrame, order: str = "seq") -> DataFrame:
    """What an insert into a store with unique ``norm`` adds: first of each norm, none that is stored."""
    return first_per_norm(not_seen(rows, stored), order)


def group_dedup(rows: DataFrame, key: Column, text: str = "text", source: str = "source") -> DataFrame:
    """One row a key: the smallest text, and the source of that text (the smallest one at a tie)."""
    return rows.groupBy(key.alias("__key")).agg(
        F.min(text).alias(text), F.min_by(source, F.struct(text, source)).alias(source)
    ).drop("__key")


def shown_texts(store: DataFrame) -> DataFrame:
    """Texts that a prompt may quote: none of the test split."""
    return store.filter(F.col("split") != Split.TEST.value)


def isolated(new: DataFrame, held_out: DataFrame) -> DataFrame:
    """New rows (with ``norm``) that equal no held-out text."""
    return not_seen(new, held_out)


def clean_seeds(seeds: DataFrame, order: str = "pos", text: str = "text") -> DataFrame:
    """Seeds: first of each norm, then 1 to 200 characters, then the first 40 in order."""
    unique = first_per_norm(with_norm(seeds, text), order)
    length = F.length(strip(F.col(text)))
    return unique.filter((length > 0) & (length <= MAX_SEED_CHARS)).orderBy(order).limit(MAX_SEEDS)


def split_notes(notes: Column, marker: str = "EXAMPLES") -> Column:
    """Research notes up to the first line that holds only the marker and decoration."""
    return strip(F.get(F.split(notes, rf"(?m)^\W*{marker}\W*$", 2), 0))


def clean_values(values: Column, least: int = 3, most: int = 8) -> Column:
    """Axis values: stripped, distinct, not blank, at most ``most``; null when fewer than ``least`` are left."""
    kept = F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))
    return F.when(F.size(kept) >= least, F.slice(kept, 1, most))


def clean_axes(axes: DataFrame) -> DataFrame:
    """``name, values`` of the axes that keep enough values."""
    return axes.withColumn("values", clean_values(F.col("values"))).filter("values is not null")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Add ``rank`` from 1 on within an order; for small sets."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(order)))
