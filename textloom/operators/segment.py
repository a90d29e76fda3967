"""Segmentation: documents to lines, sentences and passages, all by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import LINE_END, WS, strip

MIN_PASSAGE_CHARS = 10
#: A sentence ends after these marks (fixed values) unless another mark or a closing bracket follows, or after a full
#: stop before white space.
MARKS = "。．！？!?"
CLOSERS = "」』）)\\]"
SENTENCE_END = rf"(?<=[{MARKS}])(?![{MARKS}{CLOSERS}])|(?<=\.)(?=[{WS}])"


def lines(text: Column) -> Column:
    """Stripped lines of a text."""
    return F.transform(F.split(text, LINE_END), strip)


def sentences(line: Column) -> Column:
    """Sentences of a line, nothing lost."""
    return F.split(line, SENTENCE_END)


def packed(parts: Column, max_chars: int) -> Column:
    """Consecutive sentences joined to passages of at most ``max_chars``; longer sentences are cut hard."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(part) <= max_chars
        last = F.greatest(F.ceil(F.length(part) / max_chars) - 1, F.lit(0)).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(part, i * max_chars + 1, F.lit(max_chars))
        )
        done = F.concat(acc["out"], F.array(acc["now"]), F.slice(pieces, F.lit(1), last))
        return F.struct(
            F.when(fits, acc["out"]).otherwise(done).alias("out"),
            F.when(fits, F.concat(acc["now"], part)).otherwise(F.element_at(pieces, -1)).alias("now"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))


def cut(line: Column, max_chars: int) -> Column:
    """``packed(sentences(line))`` without its empty passages, by one pattern.

    The longest part of at most ``max_chars`` that ends where a sentence does is what packing makes of whole sentences; where
    no sentence ends so soon, ``max_chars`` are cut off. A line that is short enough is a passage as it is.
    """
    pattern = rf"(?s).{{1,{max_chars}}}(?:{SENTENCE_END}|\z)|.{{{max_chars}}}"
    return F.when(F.length(line) <= max_chars, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))


def passages(text: Column, max_chars: int, min_chars: int = MIN_PASSAGE_CHARS) -> Column:
    """All passages of a text, in order, that keep ``min_chars`` (at least one) after stripping."""
    each = F.flatten(F.transform(lines(text), lambda line: cut(line, max_chars)))
    return F.filter(F.transform(each, strip), lambda p: F.length(p) >= max(1, min_chars))


def explode_passages(docs: DataFrame, max_chars: int, text: str = "text", order: str = "doc_seq") -> DataFrame:
    """A row for each passage: all columns of ``docs`` but the text, ``passage_idx`` and ``text``."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(passages(F.col(text), max_chars)).alias("passage_idx", "text"))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line feed separated paragraph, stripped of white space and ideographic spaces."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(F.split(text, "\n")).alias("__p")).select(
        *rest, strip(F.col("__p")).alias("text")
    )
