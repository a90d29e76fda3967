"""Corpus files as documents in file order."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.operators.pools import pool, with_position
from textloom.operators.segment import explode_passages
from textloom.session import ensure_checkpoint_dir


class CorpusError(ValueError):
    """A corpus that cannot be read or gives nothing."""


def corpus_format(path: str) -> str:
    """``txt`` or ``jsonl`` by the last suffix, a ``.gz`` aside."""
    name = PurePosixPath(str(path))
    if name.suffix == ".gz":
        name = name.with_suffix("")
    if name.suffix not in (".txt", ".jsonl"):
        raise CorpusError(f"{path}: expected .txt or .jsonl, also with .gz")
    return name.suffix[1:]


def read_documents(spark: SparkSession, path: str, split_gzip: int = 0) -> DataFrame:
    """``file, line, text``: one document a line, blank lines skipped; ``(file, line)`` is the file order.

    JSON lines need a text; a malformed line is an error. Gzip files are one task each: ``split_gzip`` spreads their
    rows over so many partitions once read.
    """
    kind = corpus_format(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(str(path)).select(*place, F.monotonically_increasing_id().alias("id"), F.col("value"))
    kept = raw.filter(F.length(strip(F.col("value"))) > 0)
    if kind == "jsonl":
        parsed = F.from_json("value", "text string", {"mode": "FAILFAST"})
        text = F.when(parsed["text"].isNull(), F.raise_error(F.lit("a corpus line has no text"))).otherwise(parsed["text"])
        kept = kept.select("file", "block", "id", text.alias("text"))
    else:
        kept = kept.withColumnRenamed("value", "text")
    # ids rise within a task, and a task reads a file's blocks in order
    kept = kept.select("file", F.struct("block", "id").alias("line"), "text")
    return kept.repartition(split_gzip) if split_gzip else kept


def read_passages(spark: SparkSession, path: str, max_chars: int) -> DataFrame:
    """``position, pool, text`` of every passage; the pool is that of the whole document."""
    spread = spark.sparkContext.defaultParallelism if str(path).endswith(".gz") else 0
    docs = read_documents(spark, path, spread).withColumn("pool", pool(F.col("text")))
    each = explode_passages(docs, max_chars)
    return with_position(each, "file", "line", "passage_idx").select("position", "pool", "text")


def stored_passages(spark: SparkSession, path: str, max_chars: int) -> DataFrame:
    """``read_passages`` as Parquet in the shared folder, by position, so that a range of positions reads its own part."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/passages-{uuid.uuid4().hex}"
    read_passages(spark, path, max_chars).write.parquet(folder)
    return spark.read.parquet(folder)


def read_json_texts(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``text, source`` of newline-delimited JSON with an explicit schema; a malformed line is an error."""
    return spark.read.schema("text string").option("mode", "FAILFAST").json(path).select("text", F.lit(source).alias("source"))


def read_parquet_texts(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``text, source`` of Parquet files."""
    return spark.read.parquet(path).select("text", F.lit(source).alias("source"))


def lines_frame(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Non-empty lines (of a terminal or a pipe) as ``seq, text``."""
    kept = [(i, line.rstrip("\r\n")) for i, line in enumerate(lines) if line.strip()]
    return spark.createDataFrame(kept, "seq long, text string")
