"""Substring dedup by fixed-block anchors.

A word is removed when it lies in a window of ``WINDOW`` words whose sequence also starts earlier (in a document with
a smaller id, or earlier in the same document). All windows are judged on the input.

1. Anchors. Every document's non-overlapping blocks of ``WINDOW / 2`` words are the index; every rolling window of
   that length of every document probes it. Two equal windows of ``WINDOW`` words each hold a whole block of their own
   document, and the other one's rolling probes meet it: so a block that no other probe meets lies in no repeat. Probes
   travel as four bytes each, packed in hash buckets (``buckets``).
2. Extension. Around the blocks that were met, all windows of ``WINDOW`` words are hashed with their place; equal
   ones are ordered by place, and all but the first are marked. Marked windows that overlap merge to maximal repeats.
   No pairs are formed, so a passage in a third of all documents costs one entry for each of its places.

Documents whose whole text equals an earlier one are not extended: all their words are covered if they have a window
at all.

Defined results: null and empty texts have no words; texts shorter than a window keep all; rows with one id and one
text are the same document, and neither removes the other; texts that share an id are documents of their own, ordered by
their hash (``sub``, 0 for an id with one text); a null id is after all others; an empty table gives an
empty result; the operator takes the columns it needs and adds nothing to others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import buckets
from textloom.llm.wordcodes import Texts, owners, slices, windows
from textloom.session import ensure_checkpoint_dir

WINDOW = 20
#: Ids and hashes (16 bytes each row) that are broadcast at most.
BROADCAST_IDS = 2_000_000
_LAST = (1 << 63) - 1


def _block_rows(n: int, block: int):
    """Probes and blocks of a slice, one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "sub"))
            for texts in slices(batch.column("text")):
                start, end, first = texts.spans()
                codes, inside = windows(texts.hashes(start, end), first, block)
                place = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
                at = np.flatnonzero(inside)
                codes, place, owner = codes[at], place[at], texts.lo + owners(first)[at]
                rows: list[tuple] = []
                for b, members in buckets.deal(codes, n):
                    aligned = members[place[members] % block == 0]
                    rows.append(
                        (b, buckets.low(codes[members]).tobytes(), buckets.low(codes[aligned]).tobytes(),
                         ids[owner[aligned]].astype(np.int64).tobytes(), subs[owner[aligned]].astype(np.int64).tobytes(),
                         (place[aligned] // block).astype(np.uint32).tobytes())
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCK_TYPES, strict=True)],
                        names=["bucket", "probes", "blocks", "ids", "subs", "places"],
                    )

    return run


_BLOCK_TYPES = [pa.int32(), *[pa.binary()] * 5]
_BLOCK_SCHEMA = "bucket int, probes binary, blocks binary, ids binary, subs binary, places binary"


def _met(table: pa.Table) -> pa.Table:
    """Blocks that a probe other than their own meets."""
    probes = np.sort(buckets.joined(table.column("probes").to_pylist(), np.uint32))
    blocks = buckets.joined(table.column("blocks").to_pylist(), np.uint32)
    count = np.searchsorted(probes, blocks, side="right") - np.searchsorted(probes, blocks, side="left")
    met = count > 1
    ids, subs = (buckets.joined(table.column(c).to_pylist(), np.int64)[met] for c in ("ids", "subs"))
    places = buckets.joined(table.column("places").to_pylist(), np.uint32)[met]
    named = {"id": pa.array(ids, pa.int64()), "sub": pa.array(subs, pa.int64())}
    return pa.table({**named, "place": pa.array(places.astype(np.int64), pa.int64())})


def _candidates(texts: Texts, places: list[list[int]], window: int):
    """Codes, owners and positions of the windows that hold a met block."""
    block = window // 2
    start, end, first = texts.spans()
    n_words = np.diff(first)
    counts = np.array([len(p) for p in places])
    owner = np.repeat(np.arange(len(places)), counts)
    at = np.array([x for p in places for x in p], dtype=np.int64) * block
    spread = (at[:, None] + np.arange(-block, 1)[None]).ravel()
    owner = np.repeat(owner, block + 1)
    fits = (spread >= 0) & (spread + window <= n_words[owner])
    flat = np.unique(first[:-1][owner[fits]] + spread[fits])
    codes = windows(texts.hashes(start, end), first, window)[0][flat]
    whose = np.searchsorted(first, flat, side="right") - 1
    return codes, whose, flat - first[:-1][whose]


def _window_rows(n: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs, places = batch.column("id").to_numpy(), batch.column("sub").to_numpy(), batch.column("places").to_pylist()
            for texts in slices(batch.column("text")):
                codes, whose, position = _candidates(texts, places[texts.lo : texts.hi], window)
                owner = texts.lo + whose
                rows = [
                    (b, codes[m].tobytes(), ids[owner[m]].astype(np.int64).tobytes(), subs[owner[m]].astype(np.int64).tobytes(),
                     position[m].astype(np.uint32).tobytes())
                    for b, m in buckets.deal(codes, n)
                ]
                if rows:
                    kinds = [pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["bucket", "codes", "ids", "subs", "positions"],
                    )

    return run


def _later(table: pa.Table) -> pa.Table:
    """Places of the windows that start earlier elsewhere, packed by document."""
    codes = buckets.joined(table.column("codes").to_pylist(), np.uint64)
    ids, subs = (buckets.joined(table.column(c).to_pylist(), np.int64) for c in ("ids", "subs"))
    positions = buckets.joined(table.column("positions").to_pylist(), np.uint32)
    order = np.lexsort((positions, subs, ids, codes))
    codes, ids, subs, positions = codes[order], ids[order], subs[order], positions[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    late = (ids != ids[head]) | (subs != subs[head]) | (positions != positions[head])
    ids, subs, positions = ids[late], subs[late], positions[late]
    order = np.lexsort((subs, ids))
    ids, subs, positions = ids[order], subs[order], positions[order]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1])])) if len(ids) else np.zeros(0, dtype=np.int64)
    ends = np.append(cut[1:], len(ids))[: len(cut)]
    packed = [positions[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    named = {"id": pa.array(ids[cut], pa.int64()), "sub": pa.array(subs[cut], pa.int64())}
    return pa.table({**named, "late": pa.array(packed, pa.binary())})


_RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
_PENDING = f"{_RESULT}, id long, sub long, text string, places array<long>"


def _finished(names: list[str], window: int, keep_text: bool):
    """Final rows of the texts about which all is known; texts with ``places`` pass through to be extended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = {name: batch.column(i).to_pylist() for i, name in enumerate(names)}
            out: list[tuple] = []
            for i, text in enumerate(row["text"]):
                if row["places"][i] is not None:
                    out.append((row["doc_id"][i], None, None, None, None, row["id"][i], row["sub"][i], text, row["places"][i]))
                    continue
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if row["copy"][i] and len(words) >= window:
                    gone[0] = 1
                elif row["late"][i]:
                    starts = buckets.joined(row["late"][i], np.uint32).astype(np.int64)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                if covered.any():
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                kept = b" ".join(words)
                digest = hashlib.sha256(kept).hexdigest()
                own = kept.decode() if keep_text else None
                out.append((row["doc_id"][i], len(covered), int(covered.sum()), own, digest, row["id"][i], row["sub"][i], None, None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            fields = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "id", "sub", "text", "places"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=fields)

    return run


def dedup_substrings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` for every document; ``kept`` is null without ``keep_text``.

    Texts with met blocks or an earlier copy are shuffled once, to meet what is known of them, and those with met blocks
    are written to be extended. All texts are shuffled instead when the ids of the former are too many to broadcast.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    block = window // 2
    both = ["id", "sub"]
    own = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # ids (null is one) with more than one text: these are told apart by a hash of the text
    told_apart = F.xxhash64("text").alias("sub")
    many = own.select("id", told_apart).groupBy("id").agg(F.min("sub").alias("a"), F.max("sub").alias("b")).filter("a <> b")
    many = many.select("id", F.lit(True).alias("many")).checkpoint()
    if many.count() <= BROADCAST_IDS:
        own = own.join(F.broadcast(many), "id", "left")
        own = own.withColumn("sub", F.when(F.col("many"), told_apart).otherwise(0)).drop("many")
    else:
        own = own.withColumn("sub", told_apart)
    hashed = own.select("id", "sub", F.md5("text").alias("sum"), F.length("text").alias("size"))
    total = hashed.agg(F.sum("size")).first()[0] or 0
    firsts = hashed.groupBy("sum").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.checkpoint()  # small; joined as a table of its own, so a large group of copies can be split
    copies = hashed.join(firsts, "sum").filter("id > first").select("id", "sub", F.lit(True).alias("copy")).distinct()

    rows = own.select("id", "sub", "text").mapInArrow(_block_rows(buckets.n_buckets(total // 4), block), _BLOCK_SCHEMA)
    met = rows.groupBy("bucket").applyInArrow(_met, "id long, sub long, place long")
    met = met.groupBy(both).agg(F.array_sort(F.collect_set("place")).alias("places"))
    about = met.join(copies, both, "full").withColumn("places", F.when(F.col("copy").isNull(), F.col("places")))
    about = about.checkpoint()

    # texts about which nothing is known are finished where they are read; the others move to meet what is known
    names = ["id", "sub", "doc_id", "text", "copy", "late", "places"]
    blank = {"copy": F.lit(None).cast("boolean"), "late": F.lit(None).cast("array<binary>"), "places": F.lit(None).cast("array<long>")}
    ids = about.select(both)
    if about.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
        told = own.join(ids, both, "left_semi").join(about, both).withColumn("late", F.lit(None).cast("array<binary>"))
        plain = own.join(ids, both, "left_anti").withColumns(blank)
    else:
        told = own.join(about, both, "left").withColumn("late", F.lit(None).cast("array<binary>"))
        plain = None
    first = told.select(names).mapInArrow(_finished(names, window, keep_text), _PENDING).checkpoint()
    result = [c.split()[0] for c in _RESULT.split(", ")]
    pending = first.filter("places is not null")
    n_windows = (pending.agg(F.sum(F.size("places")).cast("long")).first()[0] or 0) * block
    found = pending.select("id", "sub", "text", "places").mapInArrow(
        _window_rows(buckets.n_buckets(n_windows), window), "bucket int, codes binary, ids binary, subs binary, positions binary"
    )
    late = found.groupBy("bucket").applyInArrow(_later, "id long, sub long, late binary")
    late = late.groupBy(both).agg(F.collect_list("late").alias("late"))
    marked = pending.drop("places").join(late, both, "left").withColumns(
        {"copy": F.lit(None).cast("boolean"), "places": F.lit(None).cast("array<long>")}
    )
    extended = marked.select(names).mapInArrow(_finished(names, window, keep_text), _PENDING)
    found = first.filter("places is null").select(result).unionByName(extended.select(result))
    if plain is None:
        return found
    quiet = plain.select(names).mapInArrow(_finished(names, window, keep_text), _PENDING)
    return found.unionByName(quiet.select(result))


def op10_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 20 words and more leave of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
