"""Periodic runs of words by an all-lag scan.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends keeping the period, at least
``max(MIN_WORDS, MIN_EXP * q)`` words long. The words of a text are an array of hashes; for every lag up to
``n / MIN_EXP`` the array is compared with itself shifted by the lag, and long enough stretches of equal words are runs.

A stretch of ``m`` equal words holds a whole window of ``w`` words among any places ``m - w + 1`` apart. So a lag is
scanned at such places only, by the hash of the window (of 4, 8, 16, ... words, as long as half the stretch allows), for
all texts of a slice at once: a lag ``p`` costs about ``2 / p`` of the words. Places that agree are extended word by
word to the whole stretch, and the words themselves decide. Where a period divides the lag, the run of the period is
the same stretch, so the smallest lag of a stretch is its period.

Texts of up to ``SPLIT_BYTES`` are done where they are read. Ranges of the lags of a longer one are dealt to tasks of
their own; its runs come together again by document.

Defined results: null and empty texts have no words and no runs; a null id is never rewritten (``echoed``); rows with one
id and text have one result; an empty table gives an empty result; ids of any type come back as they are; the
operator takes the columns it needs and adds nothing to others. Equality of words is equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import buckets
from textloom.llm.columns import unused
from textloom.llm.wordcodes import mixed, slices
from textloom.session import ensure_checkpoint_dir

MIN_WORDS, MIN_EXP = 12, 2
#: Bytes of a text from which its lags are dealt to several tasks, and into how many at most.
SPLIT_BYTES, MOST_PARTS = 1 << 16, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)

Rewrite = Callable[[str | None, int], np.ndarray | None]


def echoed(doc_id: str | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a tenth of all documents: from a place on, the next words over and over."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


def _stretch(codes: np.ndarray, at: int, lag: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch around ``at`` whose words equal those ``lag`` further on; texts span ``lo:hi``."""
    a, step = at, 16
    while a > lo:
        from_ = max(lo, a - step)
        differ = np.flatnonzero(codes[from_:a] != codes[from_ + lag : a + lag])
        if len(differ):
            a = from_ + int(differ[-1]) + 1
            break
        a, step = from_, step * 2
    b, step = at, 16
    while b + lag < hi:
        to = min(hi - lag, b + step)
        differ = np.flatnonzero(codes[b:to] != codes[b + lag : to + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = to, step * 2
    return a, b


def _period(codes: np.ndarray, a: int, b: int, lag: int) -> int:
    """The smallest period that divides the lag of a stretch of at least twice the lag."""
    period = lag
    for prime in _primes(lag):
        while period % prime == 0 and np.array_equal(codes[a : b - period // prime], codes[a + period // prime : b]):
            period //= prime
    return period


def _primes(n: int) -> list[int]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + [n] * (n > 1)


def find_runs(
    codes: np.ndarray, first: np.ndarray, part: int = 0, parts: int = 1, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP
) -> np.ndarray:
    """Rows ``text, start, length, period`` of all runs whose period is in a part of the lags.

    Text ``i`` has the words ``codes[first[i]:first[i + 1]]``; texts come longest first. Of several parts, each also tells
    some runs with a smaller period than its lags.
    """
    sizes = np.diff(first)
    lags = int(sizes[0]) // min_exp if len(sizes) else 0
    window, hashes = 1, codes
    runs: set[tuple[int, int, int, int]] = set()
    long_runs: dict[int, list[tuple[int, int, int]]] = {}
    for lag in range(1 + lags * part // parts, 1 + lags * (part + 1) // parts):
        whole = max(min_words, min_exp * lag)
        need = max(whole - lag, 1)
        end = int(first[np.searchsorted(-sizes, -whole, side="right")])
        while window < 4 and window * 2 <= need or window * 4 <= need + 1:
            at = end - 2 * window + 1
            hashes = mixed(hashes[:at] * _STEP + hashes[window : window + at]) if at > 0 else hashes[:0]
            window *= 2
        step = need - window + 1
        places = hashes[: max(0, end - window - lag + 1) : step]
        hits = np.flatnonzero(places == hashes[lag : lag + (len(places) - 1) * step + 1 : step]) if len(places) else places
        done = -1
        for at in (hits * step).tolist() if len(hits) else ():
            if at < done:
                continue
            text = int(np.searchsorted(first, at, side="right")) - 1
            lo, hi = int(first[text]), int(first[text + 1])
            if at + lag + window > hi:
                continue
            known = next((e for q, s, e in long_runs.get(text, ()) if lag % q == 0 and s <= at and at + lag < e), None)
            if known is not None:  # the stretch at this lag is that run
                done = known - lag
                continue
            a, b = _stretch(codes, at, lag, lo, hi)
            done = b
            if b - a + lag < whole:
                continue
            period = _period(codes, a, b + lag, lag)
            runs.add((text, a - lo, b - a + lag, period))
            if b - a + lag >= 2 * min_exp * period:
                long_runs.setdefault(text, []).append((period, a, b + lag))
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)


def _words(texts, ids: list[str | None], rewrite: Rewrite | None):
    """``codes, first, start, end`` of the words of a slice as they are scanned, and the order of its texts."""
    start, end, first = texts.spans()
    codes = texts.hashes(start, end)
    source = np.arange(len(codes))
    for i in range(len(texts)) if rewrite is not None else ():
        own = rewrite(ids[texts.lo + i], int(first[i + 1] - first[i]))
        if own is not None:
            source[first[i] : first[i + 1]] = first[i] + own
    return codes[source], first, start[source], end[source]


def _longest_first(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    spread = np.repeat(first[order] - np.cumsum(sizes[order]) + sizes[order], sizes[order]) + np.arange(len(codes))
    return codes[spread], np.append(0, np.cumsum(sizes[order])), order


_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_TYPES = [*[pa.int64()] * 5, *[pa.string()] * 3, _RUN_TYPE]
_NAMES = [c.split()[0] for c in _FIELDS.split(", ")]


def _result(words: list[bytes], runs: list[tuple[int, int, int]], keep_text: bool) -> tuple:
    """The row of a text: its words as they are scanned, its runs by start and period."""
    told = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for s, k, q in runs:
            change[s + q] += 1
            change[s + k] -= 1
        dropped = (np.cumsum(change)[:-1] > 0).tolist()
        words = [w for w, gone in zip(words, dropped, strict=True) if not gone]
    kept = b" ".join(words)
    exponent = 1000 * best[1] // best[2] if runs else None
    listed = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
    return (len(runs), *best, exponent, told, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None, listed if keep_text else None)


def _whole(rewrite: Rewrite | None, keep_text: bool, min_words: int, min_exp: int):
    """Results of the texts that one task scans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("name").to_pylist(), batch.column("text")
            for texts in slices(column):
                codes, first, start, end = _words(texts, ids, rewrite)
                sorted_codes, sorted_first, order = _longest_first(codes, first)
                found = find_runs(sorted_codes, sorted_first, 0, 1, min_words, min_exp)
                by_text: dict[int, list] = {}
                for text, s, k, q in found.tolist():
                    by_text.setdefault(int(order[text]), []).append((s, k, q))
                data = texts.data.tobytes()
                rows = []
                for i in range(len(texts)):
                    lo, hi = first[i], first[i + 1]
                    words = [data[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
                    rows.append(_result(words, sorted(by_text.get(i, []), key=lambda r: (r[0], r[2])), keep_text))
                ids_out = batch.column("id").slice(texts.lo, len(texts))
                yield pa.RecordBatch.from_arrays([ids_out, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], names=["id", *_NAMES])

    return run


def _range_rows(rewrite: Rewrite | None, min_words: int, min_exp: int):
    """Runs of long texts in one part of their lags, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = batch.column("name").to_pylist(), batch.column("parts").to_pylist()
            found = []
            for texts in slices(batch.column("text"), limit=1):  # one text each
                codes, first, _, _ = _words(texts, names, rewrite)
                runs = find_runs(codes, first, batch.column("part")[texts.lo].as_py(), parts[texts.lo], min_words, min_exp)
                found.append(np.ascontiguousarray(runs[:, 1:]).tobytes())
            columns = [batch.column("name"), batch.column("sum"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "sum", "found"])

    return run


def _joined(rewrite: Rewrite | None, keep_text: bool):
    """Results of long texts from the runs of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, found in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "found")), strict=True):
                words = text.encode().split()
                source = rewrite(name, len(words)) if rewrite is not None else None
                if source is not None:
                    words = [words[i] for i in source.tolist()]
                least: dict[tuple[int, int], int] = {}
                for s, k, q in buckets.joined(found or [], np.int64).reshape(-1, 3).tolist():
                    least[s, k] = min(q, least.get((s, k), q))
                rows.append(_result(words, sorted(((s, k, q) for (s, k), q in least.items()), key=lambda r: (r[0], r[2])), keep_text))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["id", *_NAMES])

    return run


def collapse_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rewrite: Rewrite | None = None,
    keep_text: bool = True,
    min_words: int = MIN_WORDS,
    min_exp: int = MIN_EXP,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """The key and ``n_runs``, the longest run, digests, ``collapsed`` and all ``runs`` for every document.

    ``collapsed`` holds the words outside of runs and the first period of each run; it and ``runs`` are null without
    ``keep_text``. ``rewrite`` gives, for an id as text and a number of words, the word that stands at each place.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    own = docs.select(
        F.col(key).alias("id"), F.col(key).cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    kind = own.schema["id"].dataType.simpleString()
    fields = f"id {kind}, {_FIELDS}"
    size = F.octet_length("text")
    short = own.filter(size < split_bytes).mapInArrow(_whole(rewrite, keep_text, min_words, min_exp), fields)
    # long texts are few rows: equal ones are scanned once, under the digest of their text
    long = own.filter(size >= split_bytes).withColumn("sum", F.md5("text"))
    parts = F.least(F.lit(MOST_PARTS), F.ceil(size / split_bytes) + 1).cast("int")
    once = long.groupBy("name", "sum").agg(F.first("text").alias("text")).withColumn("parts", parts)
    ranges = once.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ranges.repartition(width, "name", "sum", "part").mapInArrow(
        _range_rows(rewrite, min_words, min_exp), "name string, sum string, found binary"
    )
    found = found.groupBy("name", "sum").agg(F.collect_list("found").alias("found"))
    met = long.alias("a").join(found.alias("b"), F.expr("a.name <=> b.name AND a.sum = b.sum"), "left")
    told = met.select("a.id", "a.name", "a.text", "b.found").mapInArrow(_joined(rewrite, keep_text), fields)
    return short.unionByName(told).withColumnRenamed("id", unused(_NAMES, key))


def op13_all_lag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, a tenth of the documents with echoes, and digests of what collapsing leaves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collapse_runs(docs, rewrite=echoed, keep_text=False).drop("collapsed", "runs")
