"""Suffix-array dedup with a logarithmic family of indexes.

A byte is removed when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. All
strings are judged on the input; documents that only repeat themselves keep all.

1. Anchors. Of every string of ``LENGTH`` bytes, the part of ``LENGTH / 2`` bytes with the smallest hash (leftmost of
   equals) is its anchor, so equal strings have equal anchors at equal places; about one byte in 13 starts one. Hashes
   of anchors, four bytes each, are dealt to buckets (``buckets``), which tell those that two documents share. An anchor
   that several documents of one slice of texts share is known there, and the slice sends one entry for all of them.
2. Suffixes. Strings that have one anchor in a run of places make a piece of text. Pieces with shared anchors are
   dealt to buckets by the anchor. A bucket takes its documents by id in batches. Each batch gets the sorted array of
   its suffixes, cut at ``LENGTH`` bytes, and is merge-scanned: against itself and against the levels, which hold the
   suffixes of all earlier batches. What is new becomes a level; two levels of equally many batches merge to one, so
   there are as many levels as the number of batches has binary digits, and a suffix is merged as often.
   No pairs are formed. Of pieces with one content a slice sends those of its smallest id, the others are removed there.
   Pieces of the anchors that most slices share (over ``HOT`` entries) are dealt string by string instead.
3. Removed runs come back to the documents, overlapping ones as one.

Documents whose whole text equals an earlier one's take no part: all their bytes are covered if there are ``LENGTH``.

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` keep all; rows with one id do not
remove each other, whatever their texts, and rows with one id and text have one result; a null id is after all others
(ids are integers below 2^63 - 1), and null ids are equal; an empty table gives an empty result; the operator takes the
columns it needs and adds nothing to others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import buckets
from textloom.llm.wordcodes import Texts, mixed, slices
from textloom.session import ensure_checkpoint_dir

LENGTH = 50
#: Anchors of a bucket, and pieces of one, about.
ANCHORS, PIECES = 2_000_000, 60_000
#: Pieces of a batch, at least; more where they share an id.
BATCH = 4_000
#: Entries (slices or documents) from which an anchor is dealt by its strings; the most frequent ``HOT_CODES`` are.
HOT, HOT_CODES = 100_000, 100_000
#: Bytes of a table that is broadcast, at most.
BROADCAST_BYTES = 24 << 20
_LAST = (1 << 63) - 1
_RUN = 1 << 17
_PLACE = np.uint64((1 << 18) - 1)


def _pieces(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``start, count, code, owner``: runs of strings with one anchor, its hash and their text.

    The slice is worked through in runs of ``_RUN`` bytes; a piece that a run cuts is two pieces with one code.
    """
    part = length // 2
    width = length - part + 1
    begin = texts.off[:-1]
    stop = np.maximum(texts.off[1:] - length + 1, begin)
    found = []
    for lo in range(0, len(texts.data) - length + 1, _RUN):
        hi = min(lo + _RUN, len(texts.data) - length + 1)
        code = _rolling(texts.data[lo : hi + length - 1], part)
        least = (code & ~_PLACE) | np.arange(len(code), dtype=np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        anchor = (least & _PLACE).astype(np.int64)
        change = np.zeros(hi - lo + 1, dtype=np.int64)
        a, b = np.clip(begin, lo, hi) - lo, np.clip(stop, lo, hi) - lo
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
        valid = np.cumsum(change)[:-1] > 0
        new = np.ones(hi - lo, dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        new[a[a < hi - lo]] = True
        starts = np.flatnonzero(new & valid)
        bounds = np.flatnonzero(np.append(new | ~valid, True))
        ends = bounds[np.searchsorted(bounds, starts, side="right")]
        found.append((lo + starts, ends - starts, mixed(code[anchor[starts]])))  # least hashes are small ones: spread them
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none
    start, count, code = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, count, code, np.searchsorted(texts.off, start, side="right") - 1


_POWERS = np.cumprod(np.append(np.uint64(1), np.full(_RUN + 4096, 0x9E3779B97F4A7C15, dtype=np.uint64)))
_INVERSES = np.cumprod(np.append(np.uint64(1), np.full(_RUN + 4096, pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=np.uint64)))


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes of a run."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _INVERSES[: len(data) - width + 1])


def _packed(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.ones(len(keys[0]) + 1, dtype=bool)
    if len(keys[0]):
        new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(new)
    return np.zeros(1, dtype=np.int64)


_ANCHOR_ROWS = "bucket int, codes binary, uids binary, counts binary, many binary"
_ANCHOR_TYPES = [pa.int32(), *[pa.binary()] * 4]


def _anchor_rows(n: int, length: int):
    """Anchors of a slice, one row for each bucket; those that are known to be shared in a row of their own.

    Buckets from ``n`` on pass through what is known: ``uids`` with ``counts`` codes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for texts in slices(batch.column("text")):
                _, _, code, owner = _pieces(texts, length)
                whose = uids[texts.lo + owner] if len(owner) else np.zeros(0, dtype=np.int64)
                order = np.lexsort((whose, code))
                code, whose = code[order], whose[order]
                one = _runs(code, whose)[:-1]
                code, whose = code[one], whose[one]
                cuts = _runs(code)
                several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
                rows = _by_bucket(code, whose, ~several, code[cuts[:-1]][np.diff(cuts) > 1], n)
                order = np.argsort(whose[several], kind="stable")
                known, own = code[several][order], whose[several][order]
                if len(known):
                    ends = _runs(own)
                    keys = _key(known, n).tobytes()
                    rows.append((n + int(own[0]) % n, keys, own[ends[:-1]].tobytes(), np.diff(ends).astype(np.uint32).tobytes(), b""))
                if rows:
                    yield _packed(rows, _ANCHOR_TYPES, ["bucket", "codes", "uids", "counts", "many"])

    return run


def _by_bucket(code: np.ndarray, whose: np.ndarray, single: np.ndarray, many: np.ndarray, n: int) -> list[tuple]:
    code, whose = code[single], whose[single]
    order = np.argsort(whose, kind="stable")
    code, whose = code[order], whose[order]
    shared = {b: buckets.low(many[at]).tobytes() for b, at in buckets.deal(many, n)}
    rows = []
    for b, at in buckets.deal(code, n):
        ends = _runs(whose[at])
        counts = np.diff(ends).astype(np.uint32).tobytes()
        rows.append((b, buckets.low(code[at]).tobytes(), whose[at][ends[:-1]].tobytes(), counts, shared.pop(b, b"")))
    return rows + [(b, b"", b"", b"", m) for b, m in shared.items()]


def _key(code: np.ndarray, n: int) -> np.ndarray:
    """A code as it is known by its bucket."""
    bucket = ((code >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (code & np.uint64(0xFFFFFFFF))


_MET = "uid long, codes binary, entries long"


def _shared(n: int, hot: int):
    """Anchors of documents that other documents hold too; with no ``uid``, frequent ones and their entries."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        codes = table.column("codes").to_pylist()
        uids, counts = buckets.joined(table.column("uids").to_pylist(), np.int64), buckets.joined(table.column("counts").to_pylist(), np.uint32)
        rows: list[tuple] = []
        if bucket >= n:
            keys = buckets.joined(codes, np.uint64)
            whose = np.repeat(uids, counts)
        else:
            low, many = buckets.joined(codes, np.uint32), buckets.joined(table.column("many").to_pylist(), np.uint32)
            whose = np.repeat(uids, counts)
            order = np.lexsort((whose, low))
            low, whose = low[order], whose[order]
            cuts = _runs(low)
            first, size = cuts[:-1], np.diff(cuts)
            known, times = np.unique(many, return_counts=True)
            at = np.searchsorted(known, low[first])
            at[at == len(known)] = 0
            more = np.where(known[at] == low[first], times[at], 0) if len(known) else np.zeros(len(first), dtype=np.int64)
            met = (more > 0) | (whose[first] != whose[cuts[1:] - 1]) if len(first) else np.zeros(0, dtype=bool)
            total = dict(zip(known[times >= hot].tolist(), times[times >= hot].tolist(), strict=True))
            frequent = size + more >= hot
            total |= dict(zip(low[first][frequent].tolist(), (size + more)[frequent].tolist(), strict=True))
            rows = [(None, np.uint64((bucket << 32) | c).tobytes(), entries) for c, entries in total.items()]
            kept = np.repeat(met, size)
            keys, whose = (low[kept].astype(np.uint64) | np.uint64(bucket << 32)), whose[kept]
        order = np.argsort(whose, kind="stable")
        keys, whose = keys[order], whose[order]
        ends = _runs(whose)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            rows.append((int(whose[a]), keys[a:b].tobytes(), None))
        return pa.Table.from_batches([_packed(rows, [pa.int64(), pa.binary(), pa.int64()], ["uid", "codes", "entries"])])

    return run


_PIECE_ROWS = "bucket int, data binary, ords binary, counts binary, times binary, subs binary, places binary, ends binary"
_PIECE_NAMES = [c.split()[0] for c in _PIECE_ROWS.split(", ")]
_PIECE_TYPES = [pa.int32(), *[pa.binary()] * 7]


def _piece_rows(n_anchors: int, n: int, length: int, hot: np.ndarray):
    """Pieces whose anchor is shared, one row for each bucket; runs that the slice itself removes from bucket ``n`` on.

    A piece is its bytes, the id and the number of strings; ``times`` counts the places (``subs``, ``places``) it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, subs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "sub"))
            about = batch.column("codes").to_pylist()
            for texts in slices(batch.column("text")):
                start, count, code, owner = _pieces(texts, length)
                met = [buckets.joined(c or [], np.uint64) for c in about[texts.lo : texts.hi]]
                seen = np.repeat(np.arange(len(met)), [len(m) for m in met])
                wanted = np.sort(mixed(np.concatenate(met) + mixed(seen.astype(np.uint64))))
                key = _key(code, n_anchors)
                if not len(wanted) or not len(key):
                    continue
                asked = mixed(key + mixed(owner.astype(np.uint64)))
                at = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
                meets = wanted[at] == asked
                start, count, code, owner = start[meets], count[meets], code[meets], owner[meets]
                if len(hot):
                    start, count, code, owner = _split(texts, start, count, code, owner, np.isin(key[meets], hot), length)
                rows = _placed(texts, start, count, code, ords[texts.lo + owner], subs[texts.lo + owner], n, length)
                if rows:
                    yield _packed(rows, _PIECE_TYPES, _PIECE_NAMES)

    return run


def _split(texts: Texts, start, count, code, owner, frequent: np.ndarray, length: int):
    """Pieces of frequent anchors string by string, each with its own hash as code."""
    times = count[frequent]
    begin = np.repeat(start[frequent], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    rest = ~frequent
    parts = [
        (start[rest], begin),
        (count[rest], np.ones(len(begin), dtype=np.int64)),
        (code[rest], texts.hashes(begin, begin + length)),
        (owner[rest], np.repeat(owner[frequent], times)),
    ]
    start, count, code, owner = (np.concatenate(p) for p in parts)
    order = np.argsort(start, kind="stable")
    return start[order], count[order], code[order], owner[order]


def _placed(texts: Texts, start, count, code, ords, subs, n: int, length: int) -> list[tuple]:
    """Rows of the pieces of a slice; of pieces with one content those of the smallest id are sent."""
    place = start - texts.off[np.searchsorted(texts.off, start, side="right") - 1]
    content = texts.hashes(start, start + count + (length - 1))
    order = np.lexsort((place, subs, ords, content))
    start, count, code, place, ords, subs, content = (x[order] for x in (start, count, code, place, ords, subs, content))
    cuts = _runs(content)
    least = np.repeat(ords[cuts[:-1]], np.diff(cuts))
    later = ords > least
    rows: list[tuple] = []
    if later.any():
        known = _maximal(ords[later], subs[later], place[later], (place + count)[later] + (length - 1))
        o, s, lo, hi = (x.astype(t).tobytes() for x, t in zip(known, (np.int64, np.int64, np.uint32, np.uint32), strict=True))
        rows.append((n + int(known[1][0]) % n, b"", o, b"", b"", s, lo, hi))
    start, count, code, place, ords, subs, content = (x[~later] for x in (start, count, code, place, ords, subs, content))
    cuts = _runs(content)
    first, times = cuts[:-1], np.diff(cuts)
    for b, at in buckets.deal(code[first], n):
        sizes = count[first[at]] + (length - 1)
        spread = np.repeat(start[first[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        entries = np.repeat(first[at] - np.cumsum(times[at]) + times[at], times[at]) + np.arange(times[at].sum())
        rows.append(
            (b, texts.data[spread].tobytes(), ords[first[at]].astype(np.int64).tobytes(), count[first[at]].astype(np.uint16).tobytes(),
             times[at].astype(np.uint32).tobytes(), subs[entries].astype(np.int64).tobytes(), place[entries].astype(np.uint32).tobytes(), b"")
        )
    return rows


class Levels:
    """Sorted arrays of the suffixes of earlier batches; two of equally many batches merge to one."""

    def __init__(self) -> None:
        self.family: list[tuple[int, np.ndarray]] = []

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct ``keys`` some level holds; the keys are scanned along each level."""
        found = np.zeros(len(keys), dtype=bool)
        for _, level in self.family:
            at = np.searchsorted(level, keys)
            at[at == len(level)] = 0
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        """One more batch: sorted keys that no level holds."""
        rank = 1
        while self.family and self.family[-1][0] == rank:
            # a stable sort of two sorted arrays merges them in one pass
            keys = np.sort(np.concatenate([self.family.pop()[1], keys]), kind="stable")
            rank *= 2
        if len(keys):
            self.family.append((rank, keys))


def _suffixes(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of the pieces that begin at ``first``, and their pieces."""
    piece = np.repeat(np.arange(len(first)), count)
    begin = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[begin]
    return np.ascontiguousarray(strings).view(f"S{length}").ravel(), piece


def _family(n: int, length: int, batch: int):
    """Removed runs of the documents of a bucket, packed by document."""

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in _PIECE_NAMES[1:]}
        ords, subs = (buckets.joined(column[c], np.int64) for c in ("ords", "subs"))
        places = buckets.joined(column["places"], np.uint32).astype(np.int64)
        if table.column("bucket")[0].as_py() >= n:
            return _spans(ords, subs, places, buckets.joined(column["ends"], np.uint32).astype(np.int64))
        count = buckets.joined(column["counts"], np.uint16).astype(np.int64)
        times = buckets.joined(column["times"], np.uint32).astype(np.int64)
        data = buckets.joined(column["data"], np.uint8)
        del column
        begin = np.cumsum(count + length - 1) - (count + length - 1)
        entry = np.cumsum(times) - times
        order = np.argsort(ords, kind="stable")
        ids = ords[order]
        edges = _runs(ids)
        levels = Levels()
        gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(order):
            hi = int(edges[np.searchsorted(edges, min(lo + batch, len(order)))])  # a batch ends where an id ends
            members = order[lo:hi]
            strings, piece = _suffixes(data, begin[members], count[members], length)
            rank = np.argsort(strings, kind="stable")
            sorted_strings = strings[rank]
            cuts = _runs(sorted_strings)
            heads = cuts[:-1]
            old = levels.holds(sorted_strings[heads])
            owner = ids[lo:hi][piece[rank]]
            late = np.repeat(old, np.diff(cuts)) | (owner > np.repeat(owner[heads], np.diff(cuts)))
            levels.add(sorted_strings[heads][~old])
            removed = np.zeros(len(strings), dtype=bool)
            removed[rank] = late
            change = np.ones(len(strings) + 1, dtype=bool)
            change[1:-1] = (removed[1:] != removed[:-1]) | (piece[1:] != piece[:-1])
            bounds = np.flatnonzero(change)
            runs, ends = bounds[:-1][removed[bounds[:-1]]], bounds[1:][removed[bounds[:-1]]]
            head = np.cumsum(count[members]) - count[members]
            gone.append((members[piece[runs]], runs - head[piece[runs]], ends - head[piece[runs]] + length - 1))
            lo = hi
        if not gone:
            return _spans(ords[:0], subs[:0], places[:0], places[:0])
        which, a, b = (np.concatenate(x) for x in zip(*gone, strict=True))
        each = times[which]
        at = np.repeat(entry[which] - np.cumsum(each) + each, each) + np.arange(each.sum())
        return _spans(np.repeat(ords[which], each), subs[at], places[at] + np.repeat(a, each), places[at] + np.repeat(b, each))

    return run


_SPANS = "ord long, sub long, spans binary"


def _maximal(ords: np.ndarray, subs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs by document, overlapping and adjacent ones as one."""
    order = np.lexsort((lo, subs, ords))
    ords, subs, lo, hi = ords[order], subs[order], lo[order], hi[order]
    if not len(ords):
        return ords, subs, lo, hi
    cuts = _runs(ords, subs)
    shift = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64) << 32, np.diff(cuts))
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return ords[first], subs[first], lo[first], reach[last] - shift[last]


def _spans(ords: np.ndarray, subs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """Maximal runs packed by document, as ``start, end`` in turn."""
    ords, subs, lo, hi = _maximal(ords, subs, lo, hi)
    pairs = np.stack([lo, hi], axis=1).astype(np.uint32).tobytes()
    cuts = _runs(ords, subs)
    packed = [pairs[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    named = {"ord": pa.array(ords[cuts[:-1]], pa.int64()), "sub": pa.array(subs[cuts[:-1]], pa.int64())}
    return pa.table({**named, "spans": pa.array(packed, pa.binary())})


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document that several buckets found, as one list."""
    for batch in batches:
        ords, subs = (batch.column(c).to_numpy() for c in ("ord", "sub"))
        found = [buckets.joined(f, np.uint32) for f in batch.column("spans").to_pylist()]
        size = [len(f) // 2 for f in found]
        pairs = np.concatenate(found).reshape(-1, 2).astype(np.int64) if found else np.zeros((0, 2), dtype=np.int64)
        yield from _spans(np.repeat(ords, size), np.repeat(subs, size), pairs[:, 0], pairs[:, 1]).to_batches()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
_RESULT_TYPES = [*[pa.int64()] * 4, pa.binary(), pa.string()]


def _finished(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "spans")), strict=True):
                data = text.encode()
                if copy and len(data) >= length:
                    cut = [(0, len(data))]
                else:
                    cut = [] if copy or spans is None else np.frombuffer(spans, dtype=np.uint32).reshape(-1, 2).tolist()
                removed = sum(b - a for a, b in cut)
                if cut:
                    bounds = [0, *(x for span in cut for x in span), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                else:
                    kept = data
                out.append((doc, len(data), removed, len(cut), kept if keep_text else None, hashlib.sha256(kept).hexdigest()))
            yield _packed(out, _RESULT_TYPES, [c.split()[0] for c in _RESULT.split(", ")])

    return run


def _small(table: DataFrame, column: str) -> bool:
    """Whether a table of ids and bytes may be broadcast."""
    row = table.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 64).alias("n")).first()
    return (row["n"] or 0) <= BROADCAST_BYTES


def dedup_suffixes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = True
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every document.

    ``n_spans`` counts the maximal removed runs; ``kept`` holds the remaining bytes, which may cut through a code point,
    and is null without ``keep_text``. Texts move once, to meet what is known of their anchors, and once more to meet
    their removed runs; tables of up to ``BROADCAST_BYTES`` are broadcast to them instead.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    both = ["ord", "sub"]
    own = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("ord"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("sub", F.xxhash64("text"))
    own = own.withColumn("uid", F.xxhash64("ord", "sub"))
    hashed = own.select("ord", "sub", F.md5("text").alias("sum"), F.octet_length("text").cast("long").alias("size"))
    total = hashed.agg(F.sum("size")).first()[0] or 0
    firsts = hashed.groupBy("sum").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").checkpoint()
    copies = hashed.join(firsts, "sum").filter("ord > first").select(*both, F.lit(True).alias("copy")).distinct().checkpoint()
    copies_known = F.broadcast(copies) if copies.count() * 96 <= BROADCAST_BYTES else copies
    rest = own.join(copies_known, both, "left_anti").filter(F.octet_length("text") >= length)

    n_anchors = max(24, -(-total // (13 * ANCHORS)))
    anchors = rest.select("uid", "text").mapInArrow(_anchor_rows(n_anchors, length), _ANCHOR_ROWS)
    told = anchors.groupBy("bucket").applyInArrow(_shared(n_anchors, HOT), _MET).checkpoint()
    hot = told.filter("uid is null").orderBy(F.desc("entries"), "codes").limit(HOT_CODES).select("codes").collect()
    hot_keys = np.sort(buckets.joined([r["codes"] for r in hot], np.uint64))
    met = told.filter("uid is not null").groupBy("uid").agg(F.collect_list("codes").alias("codes"))
    n_met = (told.filter("uid is not null").agg(F.sum(F.octet_length("codes").cast("long"))).first()[0] or 0) // 8
    n_pieces = max(48, -(-n_met // PIECES))
    if n_met * 8 + told.count() * 64 <= BROADCAST_BYTES:
        met = F.broadcast(met)
    asked = rest.join(met, "uid").select("ord", "sub", "text", "codes")
    pieces = asked.mapInArrow(_piece_rows(n_anchors, n_pieces, length, hot_keys), _PIECE_ROWS)
    spans = pieces.groupBy("bucket").applyInArrow(_family(n_pieces, length, BATCH), _SPANS)
    spans = spans.groupBy(both).agg(F.collect_list("spans").alias("spans")).mapInArrow(_joined_spans, _SPANS)
    about = spans.join(copies, both, "full").checkpoint()
    if _small(about, "spans"):
        about = F.broadcast(about)
    final = own.join(about, both, "left").select("doc_id", "text", "copy", "spans")
    return final.mapInArrow(_finished(length, keep_text), _RESULT)


def op11_suffix_array_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 50 bytes that start in an earlier document leave of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_suffixes(docs, keep_text=False).drop("kept")
