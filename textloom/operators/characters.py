"""Characters as tokens, many at once: counts of their neighbourhoods to train on, tags from a linear model.

A character's features are those of the ``REACH`` characters on each side of it and its own, so equal neighbourhoods are
counted instead of listed, and a character's margin is a sum of table entries. Texts are taken in pieces, which bounds a
task's memory.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 2
WIDTH = 2 * REACH + 1
EDGE = "_"
#: Characters that are worked on at once.
PIECE = 1 << 21
COUNTS = "near string, shapes string, tag string, n long"
ITEMS = "array<struct<token:struct<start:int,end:int,special:boolean,prob:double>,tag:string>>"
_ITEM = pa.struct([
    pa.field("token", pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("special", pa.bool_()), pa.field("prob", pa.float64())])),
    pa.field("tag", pa.string()),
])
_CODES = 0x110000


def shape(char: str) -> str:
    """What kind of character it is: 9 for numbers, A for capital letters, else itself."""
    kind = unicodedata.category(char)
    return "9" if kind[0] == "N" else "A" if kind == "Lu" else char


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def strings(points: np.ndarray, width: int) -> list[str]:
    """Code points, row by row, as strings of ``width`` characters."""
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + width] for i in range(0, len(text), width)]


def alphabet(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points in order, and the places of all points among them."""
    seen = np.zeros(_CODES, bool)
    seen[points] = True
    found = np.flatnonzero(seen)
    place = np.zeros(_CODES, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[points]


def tag_ids(n: int, spans: list[dict], known: dict[str, int]) -> np.ndarray:
    """Ids of the tags of ``n`` characters, as ``spans.bio_tags`` has them: 0 is O, each label has one for B and one for I."""
    owner = np.full(n + 1, -1, np.int32)
    ordered = sorted((s["start"], s["end"], s["label"]) for s in spans)
    for j in range(len(ordered) - 1, -1, -1):
        owner[max(0, ordered[j][0]) : max(0, min(n, ordered[j][1]))] = j
    labels = np.array([known.setdefault(label, len(known)) for _, _, label in ordered] or [0], np.int32)
    inside = np.flatnonzero(owner[:n] >= 0)
    out = np.zeros(n, np.int32)
    out[inside] = 1 + 2 * labels[owner[inside]] + (owner[inside] == owner[inside - 1])  # the entry before the first is -1
    return out


def window_counts(points: np.ndarray, tags: np.ndarray, n_tags: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct windows of ``WIDTH`` points with their middle's tag (a negative one is left out) and their numbers."""
    if not len(tags):
        return
    found, local = alphabet(points)
    base = len(found)
    if base**WIDTH * n_tags >= 1 << 63:  # too many kinds of characters for one number: by halves
        half = len(tags) // 2
        yield from window_counts(points[: half + 2 * REACH], tags[:half], n_tags)
        yield from window_counts(points[half:], tags[half:], n_tags)
        return
    key = tags.astype(np.int64)
    for k in range(WIDTH):
        key = key * base + local[k : k + len(tags)]
    key, n = np.unique(key[tags >= 0], return_counts=True)
    window = np.empty((len(key), WIDTH), np.int64)
    for k in range(WIDTH - 1, -1, -1):
        key, window[:, k] = np.divmod(key, base)
    yield found[window], key, n


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The points of texts with edges on both sides of each, and where each begins."""
    edge = EDGE * REACH
    points = codes("".join(f"{edge}{t}{edge}" for t in texts))
    sizes = np.array([len(t) + 2 * REACH for t in texts], np.int64)
    return points, np.cumsum(sizes) - sizes + REACH


def _pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with ``most`` characters or a single text."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes: dict[int, int] = {}
    for batch in batches:
        sizes = pc.utf8_length(batch["text"]).fill_null(0).to_pylist()
        for begin, end in _pieces(sizes, PIECE):
            pairs = zip(batch["text"][begin:end].to_pylist(), batch["spans"][begin:end].to_pylist(), strict=True)
            pairs = [(text, spans) for text, spans in pairs if text and spans is not None]
            points, starts = padded([text for text, _ in pairs])
            tags, known = np.full(len(points), -1, np.int32), {}
            for (text, spans), at in zip(pairs, starts, strict=True):
                tags[at : at + len(text)] = tag_ids(len(text), spans, known) if spans else 0
            names = ["O", *(f"{p}-{label}" for label in known for p in "BI")]
            for a in range(0, len(points) - 2 * REACH, PIECE):
                middle = tags[a + REACH : min(a + PIECE, len(points) - 2 * REACH) + REACH]
                for window, tag, n in window_counts(points[a : a + len(middle) + 2 * REACH], middle, len(names)):
                    kinds, local = alphabet(window)
                    new = np.array([shapes.setdefault(int(c), ord(shape(chr(c)))) for c in kinds], np.int64)
                    yield pa.record_batch(
                        [strings(window, WIDTH), strings(new[local], WIDTH), np.array(names, object)[tag], n], ["near", "shapes", "tag", "n"]
                    )


def neighbourhoods(rows: DataFrame) -> DataFrame:
    """``near, shapes, tag, n``: how often each neighbourhood has each tag in ``text, spans``."""
    each = rows.select("text", "spans").mapInArrow(_counted, COUNTS)
    return each.groupBy("near", "shapes", "tag").agg(F.sum("n").alias("n"))


def terms(near: list, shapes: list) -> list:
    """The names and values of a neighbourhood's features, alternating."""
    out = []
    for k in range(WIDTH):
        out += [f"w{k - REACH}=", near[k], f"s{k - REACH}=", shapes[k]]
    return out


def context() -> Column:
    """The features of ``near, shapes`` as a text, a space before each."""
    split = [[F.substring(name, k + 1, 1) for k in range(WIDTH)] for name in ("near", "shapes")]
    return F.concat(*[F.lit(f" {x}") if isinstance(x, str) else x for x in terms(*split)])


def feature_index(term: str, size: int) -> int:
    """The place that ``HashingTF`` gives to a term: MurmurHash3 (32 bits, seed 42) as a signed number, modulo ``size``."""
    data, h, mask = term.encode(), 42, 0xFFFFFFFF

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % size


def tagger(weights: np.ndarray, intercepts: np.ndarray, names: list[str]):
    """A function of ``text``: the characters that get another tag than O, and the one after each, in order (``ITEMS``).

    ``weights``: a row for each class, a column for each feature of ``context``; classes are ``names``, the first is O.
    """
    size = weights.shape[1]

    def table(points: np.ndarray) -> np.ndarray:
        """For each place of a neighbourhood and each code point its part of the margins."""
        out = np.zeros((WIDTH, len(points), len(weights)))
        for i, c in enumerate(map(chr, points)):
            told = terms([c] * WIDTH, [shape(c)] * WIDTH)
            for j in range(0, len(told), 2):
                # a space parts the features, so that of a space is its name only
                out[j // 4, i] += weights[:, feature_index(told[j] + told[j + 1].strip(" "), size)]
        return out

    @F.arrow_udf(ITEMS)
    def tagged(texts: pa.Array) -> pa.Array:
        sizes = pc.utf8_length(texts).fill_null(0).to_pylist()
        starts_all, probs_all, tags_all, owners_all = [], [], [], []
        for begin, end in _pieces(sizes, PIECE // 2):
            points, starts = padded([t or "" for t in texts[begin:end].to_pylist()])
            lengths = np.array(sizes[begin:end], np.int64)
            for a in range(0, len(points) - 2 * REACH, PIECE // 2):
                b = min(a + PIECE // 2, len(points) - 2 * REACH)
                lo = max(0, a - 1)  # the character before tells whether the first is one after
                found, local = alphabet(points[lo : b + 2 * REACH])
                parts = table(found)
                margins = intercepts + parts[0][local[: b - lo]]
                for k in range(1, WIDTH):
                    margins += parts[k][local[k : k + b - lo]]
                best = margins.argmax(1)
                middle = np.arange(lo + REACH, b + REACH)
                owner = np.maximum(np.searchsorted(starts, middle, "right") - 1, 0) if best.any() else np.zeros(b - lo, np.int64)
                at = middle - starts[owner]
                real = (at >= 0) & (at < lengths[owner])
                marked = (best > 0) & real
                kept = marked | np.concatenate([[False], marked[:-1]])
                kept &= real
                kept[: a - lo] = False
                kept = np.flatnonzero(kept)
                own = margins[kept]
                odds = np.exp(own - own.max(1, keepdims=True)) if len(own) else own
                probs_all.append(odds.max(1) / odds.sum(1) if len(own) else np.zeros(0))
                starts_all.append(at[kept])
                tags_all.append(best[kept])
                owners_all.append(owner[kept] + begin)
        at, prob, tag, owner = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((starts_all, np.int64), (probs_all, float), (tags_all, np.int64), (owners_all, np.int64)))
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        token = pa.StructArray.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array((at + 1).astype(np.int32)), pa.array(np.zeros(len(at), bool)), pa.array(prob)], fields=list(_ITEM.field("token").type)
        )
        items = pa.StructArray.from_arrays([token, pa.array(np.array(names, object)[tag], pa.string())], fields=list(_ITEM))
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    return tagged
