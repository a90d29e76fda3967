"""Text functions: normalization, white space, signatures, JSON out of free text."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``str.strip`` and ``\\s`` have it (fixed values): for Java and Python patterns.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Line ends as ``str.splitlines`` has them (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def normalize_text(text: str) -> str:
    """NFKC, case-folded, runs of white space as one space, stripped."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


#: Bytes of text that a Python worker holds as Python strings at once, beside the Arrow batch.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The values of an Arrow column in runs of ``SLICE_BYTES``, a longer text alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        limit = (ends[begin - 1] if begin else 0) + SLICE_BYTES
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        yield texts[begin:end].to_pylist()
        begin = end


@F.arrow_udf(T.StringType())
def normalized(texts: pa.Array) -> pa.Array:
    """``normalize_text`` of a column, by Arrow batches: Spark has neither NFKC nor case folding."""
    parts = [pa.array([None if t is None else normalize_text(t) for t in own], pa.string()) for own in slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalized_latin(text: Column) -> Column:
    """``normalize_text`` by built-in functions, for texts that NFKC does not change (Latin scripts)."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, f"[{WS}]+", " "))


def strip(text: Column) -> Column:
    """``str.strip`` by built-in functions."""
    return F.btrim(text, F.lit(WS_CHARS))


def blake_place(text: str) -> float:
    """A place in [0, 1) by an 8-byte blake2b hash of the text."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest()) / 2**64


@F.arrow_udf(T.DoubleType())
def normalized_blake_share(texts: pa.Array) -> pa.Array:
    """``blake_place`` of normalized texts; no batch of them is held, only numbers."""
    return pa.array([None if t is None else blake_place(normalize_text(t)) for own in slices(texts) for t in own], pa.float64())


def sha_share(text: Column) -> Column:
    """A place in [0, 1) by the first 52 bits of SHA-256, by built-in functions."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def label_signature(labels: Column) -> Column:
    """Sorted distinct labels."""
    return F.array_sort(F.array_distinct(labels))


def span_signature(text: Column, spans: Column) -> Column:
    """Sorted multiset of (quoted text, label)."""

    def quoted(s: Column) -> Column:
        return F.to_json(
            F.array(F.substring(text, s["start"] + 1, s["end"] - s["start"]), s["label"])
        )

    return F.array_sort(F.transform(spans, quoted))


def signature(text: Column, labels: Column, spans: Column) -> Column:
    """What two annotations must share to agree: the spans' signature if there are spans, else the labels'."""
    return F.when(F.size(spans) > 0, span_signature(text, spans)).otherwise(label_signature(labels))


def describe(text: Column, labels: Column, spans: Column) -> Column:
    """One line: ``label='substring'; ...``, the labels, or ``(none)``."""

    def one(s: Column) -> Column:
        return F.concat(s["label"], F.lit("='"), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("'"))

    return (
        F.when(F.size(spans) > 0, F.array_join(F.transform(spans, one), "; "))
        .when(F.size(labels) > 0, F.array_join(labels, ", "))
        .otherwise("(none)")
    )


_THINK = re.compile(r"<think>.*?</think>", re.S)
_THINK_OPEN = re.compile(r"^.*?</think>", re.S)


def first_object(reply: str) -> str:
    """The first JSON object in a reply, past reasoning blocks, fences and prose; ValueError without one."""
    text = _THINK_OPEN.sub("", _THINK.sub("", reply))
    decoder = json.JSONDecoder()
    for found in re.finditer(r"\{", text):
        try:
            value, end = decoder.raw_decode(text, found.start())
        except json.JSONDecodeError:
            continue
        if isinstance(value, dict):
            return text[found.start() : end]
    raise ValueError("the reply holds no JSON object")


@F.pandas_udf(T.StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    """``first_object`` of a column; null where there is none."""

    def one(reply: str) -> str | None:
        try:
            return first_object(reply)
        except ValueError:
            return None

    return replies.map(one, na_action="ignore")
