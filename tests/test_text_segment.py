from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import segment


def passages(spark, text: str, n: int) -> list[str]:
    frame = spark.createDataFrame([(text,)], "text string")
    return frame.select(segment.passages(F.col("text"), n).alias("p")).first()["p"]


def test_normalize():
    assert T.normalize_text("  ＡＢＣ \n def\t") == "abc def"
    assert T.normalize_text("Straße　x") == "strasse x"


def test_normalized_column_and_latin_form(spark):
    frame = spark.createDataFrame([("Große  Tür\n",), (None,), ("",)], "text string")
    rows = frame.select(T.normalized(F.col("text")), T.normalized_latin(F.col("text"))).collect()
    assert [tuple(r) for r in rows] == [("grosse tür", "grosse tür"), (None, None), ("", "")]


def test_strip_knows_all_white_space(spark):
    odd = "\x1c\x85　 a b  \x1f"
    assert odd.strip() == "a b"
    assert spark.createDataFrame([(odd,)], "t string").select(T.strip(F.col("t"))).first()[0] == "a b"


def test_passages_in_english_and_japanese(spark):
    assert passages(spark, "Pi is 3.14 here. Next one. Third sentence!", 30) == ["Pi is 3.14 here. Next one.", "Third sentence!"]
    assert passages(spark, "あ" * 25 + "。", 10) == ["あ" * 10, "あ" * 10]
    assert passages(spark, "「はい、そうです。」と言った人がいた。次の文もここにある。", 40) == ["「はい、そうです。」と言った人がいた。次の文もここにある。"]


def packed(parts: list[str], n: int) -> list[str]:
    out, now = [], ""
    for part in parts:
        if len(now) + len(part) <= n:
            now += part
            continue
        out.append(now)
        pieces = [part[i : i + n] for i in range(0, len(part), n)]
        out, now = out + pieces[:-1], pieces[-1]
    return [*out, now]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab ", max_size=30), min_size=1, max_size=8), st.integers(3, 20))
def test_packing_equals_a_plain_loop(spark, parts, n):
    frame = spark.createDataFrame([(parts,)], "p array<string>")
    assert frame.select(segment.packed(F.col("p"), n)).first()[0] == packed(parts, n)


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"a": 1}', '{"a": 1}'),
        ('<think>{"b": 2}</think>Sure: ```json\n{"a": "}"}\n```', '{"a": "}"}'),
        ('[1] {bad} {"a": {"b": 2}} tail', '{"a": {"b": 2}}'),
    ],
)
def test_first_object(reply, expected):
    assert T.first_object(reply) == expected


def test_no_object():
    with pytest.raises(ValueError):
        T.first_object("none")


def test_signature_and_description(spark):
    rows = [("ab 12 ab", ["x", "x", "a"], []), ("ab 12 ab", [], [(0, 2, "W"), (6, 8, "W")]), ("t", [], [])]
    frame = spark.createDataFrame(rows, "text string, labels array<string>, spans array<struct<start:int,end:int,label:string>>")
    text, labels, spans = F.col("text"), F.col("labels"), F.col("spans")
    got = [tuple(r) for r in frame.select(T.signature(text, labels, spans), T.describe(text, labels, spans)).collect()]
    assert got == [
        (["a", "x"], "x, x, a"),
        (['["ab","W"]', '["ab","W"]'], "W='ab'; W='ab'"),
        ([], "(none)"),
    ]
