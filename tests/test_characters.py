from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import characters, labelers, pools, segment, spans
from textloom.plans import model
from textloom.types import LabelDef, TaskKind, TaskSpec, TrainConfig

SPEC = TaskSpec("Mark numbers.", TaskKind.SPAN, (LabelDef("N"),))


def marked_texts(spark, n: int):
    r = random.Random(4)
    texts = ["".join(r.choice("aB 12\n_é𝟙") for _ in range(r.randint(0, 30))) for _ in range(n)]
    frame = spark.createDataFrame(list(enumerate([*texts, None, "", "7"])), "id long, text string")
    return labelers.pattern_spans("[0-9]+", "N")(frame)


def listed(rows):
    """A row for each character, by shifted arrays."""
    chars = F.concat(F.array(F.lit("_"), F.lit("_")), spans.characters(F.col("text")), F.array(F.lit("_"), F.lit("_")))
    tags = spans.bio_tags(F.col("spans"), spans.character_tokens(F.col("text")))
    near = F.transform(tags, lambda _, i: F.array_join(F.slice(chars, i + 1, 5), ""))
    return rows.select(F.explode(F.arrays_zip(near.alias("near"), tags.alias("tag"))).alias("x")).select("x.near", "x.tag")


def test_counts_equal_listed_neighbourhoods(spark, monkeypatch):
    rows = marked_texts(spark, 200)
    want = Counter((r["near"], r["tag"]) for r in listed(rows).collect())
    got = {(r["near"], r["tag"]): r["n"] for r in characters.neighbourhoods(rows).collect()}
    assert got == dict(want)
    batch = pa.RecordBatch.from_pylist([{"text": r["text"], "spans": [s.asDict() for s in r["spans"]] if r["spans"] is not None else None} for r in rows.select("text", "spans").collect()])
    for piece in (7, 64):  # texts longer than a piece, and pieces of several texts
        monkeypatch.setattr(characters, "PIECE", piece)
        sums = Counter()
        for part in characters._counted(iter([batch])):
            for r in part.to_pylist():
                sums[r["near"], r["tag"]] += r["n"]
        assert sums == want


def test_many_kinds_of_characters_are_counted_by_halves():
    points = np.arange(0x4E00, 0x4E00 + 9000, dtype=np.uint32)
    found = [(tuple(w), int(t), int(k)) for a, b, n in characters.window_counts(points, np.zeros(8996, np.int32), 3) for w, t, k in zip(a, b, n, strict=True)]
    assert sorted(found) == [(tuple(range(p, p + 5)), 0, 1) for p in range(0x4E00, 0x4E00 + 8996)]


def test_tags_equal_the_operator(spark):
    given = [(2, 5, "X"), (4, 8, "Y"), (5, 5, "Y"), (8, 30, "X")]
    frame = spark.createDataFrame([("abcdefghij", given)], "text string, spans array<struct<start:int,end:int,label:string>>")
    want = frame.select(spans.bio_tags(F.col("spans"), spans.character_tokens(F.col("text"))).alias("t")).first()["t"]
    known: dict[str, int] = {}
    ids = characters.tag_ids(10, [dict(zip(("start", "end", "label"), s, strict=True)) for s in given], known)
    names = ["O", *(f"{p}-{label}" for label in known for p in "BI")]
    assert [names[i] for i in ids] == want


def test_equal_neighbourhoods_are_one_row_of_the_fit(spark, monkeypatch):
    """The fit's rows stop to grow with the texts; before, each character was a row."""
    monkeypatch.setattr(model, "LEAST_ROWS", 100)
    rows = spark.createDataFrame([(i, f"ab{i % 3 + 7}cd") for i in range(400)], "id long, text string")
    made = model._character_rows(labelers.pattern_spans("[0-9]+", "N")(rows))
    assert made.agg(F.sum("weight")).first()[0] == 2000
    assert made.agg(F.max("weight")).first()[0] == 20 and made.count() <= 100 + made.distinct().count()


def test_tagger_equals_the_stages(spark, monkeypatch):
    hashing = HashingTF(numFeatures=model.FEATURES)
    for term in ("", "w0=", "w-1=a", "s2=é", "w-2=𝟙", "w1=\n", "w10=abc"):
        assert characters.feature_index(term, model.FEATURES) == hashing.indexOf(term)
    rows = marked_texts(spark, 150)
    fitted = model.train_epochs(SPEC, rows, TrainConfig("mllib", epochs=0.4, weight_decay=0.0)).model
    assert fitted.stages[0].getInputCol() == model.CHARACTERS
    told = characters.neighbourhoods(rows).withColumn(model.CHARACTERS, characters.context())
    score = {r["near"]: (int(r["prediction"]), max(r["probability"])) for r in fitted.transform(told).collect()}
    names = spans.label_names(SPEC)
    for piece in (1 << 21, 11):
        monkeypatch.setattr(characters, "PIECE", piece)
        last = fitted.stages[-1]
        find = characters.tagger(last.coefficientMatrix.toArray(), last.interceptVector.toArray(), names).func
        texts = [r["text"] for r in rows.select("text").collect()]
        for text, items in zip(texts, find(pa.array(texts, pa.string())).to_pylist(), strict=True):
            near = [f"__{text or ''}__"[i : i + 5] for i in range(len(text or ""))]
            hits = [i for i, w in enumerate(near) if score[w][0] or (i and score[near[i - 1]][0])]
            assert [(x["token"]["start"], x["tag"]) for x in items] == [(i, names[score[near[i]][0]]) for i in hits]
            assert all(abs(x["token"]["prob"] - score[near[x["token"]["start"]]][1]) < 1e-9 for x in items)


def test_lines_are_cut_as_packed(spark):
    """A short line is a passage as it is, a long one is cut by one pattern: no fold over its sentences."""
    r = random.Random(2)
    lines = ["".join(r.choice(["ab", "x", ". ", ".", "! ", "?!", "。", "」", " ", "é𝟙"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in [*lines, "a" * 95, "b" * 60 + ". c."]], "t string")
    for n in (1, 7, 30):
        packed = F.filter(segment.packed(segment.sentences(F.col("t")), n), lambda p: p != "")
        cut = F.filter(segment.cut(F.col("t"), n), lambda p: p != "")
        assert frame.filter(packed != cut).count() == 0
    assert "aggregate(" not in str(segment.passages(F.col("t"), 30))


def test_strip_without_a_pattern(spark):
    row = spark.createDataFrame([(f"{T.WS_CHARS}a b{T.WS_CHARS}", T.WS_CHARS, None)], "a string, b string, c string").select(*[T.strip(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == ("a b", "", None)


def test_python_texts_are_held_in_slices(spark, monkeypatch):
    """However large a batch is, few of its texts are Python strings at once."""
    monkeypatch.setattr(T, "SLICE_BYTES", 10)
    texts = pa.array(["Ab  c", "", None, "x" * 40, "ß", "de", "f"], pa.string())
    runs = list(T.slices(texts))
    assert [t for run in runs for t in run] == texts.to_pylist()
    assert all(sum(len((t or "").encode()) for t in run) <= 10 or len(run) == 1 for run in runs) and len(runs) == 3
    assert T.normalized.func(texts).to_pylist() == ["ab c", "", None, "x" * 40, "ss", "de", "f"]
    frame = spark.createDataFrame([(t,) for t in ["Ab  c", "ab C", "", None]], "text string")
    shares = [r[0] for r in frame.select(T.normalized_blake_share(F.col("text"))).collect()]
    assert shares[:3] == [T.blake_place("ab c")] * 2 + [T.blake_place("")] and shares[3] is None
    assert len({r[0] for r in frame.limit(2).select(pools.pool(F.col("text"))).collect()}) == 1
