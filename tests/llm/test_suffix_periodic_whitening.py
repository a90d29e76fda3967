"""Suffix levels, periodic runs and whitening against plain brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from textloom.llm import periodic, suffix_levels, whitening

NULL_LAST = 1 << 70


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ranked(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, repr(r[1:])))


def brute_suffixes(rows, length: int = 50):
    first: dict[bytes, int] = {}
    texts = [(NULL_LAST if i is None else i, (t or "").encode(), i) for i, t in rows]
    for order, data, _ in texts:
        for j in range(len(data) - length + 1):
            first[data[j : j + length]] = min(order, first.get(data[j : j + length], order))
    for order, data, i in texts:
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if first[data[j : j + length]] < order:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        yield i, len(data), sum(gone), runs, kept, digest(kept)


def texts_with_passages(seed: int):
    """Passages at any byte, copies, repeated and null ids, runs of one byte, periods, multi-byte letters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 30))))
        rows.append((r.choice([None, 0, 1, 5, i, i, i, i]), " ".join(parts) if r.random() > 0.05 else None))
    copy = rows[7][1]
    rows += [(900, " " * 3000), (901, "-" * 400 + "x" + "-" * 90), (902, "-" * 91), (3, "ab" * 500), (904, "ba" * 300)]
    return [*rows, (905, copy), (905, copy), (906, copy), (907, "x" * 49), (908, "y" * 50), (909, "y" * 50)]


@pytest.mark.parametrize(("hot", "batch", "broadcast"), [(100_000, 4_000, 1 << 24), (2, 5, 1 << 24), (100_000, 1, 0)])
def test_suffix_levels_equal_brute_force(spark, monkeypatch, hot, batch, broadcast):
    """Whole buckets as one batch; many levels with anchors dealt string by string; no broadcast."""
    monkeypatch.setattr(suffix_levels, "HOT", hot)
    monkeypatch.setattr(suffix_levels, "BATCH", batch)
    monkeypatch.setattr(suffix_levels, "BROADCAST_BYTES", broadcast)
    rows = texts_with_passages(hot + batch)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ord int, spans string")
    found = suffix_levels.dedup_suffixes(docs.repartition(5)).collect()
    assert ranked((*r[:4], bytes(r[4]), r[5]) for r in found) == ranked(brute_suffixes(rows))


def test_suffix_levels_of_long_texts(spark):
    """Texts that several runs of hashing cut, shared at unequal places; and other lengths of the strings."""
    r = random.Random(4)
    body = bytes(r.choice(b"abcdefgh ") for _ in range(300_000)).decode()
    rows = [(1, body), (2, "q" + body[100_000:200_050] + "z" * 70), (3, body[131_000:131_200]), (4, body[5:54])]
    found = suffix_levels.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept"]) for r in found} == {1: (0, 0, None), 2: (100_050, 1, None), 3: (200, 1, None), 4: (0, 0, None)}
    short = texts_with_passages(5)
    found = suffix_levels.dedup_suffixes(spark.createDataFrame(short, "doc_id long, text string"), length=12).collect()
    assert ranked((*r[:4], bytes(r[4]), r[5]) for r in found) == ranked(brute_suffixes(short, 12))


def test_levels_merge_geometrically():
    """Seven batches leave levels of 4, 2 and 1 of them; every suffix is held once."""
    levels = suffix_levels.Levels()
    for i in range(7):
        levels.add(np.array([b"%02d-a" % i, b"%02d-b" % i]))
    assert [rank for rank, _ in levels.family] == [4, 2, 1]
    assert all((np.sort(level) == level).all() and len(level) == 2 * rank for rank, level in levels.family)
    assert levels.holds(np.array([b"00-a", b"03-b", b"05-c", b"06-a"])).tolist() == [True, True, False, True]


def test_suffixes_of_hot_pieces(spark):
    """One passage in a third of 3,000 rows, and one repeated row in another third: sent once a slice."""
    hot = "a passage that very many documents hold in just the same words, to the letter"
    rows = [(i, f"{i * 7919} {hot} {i * 104729}") for i in range(1000)] + [(i, "the same row " * 9) for i in range(1000, 2000)]
    rows += [(i, f"{i * 6700417}" * 9) for i in range(2000, 3000)]
    found = suffix_levels.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    assert ranked((*r[:4], r[5]) for r in found) == ranked((*b[:4], b[5]) for b in brute_suffixes(rows))


def brute_runs(words: list[str]):
    runs: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            a = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - a + p >= max(12, 2 * p):
                runs.setdefault((a, i - a + p), p)
            i += 1
    return sorted(((s, k, q) for (s, k), q in runs.items()), key=lambda r: (r[0], r[2]))


def run_row(words: list[str]):
    runs = brute_runs(words)
    gone = {j for s, k, q in runs for j in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for j, w in enumerate(words) if j not in gone)
    told = digest("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode())
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, told, digest(kept.encode()), kept, runs


def texts_with_runs(seed: int):
    r = random.Random(seed)
    rows = []
    for i in range(100):
        words: list[str] = []
        letters = r.choice(["ab", "abc", "abcdefgh"])
        while r.random() < 0.85:
            words += [r.choice(letters) for _ in range(r.randint(1, 20))] * r.choice([1, 1, 2, 3, 7])
        rows.append((r.choice([i, i, i, None]), " ".join(words)))
    twice = "a b c d e f g h i j k l m n " * 9 + "q " + "a b c " * 5
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "x " * 700), (504, "x\ty\n" * 333 + "x"), (505, twice), (505, twice)]


@pytest.mark.parametrize("split_bytes", [1 << 16, 300])
@pytest.mark.parametrize("rewrite", [None, periodic.echoed])
def test_runs_equal_brute_force(spark, split_bytes, rewrite):
    """Whole texts in one task, and ranges of lags in several."""
    rows = texts_with_runs(split_bytes)
    expected = []
    for i, text in rows:
        words = (text or "").split()
        source = rewrite(None if i is None else str(i), len(words)) if rewrite else None
        expected.append((i, *run_row(words if source is None else [words[k] for k in source])))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, part int, name string").repartition(3)
    found = periodic.collapse_runs(docs, rewrite=rewrite, split_bytes=split_bytes).collect()
    assert ranked((*r[:9], [tuple(x) for x in r[9]]) for r in found) == ranked(expected)


def test_runs_of_one_word_are_scanned_once():
    """A very long text of one word: all lags but the first are known to be that run."""
    codes = np.full(200_000, 7, dtype=np.uint64)
    assert periodic.find_runs(codes, np.array([0, len(codes)])).tolist() == [[0, 0, 200_000, 1]]
    part = periodic.find_runs(codes, np.array([0, len(codes)]), 3, 4)
    assert part.tolist() == [[0, 0, 200_000, 1]]


def test_runs_of_text_ids(spark):
    docs = spark.createDataFrame([("a1", "x " * 12), ("b", "x " * 11)], "doc_id string, text string")
    assert sorted((r["doc_id"], r["n_runs"]) for r in periodic.collapse_runs(docs).collect()) == [("a1", 1), ("b", 0)]


def brute_whitening(x: list[list[int]]):
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(exact) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return [sum(c * c for c in row) for row in exact], centred, e[::-1], v[:, ::-1]


def test_whitening_equals_eigenvectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = whitening.op12_tsqr_jacobi_whitening(spark, sf_dir).toPandas()
    raw = rows.toPandas()
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in raw.embedding]
    deviation, centred, e, v = brute_whitening(x)
    white = found.pivot(index="vec_id", columns="component", values="whitened").loc[raw.vec_id].to_numpy()
    expected = centred @ v[:, :32] / np.sqrt(e[:32])
    assert np.allclose(white * np.sign((white * expected).sum(0)), expected, atol=1e-8)
    assert found.groupby("vec_id").deviation.first().loc[raw.vec_id].tolist() == deviation
    assert np.allclose(found.groupby("component").explained.first(), e[:32] / e.sum(), rtol=1e-9)
    assert found.identity_error.max() < 1e-9 and found.n.unique().tolist() == [len(raw)]


def test_whitening_of_hostile_rows(spark):
    """Nulls, not-a-number, short vectors, repeated rows, no variance; several merges of triangles."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-inf, 0.0]), (6, [])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n int").repartition(8)
    found = whitening.whiten(frame).collect()
    assert {(r["vec_id"], r["component"]) for r in found} == {(i, c) for i in (1, None, 6) for c in (1, 2)}
    assert len(found) == 8 and {r["n"] for r in found} == {4}
    x = [[64 * 1 + 10**6, 64 * 2 + 10**6], [64 + 10**6, 128 + 10**6], [192 + 10**6, 10**6], [10**6, 10**6]]
    assert sorted({int(r["deviation"]) for r in found}) == sorted(set(brute_whitening(x)[0]))
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], "vec_id long, embedding array<float>")).collect()
    assert [r["whitened"] for r in flat if r["component"] == 2] == [None, None]
    assert all(r["identity_error"] < 1e-12 for r in flat)
    for none in ([], [(1, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(none, "vec_id long, embedding array<double>")).count() == 0


def test_tree_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(5)]) for i in range(300)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(20)).collect()
    assert len(found) == 1500 and max(x["identity_error"] for x in found) < 1e-12


def test_rotations_keep_small_deviations():
    """Columns over ten orders of magnitude; odd and even widths."""
    for width in (1, 2, 5, 8):
        r = np.random.default_rng(width)
        q, z = np.linalg.qr(r.normal(size=(width, width)))[0], np.linalg.qr(r.normal(size=(width, width)))[0]
        sizes = 10.0 ** -np.linspace(0, 10, width)
        v, lengths = whitening.jacobi(q @ np.diag(sizes) @ z.T)
        assert np.allclose(lengths, sizes, rtol=1e-4) and np.allclose(v.T @ v, np.eye(width), atol=1e-13)
