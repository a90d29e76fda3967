"""Decontamination, Jaccard join, substring dedup, mixing and sharding against plain brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, graph, jaccard_join, mixing, sharding, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, repeats, nulls, empty and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.randint(0, 120))] for _ in range(30)]
    shared = [word() for _ in range(25)]
    texts: list[str | None] = [" ".join(b) for b in base]
    for b in base[:12]:
        for edits in (0, 1, 2, 5):
            copy = list(b)
            for _ in range(min(edits, len(copy))):
                copy[r.randrange(len(copy))] = word()
            texts.append((" " if edits else "\n").join(copy))
    texts += [" ".join([*b[:20], *shared, *b[20:]]) for b in base[12:22]]
    texts += [" ".join(shared * 3), " ".join(["x"] * 60), " ".join(shared[:19]), " ".join(shared[:20]), "a b", "A B", "a  b ", "é ü c d e"]
    texts += [None, "", " \n\t", " ".join(word() for _ in range(6000))]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i, texts[k], "en", f"s{k % 3}", len(texts[k] or "")) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


def brute_components(rows, k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text, *_ in rows:
        w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words_of(text)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_components_equal_brute_force(docs, k, num, den):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, k, num, den).collect()}
    assert found == brute_components(corpus(), k, num, den)


def test_large_family_in_many_groups(spark, monkeypatch):
    """Groups of four documents: leaders, settled clusters, blocks of the matrix and opened groups all take part."""
    monkeypatch.setattr(jaccard_join, "QUERIES", 3)
    monkeypatch.setattr(jaccard_join, "UNIONS", 2)
    monkeypatch.setattr(jaccard_join.family_links, "__defaults__", (4,))
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(60)] = f"u{r.randrange(9)}"
        rows.append((i, " ".join(copy), "en", "s", 0))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 4, 85, 100)


def test_deduplicate_keeps_one_of_each_group(spark, docs):
    expected = {i for i, (n, c) in brute_components(corpus(), 5, 80, 100).items() if not n or i == c}
    kept = jaccard_join.deduplicate(docs.withColumn("n", F.lit(1)))
    assert kept.columns == [*docs.columns, "n"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    twice = spark.createDataFrame([(1, "a b c d e f", "en", "s", 0)] * 3 + [(None, "a b c d e f", "en", "s", 0)], DOCS)
    assert [r["doc_id"] for r in jaccard_join.deduplicate(twice).collect()] == [1]


def brute_substrings(rows, window: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        w = words_of(text)
        covered = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                covered[s : s + window] = [True] * window
            seen.add(key)
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out[i] = (len(w), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "limit"), [(20, 2_000_000), (6, 2_000_000), (20, 0)])
def test_substrings_equal_brute_force(docs, monkeypatch, window, limit):
    monkeypatch.setattr(substrings, "BROADCAST_IDS", limit)
    found = substrings.dedup_substrings(docs, window=window).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute_substrings(corpus(), window)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in found)


def test_repeated_rows_do_not_remove_each_other(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substrings.dedup_substrings(rows).collect())
    assert found == [(1, 0), (1, 0), (2, 30), (99, 30)]


def test_decontamination_tolerates_substitutions(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, "too short"), (9, None), (10, "")]
    rows = []
    for i in range(40):
        body = [word() for _ in range(200)]
        if i < 8:
            leak = items[i][1].split()
            for at in (4, 13, 22)[: i % 4]:
                leak[at] = word()
            body[50:50] = [w.upper() + "***" for w in leak] if i % 2 else leak
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "too short"), (103, items[0][1][:60])]
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    for limit in (1_000_000, 0):
        found = decontaminate.overlaps(docs, bench, broadcast_rows=limit).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [*((i, i) for i in range(8)), (102, 8)]
        assert {r["doc_id"]: r["n_matched"] for r in found}[3] == 27
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [*range(8, 40), 100, 101, 103]


def brute_overlaps(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """Every item at every place of every document: a share of 0.6 and 8 tokens, or a whole item of fewer than 8."""
    found = set()
    for i, text in docs:
        w = (text or "").split()
        for j, item in items:
            t = (item or "").split()
            for s in range(-len(t), len(w)):
                n = sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(t))
                if t and (n == len(t) or (len(t) >= 8 and n >= max(8, 0.6 * len(t)))):
                    found.add((i, j, n))
    return {(i, j, max(n for a, b, n in found if (a, b) == (i, j))) for i, j, _ in found}


def test_decontamination_equals_brute_force(spark):
    """Texts of few words, so that items overlap with many documents by chance; white space of all kinds; repeats."""
    r = random.Random(8)
    word = lambda: r.choice("abcdefghijklmnopqrst") * 2
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 7, 8, 9, 12, 15, 20, 21))]
    docs = []
    for i in range(60):
        leak = items[i % 8][1].split()
        for _ in range(min(i // 12, max(0, len(leak) - 8) // 3)):
            leak[r.randrange(len(leak))] = word()
        body = [word() for _ in range(r.randint(0, 40))]
        at = r.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + leak + body[at:])))
    docs += [(100, items[6][1].replace(" ", "\u00a0")), (101, items[6][1].replace(" ", "\u3000")), (102, "xx " * 3000), (103, "xx")]
    items += [(20, "xx " * 30), (21, "xx yy"), (22, None)]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(x["doc_id"], x["item_id"], x["n_matched"]) for x in found.collect()}
    assert found == brute_overlaps(docs, items)


def plain_targets(sizes: dict, weights, most: int) -> dict:
    """Water filling by rounds."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * int(r.lognormvariate(4, 1))), None, s, 0) for i in range(1500) for s in [r.choice(["b", "b", "b", "a", "é", None, "Z"])]]
    rows += [(2000 + i, "w " * 50, None, "tiny", 0) for i in range(2)] + [(3000, None, None, "none", 0), (3001, "", None, "b", 0), (None, "w w", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs, block=100).collect()
    sizes: dict = {}
    for _, text, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(text))
    expected = plain_targets(sizes, mixing.WEIGHTS, mixing.MAX_REPEAT)
    taken: dict = {}
    assert len(found) == len(rows)
    for row in found:
        assert row["target"] == pytest.approx(expected[row["source"]])
        assert row["source_size"] == sizes[row["source"]] and 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    for s, target in expected.items():
        assert abs(taken[s] - target) <= max(60, 0.01 * target), s
    again = mixing.mix(docs.repartition(7), block=100).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_flight_keeps_both_totals():
    r = random.Random(1)
    sizes = [r.randint(1, 500) for _ in range(300)]
    chances = [r.random() for _ in sizes]
    end = mixing.flight(sizes, chances, random.Random(9), False)
    assert sum(0 < x < 1 for x in end) <= 2
    assert sum(end) == pytest.approx(sum(chances))
    assert sum(s * x for s, x in zip(sizes, end, strict=True)) == pytest.approx(sum(s * x for s, x in zip(sizes, chances, strict=True)))
    assert set(mixing.flight(sizes, chances, random.Random(9), True)) == {0.0, 1.0}


def test_mix_keeps_large_ids_and_clashing_columns(spark):
    rows = [((1 << 60) + i, "w " * (i + 1), "en", "s", 0) for i in range(9)] + [(None, "w w", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row_key": F.lit(7), "__row": F.lit(8), "__Copies": F.lit(9)})
    assert {r["doc_id"] for r in mixing.mix(docs).collect()} == {r[0] for r in rows}
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert {(r["row_key"], r["__row"], r["__Copies"]) for r in out.collect()} == {(7, 8, 9)}
    numbers = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, (1 << 60) + 1))
    assert {r["source"] for r in mixing.mix(numbers).collect()} == {None, (1 << 60) + 1}


def test_shards_equal_plain_placement(spark, docs):
    many = docs.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k"), "*").withColumn("doc_id", F.col("doc_id") * 50 + F.col("k"))
    many = many.unionByName(many.filter("k < 9").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(many.filter("k = 3"))
    many = many.withColumns({"slot": F.lit("clash"), "slot_offset": F.lit(5), "__part": F.lit(6)})
    placed = sharding.shard(many, 7).collect()
    assert len(placed) == many.count() and all((r["slot_offset"], r["__part"]) == (5, 6) for r in placed)
    sizes: dict[int, int] = {}
    for r in placed:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["grown_shard"] is None and r["law"] == "bytes"
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode()))
        sizes[r["vslot"]] = sizes.get(r["vslot"], 0) + r["size"]
    held, count, home = [0] * 7, [0] * 7, {}
    for v in sorted(sizes, key=lambda v: (-sizes[v], v)):
        home[v] = min(range(7), key=lambda s: (held[s], count[s], s))
        held[home[v]] += sizes[v]
        count[home[v]] += 1
    assert {(r["vslot"], r["shard"]) for r in placed} <= set(home.items())
    assert max(held) < 1.05 * min(held)
    slots: dict[int, list] = {}
    for r in sorted(placed, key=lambda r: r["slot"]):
        slots.setdefault(r["shard"], []).append((r["slot"], r["vslot"]))
    for s in slots.values():
        assert [x[0] for x in s] == list(range(len(s))) and [x[1] for x in s] == sorted(x[1] for x in s)
    nulls = {r["vslot"] for r in placed if r["doc_id"] is None}
    assert len(nulls) > 50  # null ids are no hot slot


def test_stored_map_is_edited(spark, docs, tmp_path):
    """New bytes in a few slots: the next run edits the stored map and moves few slots; a third one leaves it."""
    path = str(tmp_path / "maps")
    sizes = {v: 1000 for v in range(256)}
    first = sharding.current_map(spark, path, sizes, 8, 256)
    assert first.version == 1 and sharding.current_map(spark, path, sizes, 8, 256) == first
    sizes |= {v: 2000 for v in range(256) if first.shards[v] == 3}
    second = sharding.current_map(spark, path, sizes, 8, 256)
    moved = sum(a != b for a, b in zip(first.shards, second.shards, strict=True))
    assert second.version == 2 and 0 < moved < 32
    assert sharding.current_map(spark, path, sizes, 8, 256) == second
    grown = sharding.current_map(spark, path, sizes, 9, 256)
    assert grown.version == 3 and {b for a, b in zip(second.shards, grown.shards, strict=True) if a != b} == {8}
    sharding.write_map(spark, grown, path)  # a retry
    assert sharding.read_map(spark, path) == grown and sharding.read_map(spark, path, 1) == first


def test_map_versions(spark, tmp_path):
    sizes = {v: 100 + v % 7 for v in range(512)}
    first = sharding.balanced_map(sizes, 8, 512)
    grown = sharding.edited_map(first, sizes, 9)
    moved = [(a, b) for a, b in zip(first.shards, grown.shards, strict=True) if a != b]
    assert moved and all(b == 8 for _, b in moved)
    path = str(tmp_path / "maps")
    for m in (first, grown):
        sharding.write_map(spark, m, path)
    assert sharding.read_map(spark, path) == grown and sharding.read_map(spark, path, 1) == first


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.deduplicate(none).count() == 0
    assert substrings.dedup_substrings(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0
    assert sharding.shard(none, 3).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(none, bench).count() == 0
    assert re.search("slot", ",".join(sharding.shard(none, 3).columns))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_texts_that_share_an_id_are_apart(spark, monkeypatch, limit):
    """Null ids, and one id with two texts: each text is judged by what is known of itself."""
    monkeypatch.setattr(substrings, "BROADCAST_IDS", limit)
    text = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    passage = text("p", 25)
    rows = [
        (1, text("a", 40)), (None, text("a", 40)), (None, text("b", 50)), (None, text("c", 5)), (2, passage),
        (None, f"{text('d', 90)} {passage}"), (7, text("e", 30)), (7, f"{text('f', 60)} {passage}"), (7, text("a", 40)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(docs).collect()}
    assert found == {(40, 0), (40, 40), (50, 0), (5, 0), (25, 0), (115, 25), (30, 0), (85, 25)}
    same = [(None, f"{passage} {text('g', 30)}"), (None, f"{text('h', 30)} {passage}")]
    removed = [r["n_removed"] for r in substrings.dedup_substrings(spark.createDataFrame(same, "doc_id long, text string")).collect()]
    assert sorted(removed) == [0, 25]


def test_null_and_repeated_ids_keep_their_clean_texts(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, f"{text('c')} more"), (4, text("d")), (4, text("e")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["text"] for r in jaccard_join.deduplicate(docs).collect()]
    assert sorted(t or "" for t in kept) == sorted(["", text("a"), text("b"), f"{text('c')} more", text("d"), text("e")])
    bench = spark.createDataFrame([(1, text("a")), (2, text("d"))], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted(["", text("b"), text("b"), f"{text('c')} more", text("e")])


@pytest.mark.parametrize(("n", "substituted", "least"), [(10, 2, 1.0), (12, 4, 1.0), (13, 5, 0.96), (14, 5, 0.99), (15, 6, 0.97), (16, 6, 0.99)])
def test_masks_hit_what_the_rule_accepts(n, substituted, least):
    """Every pattern of substitutions at the rule's limit is tried; an item is found if one mask fits between them."""
    from itertools import combinations

    assert n - substituted == max(decontaminate.MIN_TOKENS, -(-n * round(decontaminate.MIN_SHARE * 10) // 10))
    laid = [{s + k for k, bit in enumerate(m) if bit == "1"} for m in decontaminate.MASKS for s in range(n - len(m) + 1)]
    patterns = [set(c) for c in combinations(range(n), substituted)]
    assert sum(any(not (m & p) for m in laid) for p in patterns) >= least * len(patterns)


def test_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    context, group = spark.sparkContext, "few-edges"
    context.setJobGroup(group, group)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = {r["node"]: r["root"] for r in graph.components(edges).collect()}
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(301), 0)
    assert tasks <= 4 * 64  # the tables are made in shuffles; all rounds together add few


@pytest.mark.parametrize("per_partition", [1, 50, 250_000])
def test_components_of_any_partitioning(spark, monkeypatch, per_partition):
    monkeypatch.setattr(graph, "PER_PARTITION", per_partition)
    rng = random.Random(per_partition)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    root = list(range(90))
    for _ in range(90):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root[x] for x in nodes}
