"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over token positions: positions marked ``1`` are hashed, positions marked ``0`` are
ignored. Every position of every training text and of every test item gives one hash for each mask; equal hashes
are hits, so a hit survives substituted tokens under the zeros, and several masks of different shape make it likely
that one of them fits between the substitutions of a passage. A hit names a document, an item and a diagonal (how far
the item is shifted against the document); along each diagonal the item is compared once, as a whole. A document is
contaminated by an item when the diagonal has at least ``min_share`` of the item's tokens, or when its best stretch (a
match adds 1, a substitution takes 1.5) has ``enough`` of them, and ``min_tokens`` in any case. An item with fewer than
``min_tokens`` tokens is found where all of it occurs: its length without zeros is one more mask.

The masks (eleven of weight 5, six of them added greedily for what the others missed) were chosen over all patterns of
substitutions that the rule still accepts: of 10 to 12 tokens with 2, 3, 4 substituted they hit all, of 13 tokens with 5
0.966, of 14 with 5 0.998, of 15 with 6 0.978, of 16 with 6 0.996, of 18 with 7 0.995; fewer substitutions are hit
more often.

Everything is DataFrame functions. The test items' hashes are rows of 24 bytes; up to ``BROADCAST_ROWS`` of them are
broadcast, so the corpus is hashed and probed in one stage and only distinct hits leave it; beyond that, rows of
(seed, document, position) are joined by a shuffle. No text or array of hashes moves with a hit: documents with hits meet
their diagonals afterwards, each in one row for each item.

Defined results: null and empty texts match nothing, and so do items without tokens; white space is what Unicode calls
so; repeated rows of one id count as one document in the report; ``decontaminate`` goes by id and text; equal items
are reported each; null ids are kept as ids of their own; very long and repetitive texts have a diagonal for each shift
at most; empty tables give empty results; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.columns import unused
from textloom.session import ensure_checkpoint_dir

#: Fixed masks; 1 marks a position that counts.
MASKS = (
    "111011", "11010011", "110001011", "1001111", "1110101", "1101000011", "11000100011", "110000001011", "10100111", "10010010101", "101010000011",
)
MIN_TOKENS = 8
MIN_SHARE = 0.6
#: Tokens in one stretch of a long item that tell as much as its share.
ENOUGH = 13
SUBSTITUTION = 1.5
#: Rows of fixed width (8 to 24 bytes) that are broadcast at most: 24 MB.
BROADCAST_ROWS = 1_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased tokens, without marks that are neither letters nor digits."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{IsWhite_Space}]+", "")
    tokens = F.filter(F.split(bare, r"\p{IsWhite_Space}+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def seed_hashes(hashes: Column, pos: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """One hash for each mask laid at ``pos``; null where the mask reaches beyond the text."""
    seeds = []
    for number, mask in enumerate(masks):
        cared = [F.get(hashes, pos + k) for k, bit in enumerate(mask) if bit == "1"]
        seeds.append(F.when(pos + len(mask) <= F.size(hashes), F.xxhash64(F.lit(number), *cared)))
    return F.array(*seeds)


def seeded(rows: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``rows`` with ``hashes`` to one row for each position and mask, with ``pos`` and ``seed``."""
    ids = [c for c in rows.columns if c != "hashes"]
    at = rows.select(*ids, "hashes", F.posexplode("hashes").alias("pos", "token")).drop("token")
    return at.select("*", F.explode(seed_hashes(F.col("hashes"), F.col("pos"), masks)).alias("seed")).filter(
        F.col("seed").isNotNull()
    )


def best_stretch(equal: Column) -> Column:
    """Matches in the best-scoring stretch of an array of booleans."""
    start = F.struct(F.lit(0.0).alias("now"), F.lit(0).alias("m"), F.lit(0.0).alias("score"), F.lit(0).alias("best"))

    def step(acc: Column, hit: Column) -> Column:
        now = acc["now"] + F.when(hit, 1.0).otherwise(-SUBSTITUTION)
        alive = now > 0
        now = F.when(alive, now).otherwise(0.0)
        m = F.when(alive, acc["m"] + F.when(hit, 1).otherwise(0)).otherwise(0)
        better = now > acc["score"]
        return F.struct(
            now.alias("now"), m.alias("m"),
            F.when(better, now).otherwise(acc["score"]).alias("score"),
            F.when(better, m).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(equal, start, step, lambda acc: acc["best"])


def _along(hashes: Column, item: Column, shift: Column) -> Column:
    """Which tokens of an item the document has on a diagonal."""
    return F.transform(item, lambda h, j: F.coalesce((shift + j >= 0) & (F.get(hashes, shift + j) == h), F.lit(False)))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    min_tokens: int = MIN_TOKENS,
    min_share: float = MIN_SHARE,
    enough: int = ENOUGH,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, item_id, n_matched, n_stretch, n_item`` for each contaminated document and its item."""
    ensure_checkpoint_dir(docs.sparkSession)
    named = items.select(F.col(item_key).alias("item_id"), token_hashes(F.col(item_text)).alias("item_hashes"))
    named = named.filter(F.size("item_hashes") > 0).withColumn("item", F.xxhash64("item_hashes"))
    bench = named.groupBy("item").agg(F.first("item_hashes").alias("hashes")).withColumn("n_item", F.size("hashes")).checkpoint()
    short = F.col("n_item") < min_tokens
    lengths = [r["n_item"] for r in bench.filter(short).select("n_item").distinct().collect()]  # below min_tokens, each once
    whole = tuple("1" * n for n in sorted(lengths))
    seeds = seeded(bench.filter(~short).select("item", "hashes"))
    if whole:
        # of a short item only the mask of its own length counts
        own = [F.xxhash64(F.lit(len(MASKS) + k), *[F.get("hashes", F.lit(j)) for j in range(len(m))]) for k, m in enumerate(whole)]
        pick = F.coalesce(*[F.when(F.col("n_item") == len(m), own[k]) for k, m in enumerate(whole)])
        both = bench.filter(short).select("item", F.lit(0).alias("pos"), pick.alias("seed"))
        seeds = seeds.select("item", "pos", "seed").unionByName(both)
    seeds = seeds.select("seed", "item", F.col("pos").alias("item_pos")).checkpoint()
    small = seeds.count() <= broadcast_rows
    corpus = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    probes = seeded(corpus.select("row", token_hashes(F.col("text")).alias("hashes")), MASKS + whole)
    hits = probes.join(F.broadcast(seeds) if small else seeds, "seed")
    diagonals = F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts")
    hits = hits.groupBy("row", "item").agg(diagonals).checkpoint()
    told = hits.join(F.broadcast(bench) if small else bench, "item")
    # documents without hits are dropped before their texts move or are taken apart again
    rows = hits.select("row").distinct()
    n_rows = rows.count()
    met = corpus.join(F.broadcast(rows) if n_rows <= broadcast_rows else rows, "row", "left_semi").dropDuplicates(["row"])
    met = met.select("doc_id", "row", token_hashes(F.col("text")).alias("doc_hashes")).join(told, "row")
    needed = F.when(short, F.col("n_item")).otherwise(F.greatest(F.lit(min_tokens), F.ceil(min_share * F.col("n_item") - 1e-9)))
    least = F.least(needed, F.greatest(F.lit(min_tokens), F.lit(enough)))

    def judged(shift: Column) -> Column:
        equal = _along(F.col("doc_hashes"), F.col("hashes"), shift)
        return F.struct(F.size(F.filter(equal, lambda hit: hit)).alias("n_matched"), equal.alias("equal"))

    some = F.filter(F.transform("shifts", judged), lambda d: d["n_matched"] >= least)
    best = F.array_max(F.transform(some, lambda d: F.struct(d["n_matched"], best_stretch(d["equal"]).alias("n_stretch"))))
    long_stretch = (F.col("best.n_stretch") >= enough) & (F.col("best.n_stretch") >= min_tokens) & ~short
    # exploded, so that a filter does not compute it again
    verified = met.select("doc_id", "item", "n_item", F.explode(F.array(best)).alias("best")).filter((F.col("best.n_matched") >= needed) | long_stretch)
    found = verified.groupBy("doc_id", "item", "n_item").agg(F.max("best").alias("best"))
    return found.join(named.select("item", "item_id").distinct(), "item").select("doc_id", "item_id", "best.*", "n_item")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item; all columns of ``docs``. A leak removes the rows with its id and its text."""
    row = unused(docs.columns, "__row")
    keyed = docs.withColumn(row, F.xxhash64(F.col(key), F.col(options.get("text", "text"))))
    leaked = overlaps(keyed, items, row, **options).select(F.col("doc_id").alias(row)).distinct().checkpoint()
    if leaked.count() <= options.get("broadcast_rows", BROADCAST_ROWS):
        leaked = F.broadcast(leaked)
    return keyed.join(leaked, row, "left_anti").select(*docs.columns)


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, substitutions allowed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
