"""URL filters: explicit rules, then host word segmentation with multinomial naive Bayes.

A url is split into host and path by built-in functions. The longest rule that fits (the rule's host or a subdomain
of it, a path that begins with the rule's) decides. For the rest, concatenated host names are segmented into words
by unigram Viterbi, and a multinomial naive Bayes scores the words of host and path.

The lexicon is every string that separators set apart in any url of the table, with the number of hosts that use it, and
the words of the labelled example urls below (seeds). A name is no witness for itself: as one word it counts the other
hosts that use it. Bayes counts come from the seeds and from the urls that rules decide (hosts for each word, by their
logarithm), without the rules' own words, which those urls hold because they were picked by them. The lexicon stays a
table: each distinct name meets the lexicon words among its substrings in a join and is segmented once. Only strings of at
most ``WORD_LETTERS`` letters are words, so a name of any length has substrings in proportion to it. The result for each name goes to all tasks when its measured size is within ``BROADCAST_BYTES``, else it is joined by a shuffle. Words
that no labelled url holds carry no evidence, and strings outside the lexicon cost a price for each letter.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; repeated
rows are judged each; ties between rules of equal length go to the first; an empty table gives an empty result;
other columns pass through, and input columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ensure_checkpoint_dir

#: Labelled example urls (fixed values): words of host and path.
BLOCKED_EXAMPLES = """
online casino slots bonus win | casino win big jackpot | free bets sports betting odds | best poker casino free spins
cheap pills online pharmacy | buy viagra cialis pills cheap | discount pharmacy no prescription pills | cheap meds
adult videos | xxx adult porn tube | free sex cams adult chat | nude girls porn | adult dating sex | escort adult
link farm seo backlinks spam | buy backlinks cheap seo | free traffic exchange | spam bot clicks
fast payday loan cash | instant loan approval cash | free crypto giveaway win | win free prize gift cards claim
replica watches cheap | fake rolex replica | crack keygen warez download | torrent warez crack free | hack cheats free
popup banner ads network | click tracker pixel | ad server ads popup
lottery win jackpot prize | roulette blackjack bets casino | bet bets gambling slots | cheap rolex pills
"""
ALLOWED_EXAMPLES = """
daily news weather report | city news sports results | science journal article | university research library
travel guide city hotels | recipes cooking kitchen | garden plants guide | history museum art | music band concert
open source software docs | computer programming blog | health clinic doctor | school students learning | movie review
local government services | bank finance market report | photo art gallery | book reviews library | family blog
mobile phone reviews | football club match report | online shop store | company contact about | web forum help
language learning online | jobs career services | car reviews market | nature wildlife photo | house home design
wiki article | blog post archive | garden food market
"""
PRIOR_BLOCK = 0.3
#: Price in nats of each letter outside the vocabulary, and of each unknown run.
UNKNOWN_LETTER, UNKNOWN_RUN = 3.6, 6.0
#: Letters of a lexicon word at most, as a label of a host name has no more; longer runs are segmented into such words.
WORD_LETTERS = 63
#: Measured size of the names' table that is sent to all tasks at most.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or block the urls of ``host`` and its subdomains whose path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``name, verdict`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        this = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, this).otherwise(found)
    return found


def _examples(text: str) -> list[list[str]]:
    return [words.split() for words in re.split(r"[|\n]", text) if words.split()]


def segmented(name: str, unigram: dict[str, float]) -> list[str]:
    """The most likely words of a name; runs outside ``unigram`` come back as they are."""
    longest = max(map(len, unigram), default=0)
    none = (-math.inf, 0, False)
    # at each end: the best way whose last piece is a word, and the one whose last piece is a run outside
    word: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    run: list[tuple[float, int, bool]] = [none]
    for end in range(1, len(name) + 1):
        opened = (word[end - 1][0] - UNKNOWN_RUN - UNKNOWN_LETTER, end - 1, True)
        run.append(max(opened, (run[end - 1][0] - UNKNOWN_LETTER, run[end - 1][1], True)))
        found = none
        for begin in range(max(0, end - longest), end):
            chance = unigram.get(name[begin:end])
            if chance is not None:
                after_word = word[begin][0] >= run[begin][0]
                found = max(found, (max(word[begin][0], run[begin][0]) + chance, begin, after_word))
        word.append(found)
    words, end = [], len(name)
    in_word = word[end][0] >= run[end][0]
    while end:
        _, begin, after_word = word[end] if in_word else run[end]
        words.append(name[begin:end])
        end, in_word = begin, after_word
    return words[::-1]


def _seeds() -> tuple[Counter, Counter]:
    block, allow = (Counter(w for e in _examples(t) for w in e) for t in (BLOCKED_EXAMPLES, ALLOWED_EXAMPLES))
    return block, allow


class UrlModel:
    """Unigram segmentation and naive Bayes: the seeds' own words, and a ``lexicon`` of the table where it was fitted."""

    def __init__(self, corpus_counts: dict[str, int], lexicon: DataFrame | None = None, pages: DataFrame | None = None) -> None:
        self.pages = pages
        block, allow = _seeds()
        words = sorted(block.keys() | allow.keys())
        total_block, total_allow, n = sum(block.values()), sum(allow.values()), len(words)
        self.evidence = {
            w: math.log((block[w] + 0.5) / (total_block + 0.5 * n)) - math.log((allow[w] + 0.5) / (total_allow + 0.5 * n))
            for w in words
        }
        # corpus counts weigh by their logarithm, else one busy host name would outweigh the rest of the language
        mass = {w: 1 + block[w] + allow[w] + math.log1p(corpus_counts.get(w, 0)) for w in words}
        total = sum(mass.values())
        self.unigram = {w: math.log(m / total) for w, m in mass.items()}
        self.prior = math.log(PRIOR_BLOCK / (1 - PRIOR_BLOCK))
        self.lexicon = lexicon

    def segment(self, name: str) -> list[str]:
        """The most likely words of a name by the seeds."""
        return segmented(name, self.unigram)

    def words(self, host: str, path: str) -> list[str]:
        """Segmented words of a host and a path; digits only separate."""
        names = re.findall(r"[^\W\d_]+", host.lower()) + re.findall(r"[^\W\d_]+", path.lower())
        return [w for name in names for w in self.segment(name)]

    def log_odds(self, host: str, path: str) -> float:
        """Log-odds of block by the seeds."""
        return self.prior + sum(self.evidence.get(w, 0.0) for w in self.words(host, path))


def names_of(host: Column, path: Column) -> Column:
    """Runs of letters of host and path, lower-cased."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", host, path)), r"[^\p{L}]+"), lambda t: t != "")


def fit(pages: DataFrame, url: str = "url", rules: list[Rule] | None = None) -> UrlModel:
    """The lexicon of all urls: ``word, hosts, seed, block, allow``; labels are the verdicts of ``rules``."""
    rules = RULES if rules is None else rules
    ensure_checkpoint_dir(pages.sparkSession)
    block, allow = _seeds()
    own = sorted({w for r in rules for w in re.findall(r"[^\W\d_]+", r.name.lower())})
    host, path = F.col("host"), F.col("path")
    parsed = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    told = parsed.select("host", rule_of(host, path, rules)["verdict"].alias("verdict"), F.explode(names_of(host, path)).alias("word"))
    label = lambda v: F.coalesce(((F.col("verdict") == v) & ~F.col("word").isin(own)).cast("int"), F.lit(0))
    by_host = told.groupBy("word", "host").agg(F.max(label("block")).alias("block"), F.max(label("allow")).alias("allow"))
    counted = by_host.groupBy("word").agg(
        F.count(F.lit(1)).alias("hosts"), F.lit(0.0).alias("seed"),
        F.log1p(F.sum("block")).alias("block"), F.log1p(F.sum("allow")).alias("allow"),
    )
    rows = [(w, 0, 1.0 + block[w] + allow[w], float(block[w]), float(allow[w])) for w in sorted(block.keys() | allow.keys())]
    seeds = pages.sparkSession.createDataFrame(rows, "word string, hosts long, seed double, block double, allow double")
    both = counted.unionByName(seeds).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("hosts", "seed", "block", "allow")))
    return UrlModel({}, both.checkpoint(), pages)


def _pieces(longest: int):
    """``key, word``: the substrings of names of at most ``longest`` letters, a thousand places at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for low in range(0, len(name), 1000):
                    places = range(low, min(low + 1000, len(name)))
                    found = sorted({name[i:end] for i in places for end in range(i + 1, min(i + longest, len(name)) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found)], names=["key", "word"])

    return run


def name_table(lexicon: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``name, words, odds`` (parallel arrays) for every name of the table, or of ``names`` (``name``, distinct).

    A name that the table lacks is split like any other: by the words that its substrings meet.
    """
    labelled = F.col("block") + F.col("allow") > 0
    mass = F.col("seed") + F.log1p("hosts")
    n, total, blocks, allows, longest = lexicon.agg(
        F.sum(labelled.cast("int")), *(F.round(F.sum(c), 6) for c in (mass, F.col("block"), F.col("allow"))), F.max(F.least(F.length("word"), F.lit(WORD_LETTERS)))
    ).first()
    evidence = F.log((F.col("block") + 0.5) / (blocks + 0.5 * n)) - F.log((F.col("allow") + 0.5) / (allows + 0.5 * n))
    words = lexicon.filter(F.length("word") <= WORD_LETTERS).select("word", "hosts", "seed", F.when(labelled, evidence).otherwise(0.0).alias("odds"))
    if names is None:
        names = lexicon.filter("hosts > 0").select(F.col("word").alias("name"))
    names = names.withColumn("key", F.xxhash64("name"))
    pieces = names.select("key", "name").mapInArrow(_pieces(longest), "key long, word string")
    # names of one key would share their words, of which each only finds its own substrings
    met = pieces.join(words, "word").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("word", "hosts", "seed", "odds"))).alias("met"))
    met = names.join(met, "key", "left").select("name", F.coalesce("met", F.array()).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[str]] = []
            odds: list[list[float]] = []
            for name, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # a name is no witness for itself: as one word only other hosts count
                mass = {m["word"]: m["seed"] + math.log1p(max(0, m["hosts"] - (m["word"] == name))) for m in met}
                found.append(segmented(name, {w: math.log(x / total) for w, x in mass.items() if x > 0}))
                known = {m["word"]: m["odds"] for m in met}
                odds.append([known.get(w, 0.0) for w in found[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(odds, pa.list_(pa.float64()))],
                names=["name", "words", "odds"],
            )

    return met.mapInArrow(run, "name string, words array<string>, odds array<double>")


def _scored(urls: DataFrame, table: DataFrame, prior: float) -> DataFrame:
    """``urls`` (host, path) with ``words`` and ``log_odds``; the names' table goes to all tasks if it is small."""
    size = table.agg(F.sum(F.length("name") * 2 + 24 * F.size("words"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = {r["name"]: (r["words"], r["odds"]) for r in table.toLocalIterator()}
        shared = urls.sparkSession.sparkContext.broadcast(known)
        fields = [c for c in urls.columns if c != "__names"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                pairs = [[known[n] for n in row] for row in batch.column("__names").to_pylist()]
                words = [" ".join(w for ws, _ in row for w in ws) for row in pairs]
                odds = [prior + sum(o for _, os in row for o in os) for row in pairs]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in fields), pa.array(words, pa.string()), pa.array(odds, pa.float64())],
                    names=[*fields, "words", "log_odds"],
                )

        named = urls.withColumn("__names", names_of(F.col("host"), F.col("path")))
        return named.mapInArrow(run, urls.select("*", F.lit("").alias("words"), F.lit(0.0).alias("log_odds")).schema)
    each = urls.select("host", "path").distinct()
    each = each.select("host", "path", F.posexplode(names_of(F.col("host"), F.col("path"))).alias("pos", "name"))
    each = each.join(table, "name").groupBy("host", "path")
    each = each.agg(F.sort_array(F.collect_list(F.struct("pos", "words", "odds"))).alias("__all"))
    each = each.select(
        "host", "path", F.array_join(F.flatten(F.col("__all.words")), " ").alias("words"),
        (F.lit(prior) + F.aggregate(F.flatten(F.col("__all.odds")), F.lit(0.0), lambda a, x: a + x)).alias("log_odds"),
    )
    return urls.join(each, ["host", "path"], "left").select(
        *urls.columns, F.coalesce("words", F.lit("")).alias("words"), F.coalesce("log_odds", F.lit(prior)).alias("log_odds")
    )


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, words, log_odds``, by a model fitted on these urls or others."""
    added = ["host", "path", "rule", "verdict", "words", "log_odds"]
    parsed = pages.drop(*[c for c in added if c != url]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    told = F.explode(names_of(F.col("host"), F.col("path"))).alias("name")
    names = None if model.pages is pages else parsed.select(told).distinct()
    table = name_table(model.lexicon, names).checkpoint()
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return (
        _scored(parsed, table, model.prior)
        .withColumn("__rule", rule)
        .withColumns({"rule": F.col("__rule.name"), "verdict": F.coalesce(F.col("__rule.verdict"), by_model)})
        .drop("__rule")
    )


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op2_segmented_url_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge(pages, RULES, fit(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")
