"""Span operators: checks, location, BIO tags and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import WS, strip
from textloom.types import SPANS, TaskKind, TaskSpec

OUTSIDE = "O"
IGNORE = -100
QUOTED = "array<struct<text:string,label:string>>"


def count_of(text: Column, sub: Column) -> Column:
    """Non-overlapping occurrences of a substring; 0 for the empty one."""
    gone = F.length(text) - F.length(F.replace(text, sub, F.lit("")))
    return F.when(F.length(sub) > 0, (gone / F.length(sub)).cast("int")).otherwise(0)


def class_items(items: DataFrame, spec: TaskSpec) -> DataFrame:
    """Written items with a text, known labels, and exactly one label where labels exclude each other."""
    known = F.array(*map(F.lit, spec.names))
    kept = items.withColumn("text", strip(F.col("text"))).withColumn("labels", F.array_distinct("labels"))
    kept = kept.filter((F.col("text") != "") & (F.size(F.array_except("labels", known)) == 0))
    return kept.filter(F.size("labels") == 1) if spec.exclusive else kept


def span_items(items: DataFrame, spec: TaskSpec) -> DataFrame:
    """Written span items (``text, quoted``) whose quotes have known labels and occur as often as listed; adds ``spans``."""
    known = F.array(*map(F.lit, spec.names))
    text = F.col("text")

    def fits(q: Column) -> Column:
        listed = F.size(F.filter(F.col("quoted"), lambda o: o["text"] == q["text"]))
        return F.array_contains(known, q["label"]) & (F.length(q["text"]) > 0) & (count_of(text, q["text"]) == listed)

    kept = items.withColumn("text", strip(F.col("text"))).filter((text != "") & F.forall("quoted", fits))
    return kept.withColumn("spans", located(F.col("text"), F.col("quoted"))).filter("spans is not null")


def locate(text: str, quoted: list[tuple[str, str]]) -> list[tuple[int, int, str]] | None:
    """Offsets of quotes in list order, each at its first occurrence that is still free; sorted by start."""
    taken: list[tuple[int, int, str]] = []
    for sub, label in quoted:
        at = text.find(sub) if sub else -1
        while at >= 0 and any(at < e and at + len(sub) > s for s, e, _ in taken):
            at = text.find(sub, at + 1)
        if at < 0:
            return None
        taken.append((at, at + len(sub), label))
    return sorted(taken, key=lambda s: s[0])


def located(text: Column, quoted: Column) -> Column:
    """``locate`` of columns; null where a quote has no free occurrence, or a quote, label or the text is null.

    A fold over the quotes holds the taken intervals. A place that meets one is left for the first occurrence after that
    interval: all places in between meet it too. So a quote is looked for once for each interval at most.
    """
    taken_type = "struct<taken:array<struct<start:int,end:int,label:string>>,lost:boolean>"
    nothing = F.struct(F.array().cast(SPANS).alias("taken"), F.lit(False).alias("lost")).cast(taken_type)

    def find(quote: Column, at: Column) -> Column:
        return F.call_function("locate", quote, text, at + 1) - 1

    def step(acc: Column, q: Column) -> Column:
        size = F.length(q["text"])

        def later(at: Column, _: Column) -> Column:
            meets = F.filter(acc["taken"], lambda t: (at < t["end"]) & (at + size > t["start"]))
            return F.when((at < 0) | (F.size(meets) == 0), at).otherwise(find(q["text"], F.array_max(F.transform(meets, lambda t: t["end"]))))

        first = F.when(size > 0, find(q["text"], F.lit(0))).otherwise(-1)
        at = F.aggregate(acc["taken"], first, later)
        span = F.struct(at.alias("start"), (at + size).alias("end"), q["label"].alias("label"))
        fits = F.coalesce(~acc["lost"] & (at >= 0), F.lit(False))
        grown = F.when(fits, F.concat(acc["taken"], F.array(span))).otherwise(acc["taken"])
        return F.struct(grown.alias("taken"), (~fits).alias("lost")).cast(taken_type)

    return F.aggregate(quoted, nothing, step, lambda acc: F.when(~acc["lost"], F.array_sort(acc["taken"])))


def label_names(spec: TaskSpec) -> list[str]:
    """Classes in order of their ids: the labels, or ``O`` and B- and I- tags of each label."""
    if spec.kind is not TaskKind.SPAN:
        return spec.names
    return [OUTSIDE, *(f"{p}-{name}" for name in spec.names for p in "BI")]


def class_id(spec: TaskSpec, label: Column) -> Column:
    """Id of a class name."""
    return F.array_position(F.array(*map(F.lit, label_names(spec))), label) - 1


def encoded_labels(spec: TaskSpec, labels: Column) -> Column:
    """Training target: a 0/1 vector over the labels, or the id of the single label."""
    if spec.kind is TaskKind.MULTILABEL:
        return F.transform(F.array(*map(F.lit, spec.names)), lambda n: F.array_contains(labels, n).cast("double"))
    return class_id(spec, F.get(labels, 0))


def trimmed(chars: Column, span: Column) -> Column:
    """A span without white space at its edges, from the characters of its text; it costs its own length."""
    quote = F.slice(chars, span["start"] + 1, span["end"] - span["start"])
    solid = F.transform(quote, lambda c: ~F.rlike(c, F.lit(f"^[{WS}]$")))
    front = F.when(F.array_contains(solid, True), F.array_position(solid, True) - 1).otherwise(F.size(solid))
    back = F.when(F.array_contains(solid, True), F.array_position(F.reverse(solid), True) - 1).otherwise(0)
    start = (span["start"] + front).cast("int")
    end = F.greatest(start, (span["end"] - back).cast("int"))
    return F.struct(start.alias("start"), end.alias("end"), span["label"].alias("label"))


def characters(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def character_tokens(text: Column) -> Column:
    """A token for each character."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<struct<start:int,end:int,special:boolean>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(i.alias("start"), (i + 1).alias("end"), F.lit(False).alias("special")),
        )
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: in a lambda, an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def word_tokens(text: Column) -> Column:
    """A token for each run without white space."""

    def tokens(chars: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(chars) - 1)

        def white(i: Column) -> Column:
            return F.coalesce(F.rlike(F.get(chars, i), F.lit(f"^[{WS}]$")), F.lit(True))

        starts = F.filter(places, lambda i: ~white(i) & white(i - 1))
        ends = F.filter(places, lambda i: ~white(i) & white(i + 1))
        return F.zip_with(
            starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end"), F.lit(False).alias("special"))
        )

    empty = F.array().cast("array<struct<start:int,end:int,special:boolean>>")
    return F.when(F.length(text) == 0, empty).otherwise(let(F.split(text, ""), tokens))


def bio_tags(spans: Column, tokens: Column) -> Column:
    """Tag of each token; null for special ones.

    A token takes the first span by start that it overlaps: I when the last non-special token had the same span,
    else B. Every step is a pass over tokens, spans or places of the text; only spans that end no later than one before
    them, which no token takes, are looked for among all spans.
    """

    def leading(ordered: Column) -> Column:
        rising = F.forall(
            F.sequence(F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(1))),
            lambda i: F.coalesce(F.get(ordered, i)["end"] > F.get(ordered, i - 1)["end"], F.lit(True)),
        )
        outlast = F.filter(ordered, lambda s, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda b: b["end"] >= s["end"]))
        return F.when(rising, ordered).otherwise(outlast)


    def tagged(real: Column, ordered: Column) -> Column:
        def listed(reach: Column) -> Column:
            # the first span that ends after each place: every span has a run of places of its own
            runs = F.transform(ordered, lambda s, j: F.array_repeat(j, F.get(reach, j + 1) - F.get(reach, j)))
            return F.flatten(runs)

        def hit(first: Column, token: Column) -> Column:
            j = F.get(first, token["start"])
            return F.when(F.get(ordered, j)["start"] < token["end"], j).otherwise(-1)

        def tag(hits: Column, index: Column, i: Column) -> Column:
            prefix = F.when(index == F.get(hits, i - 1), "I-").otherwise("B-")
            return F.when(index < 0, OUTSIDE).otherwise(F.concat(prefix, F.get(ordered, index)["label"]))

        def spread_hits(first: Column) -> Column:
            hits = F.transform(real, lambda t: F.coalesce(hit(first, t), F.lit(-1)))
            return let(hits, lambda known: F.transform(known, lambda h, i: tag(known, h, i)))

        reach = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda s: s["end"]))
        return let(let(reach, listed), spread_hits)

    def spread(real_tags: Column) -> Column:
        special = F.filter(F.transform(tokens, lambda t, j: F.when(t["special"], j)), lambda j: j.isNotNull())

        def place(skipped: Column) -> Column:
            return F.transform(
                tokens,
                lambda t, j: F.when(~t["special"], F.get(real_tags, j - F.size(F.filter(skipped, lambda k: k < j)))),
            )

        return let(special, place)

    real = F.filter(tokens, lambda t: ~t["special"])
    return let(let(let(F.array_sort(spans), leading), lambda o: tagged(real, o)), spread)


def bio_ids(spec: TaskSpec, tags: Column) -> Column:
    """Class ids of tags, ``IGNORE`` for special tokens."""
    return F.transform(tags, lambda t: F.when(t.isNull(), IGNORE).otherwise(class_id(spec, t)).cast("int"))


def decoded(text: Column, tokens: Column, tags: Column) -> Column:
    """Spans of tagged tokens: B opens, I of the same label goes on, an orphan I opens, O closes, specials pass.

    Whether a token goes on a span is told by the token before it, so spans are pairs of first and last tokens.
    """
    pairs = F.arrays_zip(tokens.alias("token"), tags.alias("tag"))
    told = F.filter(pairs, lambda p: ~p["token"]["special"] & p["tag"].isNotNull())

    def label(tag: Column) -> Column:
        return F.substring(tag, F.lit(3), F.length(tag))

    def spans_of(real: Column, chars: Column) -> Column:
        def goes_on(i: Column) -> Column:
            own, last = F.get(real, i)["tag"], F.get(real, i - 1)["tag"]
            same = F.startswith(own, F.lit("I")) & (last != OUTSIDE) & (label(own) == label(last))
            return F.coalesce(same, F.lit(False))

        inside = F.filter(F.transform(real, lambda p, i: F.when(p["tag"] != OUTSIDE, i)), lambda i: i.isNotNull())
        starts = F.filter(inside, lambda i: ~goes_on(i))
        ends = F.filter(inside, lambda i: ~goes_on(i + 1))

        def span(a: Column, b: Column) -> Column:
            first, last = F.get(real, a), F.get(real, b)
            return F.struct(first["token"]["start"].alias("start"), last["token"]["end"].alias("end"), label(first["tag"]).alias("label"))

        return F.transform(F.zip_with(starts, ends, span), lambda s: trimmed(chars, s))

    return let(told, lambda real: let(characters(text), lambda chars: spans_of(real, chars)))


def span_scores(found: Column, tokens: Column) -> Column:
    """Mean ``prob`` of the tokens that each span overlaps, 0 without any.

    Tokens and spans are in order and apart, so the tokens of a span are a run: it is found by the places where tokens
    start and end.
    """

    def all_scores(real: Column, first: Column) -> Column:
        def score(s: Column) -> Column:
            a = F.get(first, s["start"])
            b = F.coalesce(F.get(first, s["end"] - 1), F.size(real) - 1)
            own = F.filter(F.slice(real, a + 1, b - a + 1), lambda t: (t["start"] < s["end"]) & (t["end"] > s["start"]))
            total = F.aggregate(own, F.lit(0.0), lambda x, t: x + t["prob"])
            return F.when(F.size(own) > 0, total / F.size(own))

        return F.transform(found, lambda s: F.coalesce(F.when(s["start"] < s["end"], score(s)), F.lit(0.0)))

    def listed(real: Column) -> Column:
        # the first token that ends after each place
        ends = F.transform(real, lambda t, j: F.array_repeat(j, t["end"] - F.coalesce(F.get(real, j - 1)["end"], F.lit(0))))
        return let(F.flatten(ends), lambda first: all_scores(real, first))

    return let(F.filter(tokens, lambda t: ~t["special"]), listed)


def unreachable(text: Column, spans: Column, tokens: Column) -> Column:
    """How many gold spans no tagging of the tokens can express: a boundary is no token's, trimmed or not.

    Tokens are in order and apart. The token at a boundary is found by its place, so the cost is that of the text.
    """

    def lost(real: Column, chars: Column, first: Column) -> Column:
        # tokens are only trimmed at boundaries that are not theirs
        def starts(s: Column) -> Column:
            own, before = F.get(real, F.get(first, s["start"])), F.get(real, F.get(first, s["start"] - 1))
            blank = (before["end"] == s["start"]) & (trim(chars, before)["start"] == s["start"])
            return (
                F.when(own["start"] == s["start"], True)
                .when(trim(chars, own)["start"] == s["start"], True)
                .otherwise(F.coalesce(blank, F.lit(False)))
            )

        def ends(s: Column) -> Column:
            own = F.get(real, F.get(first, s["end"] - 1))
            return F.when(own["end"] == s["end"], True).otherwise(F.coalesce(trim(chars, own)["end"] == s["end"], F.lit(False)))

        return F.size(F.filter(spans, lambda s: ~(starts(s) & ends(s))))

    def trim(chars: Column, t: Column) -> Column:
        return trimmed(chars, F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("").alias("label")))

    def counted(real: Column) -> Column:
        ends = F.transform(real, lambda t, j: F.array_repeat(j, t["end"] - F.coalesce(F.get(real, j - 1)["end"], F.lit(0))))
        return let(characters(text), lambda chars: let(F.flatten(ends), lambda first: lost(real, chars, first)))

    return F.when(F.size(spans) == 0, 0).otherwise(let(F.filter(tokens, lambda t: ~t["special"] & (t["start"] < t["end"])), counted))


def needs_characters(spans: int, lost: int, limit: float = 0.01) -> bool:
    """Whether so many spans are unreachable that tokens should be single characters."""
    return spans > 0 and lost / spans > limit
