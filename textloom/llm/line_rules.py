"""Quality rules: base counts, and lines labelled by a linear-chain conditional random field.

The base counts (words, symbols, repeated lines and words) reject documents that are too short or too repetitive.
For all others every line is labelled content or boilerplate by Viterbi decoding of a two-state chain, over line features
(shares of symbols, capitals, digits and marks, repetition, lengths, position, and whether the line is one of those that
the fit saw in several documents). A document stays when the lines decoded as content hold at least ``MIN_CONTENT`` of
its words.

Only documents have labels, so the states of the fit's lines are latent. They begin as their document's label says,
save that a line which ``RECURS`` documents and more share (copies of a document counting once) is boilerplate wherever
it stands. Then ``EM_ROUNDS`` times the chain is fitted and the states are read off its posteriors anew, under what the
label says: in a good document recurring lines stay boilerplate and at least half of the words are content, in a bad one
at most half. So lines of one document take different states, and moves between them are learned. The fit takes
at most ``FIT_DOCS`` labelled documents, all their lines.

Defined results: null and empty texts have all counts 0 and fail the base rules; repeated rows are judged each;
without labels of both kinds the chain calls every line content; an empty table gives an empty result; other
columns pass through ``judge`` untouched (``keep`` returns the input's columns only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chain, sampling
from textloom.llm.wordcodes import CONTINUES, Texts, owners, per_text, repeated, slices, windows

FIT_DOCS = 3000
#: Bytes of text measured at once.
SLICE = 1 << 20
MIN_CONTENT = 0.5
RECURS = 3
EM_ROUNDS = 3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
#: Upper edges of the bins of a line feature that is a share.
EDGES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
N_SHARES = 7
N_FEATURES = N_SHARES * (len(EDGES) + 1) + 8 + 8 + 3 + 2 + 1

def _kind(*codes: int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


#: Symbols, capitals, digits, and two kinds of marks.
_KINDS = [_kind(*map(ord, SYMBOLS)), _kind(*range(65, 91)), _kind(*range(48, 58)), _kind(*map(ord, "!?")), _kind(*map(ord, ".,;:"))]


class Measured:
    """The counts and the line features of a slice of texts."""

    def __init__(self, texts: Texts) -> None:
        off = texts.off
        start, end, first = texts.spans()
        self.n_words = np.diff(first)
        continued = texts.tally(CONTINUES)
        word_chars = end - start - continued.between(start, end)
        self.word_chars = per_text(first, word_chars)
        kinds = [texts.tally(kind) for kind in _KINDS]
        self.n_symbols = kinds[0].between(off[:-1], off[1:])

        owner = owners(first)
        codes = texts.hashes(start, end)
        triples, inside = windows(codes, first, 3)
        at = np.flatnonzero(inside)
        many = np.zeros(len(codes) + 3, dtype=bool)
        twice = at[repeated(triples[at], owner[at])[0]]
        for k in range(3):
            many[twice + k] = True
        many = many[: len(codes)]
        self.n_repeat_words = per_text(first, many)

        l_start, l_end, l_first = texts.lines()
        line_word = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
        words = line_word[1] - line_word[0]
        l_owner = owners(l_first)
        real = np.flatnonzero(words > 0)
        again = np.zeros(len(words), dtype=bool)
        self.line_codes = texts.hashes(l_start[real], l_end[real])
        again[real] = repeated(self.line_codes, l_owner[real])[1]
        self.n_dup_lines = per_text(l_first, again)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > 50 * self.n_words)

        self.line_words = words[real]
        self.line_first = np.searchsorted(real, l_first)
        self.features = self._lines(
            np.stack([kind.between(l_start[real], l_end[real]) for kind in kinds], axis=1),
            l_end[real] - l_start[real] - continued.between(l_start[real], l_end[real]),
            np.concatenate([[0], np.cumsum(word_chars)])[np.stack(line_word)[:, real]],
            np.concatenate([[0], np.cumsum(many)])[np.stack(line_word)[:, real]],
            np.concatenate([[0], np.cumsum(np.concatenate([[False], codes[1:] == codes[:-1]])[: len(codes)])])[
                np.stack(line_word)[:, real]
            ],
            again[real],
        )

    def _lines(self, kinds, chars, word_chars, many, stutters, again) -> np.ndarray:
        """Bins of the line features, as columns to sum weights over."""
        words, chars = np.maximum(self.line_words, 1), np.maximum(chars, 1)
        per_char = kinds[:, :4] / chars[:, None]
        per_word = np.stack([kinds[:, 4], many[1] - many[0], stutters[1] - stutters[0]], axis=1) / words[:, None]
        bins = np.searchsorted(EDGES, np.concatenate([per_char, per_word], axis=1), side="left")
        columns = [bins + np.arange(N_SHARES) * (len(EDGES) + 1)]
        base = N_SHARES * (len(EDGES) + 1)
        columns.append(base + np.minimum(np.log2(words).astype(int), 7)[:, None])
        mean = (word_chars[1] - word_chars[0]) / words
        columns.append(base + 8 + np.minimum(mean / 2, 7).astype(int)[:, None])
        place = np.ones(len(words), dtype=int)
        place[self.line_first[:-1][np.diff(self.line_first) > 0]] = 0
        columns.append(base + 16 + np.where(again, 2, place)[:, None])
        columns.append(np.full((len(words), 1), N_FEATURES - 3))  # KNOWN, until a model marks it
        columns.append(np.full((len(words), 1), N_FEATURES - 1))
        return np.concatenate(columns, axis=1).astype(np.int16)


def recurring(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Codes of the lines of ``RECURS`` documents and more; documents with the same least line (copies) count once."""
    some = np.diff(first) > 0
    least = np.zeros(len(some), dtype=np.uint64)
    least[some] = np.minimum.reduceat(codes, first[:-1][some])
    pairs = np.unique(np.stack([codes, least[owners(first)]], axis=1), axis=0)
    found, count = np.unique(pairs[:, 0], return_counts=True)
    return found[count >= RECURS]


def constrained(chance: np.ndarray, words: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which lines are content: the likely ones, and as many more or fewer as the documents' labels ask for."""
    content = chance > 0.5
    owner = owners(first)
    order = np.lexsort((np.where(label[owner] == 1, -chance, chance), owner))
    runs = np.diff(first)[np.diff(first) > 0]
    ahead = np.cumsum(words[order]) - words[order]
    ahead -= np.repeat(ahead[first[:-1][np.diff(first) > 0]], runs)
    # lines in the order in which the label claims them, until it has half of the words
    claimed = np.zeros(len(words), dtype=bool)
    claimed[order] = 2 * ahead < per_text(first, words)[owner[order]]
    claimed &= (chance > 0) | (label[owner] == 0)
    return np.where(label[owner] == 1, content | claimed, content & ~claimed)


class LineModel:
    """Weights of the line features, moves between the two states, the states at the start, and known recurring lines."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray, known: np.ndarray | None = None) -> None:
        self.weights, self.trans, self.start = weights, trans, start
        self.known = np.zeros(0, dtype=np.uint64) if known is None else known

    @classmethod
    def neutral(cls) -> LineModel:
        """Calls every line content."""
        model = cls(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
        model.weights[-1, CONTENT] = 1.0
        return model

    @classmethod
    def latent(cls, features, first, label, codes, words) -> LineModel:
        """Learn from documents ``first`` of labels (1 is good) whose line states are not known."""
        known = recurring(codes, first)
        template = np.isin(codes, known)
        features[:, -2] += template
        owner = owners(first)
        good = label[owner] == 1
        state = np.where(good & ~template, CONTENT, BOILERPLATE)
        for turn in range(EM_ROUNDS):
            model = cls.fitted(features, first, state, 60 if turn < EM_ROUNDS - 1 else 150)
            chance = chain.posteriors(model.scores(features), first, model.trans, model.start)[:, CONTENT]
            chance[good & template] = 0.0
            state = np.where(constrained(chance, words, first, label), CONTENT, BOILERPLATE)
        model.known = known
        return model

    @classmethod
    def fitted(cls, features: np.ndarray, first: np.ndarray, state: np.ndarray, rounds: int = 150) -> LineModel:
        """Maximum likelihood with a small ridge, by gradient ascent; both states weigh the same in sum."""
        model = cls(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
        gold = np.eye(2)[state]
        count = np.maximum(gold.sum(axis=0), 1)
        weigh = (len(state) / (2 * count))[state]
        inner = np.ones(len(state), dtype=bool)
        heads = first[:-1][np.diff(first) > 0]
        inner[heads] = False
        right = np.flatnonzero(inner)
        moves = np.zeros((2, 2))
        np.add.at(moves, (state[right - 1], state[right]), 1)
        climb = chain.adam((N_FEATURES + 3, 2))
        next(climb)
        for _ in range(rounds):
            scores = model.scores(features)
            marginal = chain.posteriors(scores, first, model.trans, model.start)
            gap = (gold - marginal) * weigh[:, None]
            grad = np.stack(
                [
                    np.bincount(features.ravel(), np.repeat(gap[:, s], features.shape[1]), N_FEATURES)
                    for s in (CONTENT, BOILERPLATE)
                ],
                axis=1,
            )
            expected = chain.pair_counts(scores, marginal, first, model.trans)
            grad = np.concatenate([grad, moves - expected, gap[heads].sum(axis=0)[None]]) / len(state)
            grad -= 1e-4 * np.concatenate([model.weights, model.trans, model.start[None]])
            step = 0.05 * climb.send(grad)
            model.weights += step[:N_FEATURES]
            model.trans += step[N_FEATURES:-1]
            model.start += step[-1]
        return model

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Score of each state for each line."""
        return self.weights[features].sum(axis=1)

    def boilerplate(self, measured: Measured) -> np.ndarray:
        """The decoded state of each line that has a word."""
        measured.features[:, -2] += np.isin(measured.line_codes, self.known)
        scores = self.scores(measured.features)
        return chain.viterbi(scores, measured.line_first, self.trans, self.start)


_FIT_SCHEMA = "doc_id long, label int, features binary, codes binary, words binary"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), SLICE):
            m = Measured(texts)
            told = (m.features, m.line_codes, m.line_words.astype(np.int64))
            cuts = list(zip(m.line_first[:-1], m.line_first[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[texts.lo : texts.hi].cast(pa.int64()),
                    batch.column("label")[texts.lo : texts.hi].cast(pa.int32()),
                    *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in told),
                ],
                names=["doc_id", "label", "features", "codes", "words"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_DOCS) -> LineModel:
    """Learn the chain from at most ``limit`` labelled documents."""
    sample = sampling.labelled_texts(docs, labels, label, limit)
    rows = sorted(sample.mapInArrow(_line_features, _FIT_SCHEMA).collect())
    rows = [r for r in rows if r["codes"]]
    if len({r["label"] for r in rows}) < 2:
        return LineModel.neutral()
    columns = N_SHARES + 5
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), dtype=kind)
    features = joined("features", np.int16).reshape(-1, columns).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(r["codes"]) // 8 for r in rows])])
    good = np.array([int(r["label"] > 0) for r in rows])
    return LineModel.latent(features, first, good, joined("codes", np.uint64), joined("words", np.int64))


def judge(docs: DataFrame, model: LineModel, text: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``content_share`` and ``kept``."""
    added = {c: "long" for c in _COUNTS} | {"base_failed": "boolean", "content_share": "double", "kept": "boolean"}
    plain = docs.drop(*added)
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(names.index(text)), SLICE):
                m = Measured(texts)
                content = (model.boilerplate(m) == CONTENT) * m.line_words
                share = per_text(m.line_first, content) / np.maximum(m.n_words, 1)
                out = [getattr(m, c) for c in _COUNTS]
                out += [m.base_failed, share, ~m.base_failed & (share >= min_content)]
                rows = batch.slice(texts.lo, len(texts))
                arrays = [*rows.columns, *(pa.array(x) for x in out)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    schema = plain.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema
    return plain.mapInArrow(run, schema)


def keep(docs: DataFrame, model: LineModel, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return judge(docs, model, text).filter("kept").select(*docs.columns)


def op7_line_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cols = ["doc_id", *_COUNTS, "base_failed", "kept", "content_share"]
    return judge(docs, model).select(*[F.col(c) for c in cols])
