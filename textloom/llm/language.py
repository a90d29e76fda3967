"""Language identification by a linear-chain conditional random field over words.

Words are labelled one by one, so code-switched text gets a language for each word: the score of a word sums learned
weights of its letter pairs and triples (with its boundaries), its first and last three letters and the word itself
(a hashed lexicon), moves between languages have learned weights, and forward-backward gives each word's
probabilities. A text's language is the one with the largest sum over its words; the score is its share.

The chain is fitted on all words of at most ``FIT_DOCS`` documents of each language that the documents not held out
have, however rare. As these have one language each, their words are cut into short pieces that are joined into
code-switched sequences, so that moves are learned too. Words without a letter say nothing and take their language from
their neighbours.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the first language in
order; repeated rows are judged each; when nothing can be learned every text is ``und``; an empty table gives an empty
result; other columns pass through ``identify`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chain, sampling
from textloom.llm.wordcodes import LOWER, Texts, per_text, slices

#: Documents of each language that the fit takes at most.
FIT_DOCS = 150
BUCKETS = 1 << 16
PIECE = 12
KINDS = 5  # pairs, triples, first letters, last letters, words
SLICE = 2 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)
_EDGE = 32


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case (ASCII and Latin-1 letters), with everything that is no letter as a boundary."""
    low = LOWER[data]
    accented = np.zeros(len(data), dtype=bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = low + (accented * np.uint8(0x20)).astype(np.uint8)
    return np.where(_LETTER[data], low, np.uint8(_EDGE))


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the words of a slice.

    ``grams`` (2 x bytes + 1): buckets of the pair and triple that begin at each byte, the first entry standing for a
    boundary before the slice. ``whole`` (3 x words): buckets of first letters, last letters and the word.
    ``start, end, first`` as in ``Texts.spans``.
    """
    start, end, first = texts.spans()
    low = letters(texts.data)
    padded = np.full(len(low) + 3, _EDGE, dtype=np.int64)
    padded[1:-2] = low
    # a gram ends with its word: what follows a boundary is not seen
    second = padded[1:-1]
    third = np.where(second[:] == _EDGE, _EDGE, padded[2:])
    head = padded[:-2]
    pair = head * 256 + second
    triple = ((pair * 256 + third) * 0x9E3779B1 >> 8) % BUCKETS
    word = (texts.hashes(start, end, LOWER) % np.uint64(BUCKETS)).astype(np.int64)
    n = len(low)

    def at(index: np.ndarray) -> np.ndarray:
        inside = (index >= start) & (index < end)
        return np.where(inside, low[np.clip(index, 0, max(n - 1, 0))], _EDGE).astype(np.int64) if n else index

    def three(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
        return (((a * 256 + b) * 256 + c + salt) * 0x9E3779B1 >> 8) % BUCKETS

    front = three(at(start), at(start + 1), at(start + 2), 1 << 25)
    rear = three(at(end - 3), at(end - 2), at(end - 1), 1 << 26)
    return np.stack([pair, triple]), np.stack([front, rear, word]), start, end, first


class LanguageModel:
    """``weights``: kinds x buckets x languages; ``trans`` and ``start``: moves and first languages."""

    def __init__(self, names: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        self.names, self.weights, self.trans, self.start = names, weights.astype(np.float32), trans, start

    def scores(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each word's languages, whether the word has a letter, and ``first``."""
        grams, whole, start, end, first = features(texts)
        total = np.zeros((len(start), len(self.names)), dtype=np.float32)
        if len(start):
            byte = self.weights[0][grams[0]] + self.weights[1][grams[1]]
            sums = np.zeros((len(byte) + 1, byte.shape[1]), dtype=np.float64)
            np.cumsum(byte, axis=0, out=sums[1:])
            # entry 0 is the boundary before the slice, so the grams of start - 1 .. end - 1 are start .. end
            total += (sums[end + 1] - sums[start]).astype(np.float32)
            for kind in range(3):
                total += self.weights[2 + kind][whole[kind]]
        lettered = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])
        has_letter = lettered[end] > lettered[start]
        total[~has_letter] = 0
        return total, has_letter, first

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        scores, has_letter, first = self.scores(texts)
        marginal = chain.posteriors(scores, first, self.trans, self.start) * has_letter[:, None]
        sums = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(marginal, axis=0, dtype=np.float64)])
        by_text = sums[first[1:]] - sums[first[:-1]]
        known = per_text(first, has_letter) > 0
        plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])[texts.off]
        for i in np.flatnonzero(known & (plain[1:] == plain[:-1])):  # bytes over 127 may be marks as well as letters
            known[i] = any(map(str.isalpha, bytes(texts.data[texts.off[i] : texts.off[i + 1]]).decode()))
        best = by_text.argmax(axis=1)
        share = by_text[np.arange(len(best)), best] / np.maximum(by_text.sum(axis=1), 1e-9)
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def _pieces(n_words: list[int], n_languages: int, language: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A joined order of words: pieces of each document in turn, languages changing by a fixed pattern."""
    rng = np.random.default_rng(7)
    cut: list[list[np.ndarray]] = [[] for _ in range(n_languages)]
    base = 0
    for n, lang in zip(n_words, language, strict=True):
        cut[lang].extend(np.array_split(np.arange(base, base + n), max(1, n // PIECE)))
        base += n
    for pieces in cut:
        rng.shuffle(pieces)
    # languages take turns, so that all weigh about the same; a short supply is used again
    order: list[np.ndarray] = []
    for i in range(max(map(len, cut))):
        for pieces in cut:
            order.append(pieces[i % len(pieces)])
    rng.shuffle(order)
    joined = np.concatenate(order)
    return joined, np.arange(0, len(joined) + 64, 64).clip(max=len(joined))


def fitted(rows: list[tuple[int, str, str]], rounds: int = 40) -> LanguageModel | None:
    """Learn from rows of (doc_id, text, language)."""
    names = sorted({r[2] for r in rows})
    if not names:
        return None
    texts = next(slices(pa.array([r[1] for r in rows], pa.large_string()), 1 << 62))
    grams, whole, start, end, first = features(texts)
    k = len(names)
    language = [names.index(r[2]) for r in rows]
    joined, bounds = _pieces(np.diff(first).tolist(), k, language)
    bounds = np.unique(bounds)
    gold = np.repeat(language, np.diff(first))[joined]
    used, inverse = np.unique(joined, return_inverse=True)
    # one row for each feature of each used word
    width = end[used] - start[used] + 1
    owner = np.repeat(np.arange(len(used)), width)
    inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start[used], width)
    parts = [(owner, grams[0][inside]), (owner, grams[1][inside])]
    parts += [(np.arange(len(used)), whole[kind][used]) for kind in range(3)]
    flat_owner = np.concatenate([p[0] for p in parts])
    flat = np.concatenate([p[1] + kind * BUCKETS for kind, p in enumerate(parts)])
    seen, flat = np.unique(flat, return_inverse=True)
    weights, trans, begin = np.zeros((len(seen), k)), np.zeros((k, k)), np.zeros(k)
    truth = np.eye(k)[gold]
    inner = np.ones(len(joined), dtype=bool)
    inner[bounds[:-1]] = False
    right = np.flatnonzero(inner)
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[right - 1], gold[right]), 1)
    climb, climb_moves = chain.adam(weights.shape), chain.adam((k, k))
    next(climb), next(climb_moves)
    lettered = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])
    has_letter = (lettered[end] > lettered[start])[used]
    for _ in range(rounds):
        word = np.stack([np.bincount(flat_owner, weights[flat, s], len(used)) for s in range(k)], axis=1)
        word[~has_letter] = 0
        scores = word[inverse]
        marginal = chain.posteriors(scores, bounds, trans, begin)
        gap = truth - marginal
        by_word = np.stack([np.bincount(inverse, gap[:, s], len(used)) for s in range(k)], axis=1)
        by_word[~has_letter] = 0
        grad = np.stack([np.bincount(flat, by_word[flat_owner, s], len(seen)) for s in range(k)], axis=1)
        weights += 0.05 * climb.send(grad - 0.05 * weights)
        trans += 0.05 * climb_moves.send(moves - chain.pair_counts(scores, marginal, bounds, trans) - 0.05 * trans)
    full = np.zeros((KINDS * BUCKETS, k))
    full[seen] = weights
    return LanguageModel(names, full.reshape(KINDS, BUCKETS, k), trans, begin)


def fit(docs: DataFrame, limit: int = FIT_DOCS) -> LanguageModel | None:
    """Learn from ``text`` and ``lang`` of at most ``limit`` documents of each language, none of them held out."""
    sample = sampling.texts_of_each(docs, "lang", limit).orderBy("doc_id")
    return fitted([(r["doc_id"], r["text"], r["label"]) for r in sample.collect()])


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    plain = docs.drop("lang_pred", "score")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(names.index(text)), SLICE):
                pred, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
                rows = batch.slice(texts.lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*names, "lang_pred", "score"],
                )

    schema = plain.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return plain.mapInArrow(run, schema)


def op8_word_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", sampling.held_out().alias("held_out"), "lang_pred", "score")
