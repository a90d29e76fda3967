"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last one is what is left). Every passage is encoded: the mean
of learned vectors of its words (hashed to ``BUCKETS``), and shares of character kinds, word lengths, repetition in the
passage and in the document, standardized; both pass through a learned layer. Gated attention (tanh times sigmoid) gives each passage a weight; the weights of a document sum to 1,
and the weighted sum of its passages' encodings is scored by a logistic unit. Only documents have labels; which
passages matter is learned with the rest, by gradient ascent over at most ``FIT_DOCS`` labelled documents that are not
held out, both labels weighing the same.

Defined results: null and empty texts are one passage without words and get that passage's score; without labels of
both kinds every score is the share of label 1 (0.5 without labels); repeated rows are scored each; an empty table
gives an empty result; other columns pass through ``score`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chain, sampling
from textloom.llm.wordcodes import CONTINUES, Texts, owners, repeated, slices, windows

FIT_DOCS = 3000
#: Bytes of text measured at once.
SLICE = 1 << 20
PASSAGE = 64
HIDDEN = 24
GATE = 12
THRESHOLD = 0.7
BUCKETS = 1 << 13
#: Length of a word's vector, and what keeps the vectors of rare words small.
VECTOR = 8
RIDGE = 1e-5
ROUNDS = 80
#: The mean of many vectors is small beside standardized features.
WORD_SCALE = 4.0

def _kind(codes: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in codes]] = True
    return table


_KINDS = [
    _kind(c)
    for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!?", ".,;:", "\"'()[]{}/\\=+-_@^~`", "\n")
]
N_FEATURES = 14


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of every passage, buckets of all words in order, words of each passage, and ``first``.

    Text ``i`` has the passages ``first[i]:first[i + 1]``.
    """
    start, end, first = texts.spans()
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    p_first = np.concatenate([[0], np.cumsum(n_passages)])
    rank = np.arange(p_first[-1]) - np.repeat(p_first[:-1], n_passages)
    lo = np.repeat(first[:-1], n_passages) + rank * PASSAGE
    hi = np.minimum(lo + PASSAGE, np.repeat(first[1:], n_passages))
    words = np.maximum(hi - lo, 0)
    some = np.maximum(words, 1)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[hi] - sums[lo]

    continued = texts.tally(CONTINUES)
    byte_lo = np.where(words > 0, np.append(start, 0)[np.minimum(lo, len(start))], 0)
    byte_hi = np.where(words > 0, np.append(end, 0)[np.maximum(hi - 1, 0)], 0)
    chars = np.maximum(byte_hi - byte_lo - continued.between(byte_lo, byte_hi), 1)
    kinds = np.stack([texts.tally(kind).between(byte_lo, byte_hi) for kind in _KINDS], axis=1)
    shares = np.sqrt(kinds / chars[:, None])
    length = end - start - continued.between(start, end)
    mean = total(length) / some
    spread = np.sqrt(np.maximum(total(length * length) / some - mean * mean, 0))
    codes, owner = texts.hashes(start, end), owners(first)
    triples, inside = windows(codes, first, 3)
    at = np.flatnonzero(inside)
    triple_again = np.zeros(len(codes), dtype=bool)
    triple_again[at] = repeated(triples[at], owner[at])[1]
    stutter = np.zeros(len(codes), dtype=bool)
    stutter[1:] = codes[1:] == codes[:-1]
    in_passage = np.repeat(np.arange(len(lo)), words)
    distinct = 1 - total(repeated(codes, in_passage)[1]) / some
    columns = [
        mean / 8, spread / 4, np.log1p(words) / 4, np.log1p(np.repeat(n_words, n_passages)) / 8,
        total(triple_again) / some, total(stutter) / some, distinct,
    ]
    x = np.concatenate([shares, np.stack(columns, axis=1)], axis=1).astype(np.float32)
    return x, (codes % np.uint64(BUCKETS)).astype(np.uint16), words, p_first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gated attention and the logistic unit on the weighted encoding."""

    SHAPES = (
        ("words", (BUCKETS, VECTOR)), ("encode", (N_FEATURES + VECTOR, HIDDEN)), ("shift", (HIDDEN,)), ("tanh", (HIDDEN, GATE)), ("gate", (HIDDEN, GATE)),
        ("attend", (GATE,)), ("out", (HIDDEN,)), ("bias", (1,)),
    )

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = {name: rng.normal(0, 1 / np.sqrt(shape[0]), shape) for name, shape in self.SHAPES}
        self.w["shift"][:] = self.w["bias"][:] = 0
        self.w["words"] *= 0.1
        self.constant: float | None = None

    def forward(self, x, words, sizes, first) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Probability of label 1 for each document, and what the gradient needs."""
        w, begin = self.w, first[:-1]
        some = np.maximum(sizes, 1)
        meaning = np.zeros((len(x), VECTOR))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            meaning[full] = np.add.reduceat(w["words"][words], starts, axis=0) / some[full, None]
        z = np.concatenate([(x - self.mean) / self.scale, WORD_SCALE * meaning], axis=1)
        h = np.tanh(z @ w["encode"] + w["shift"])
        a, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        e = (a * g) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), np.diff(first)))
        alpha = e / np.repeat(np.add.reduceat(e, begin), np.diff(first))
        bag = np.add.reduceat(alpha[:, None] * h, begin, axis=0)
        return _sigmoid(bag @ w["out"] + w["bias"]), {"z": z, "h": h, "a": a, "g": g, "alpha": alpha, "bag": bag}

    def gradient(self, x, words, sizes, first, label) -> dict[str, np.ndarray]:
        """Of the log-likelihood, both labels weighing the same."""
        share = label.mean()
        weigh = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(label)
        owner, w = owners(first), self.w
        p, s = self.forward(x, words, sizes, first)
        d = (label - p) * weigh
        d_bag = d[:, None] * w["out"]
        d_alpha = (s["h"] * d_bag[owner]).sum(axis=1)
        d_e = s["alpha"] * (d_alpha - np.add.reduceat(s["alpha"] * d_alpha, first[:-1])[owner])
        d_a = d_e[:, None] * w["attend"] * s["g"] * (1 - s["a"] ** 2)
        d_g = d_e[:, None] * w["attend"] * s["a"] * s["g"] * (1 - s["g"])
        d_h = s["alpha"][:, None] * d_bag[owner] + d_a @ w["tanh"].T + d_g @ w["gate"].T
        d_z = d_h * (1 - s["h"] ** 2)
        d_word = WORD_SCALE * (d_z @ w["encode"][N_FEATURES:].T) / np.maximum(sizes, 1)[:, None]
        d_word = np.repeat(d_word, sizes, axis=0)
        return {
            "words": np.stack([np.bincount(words, d_word[:, k], BUCKETS) for k in range(VECTOR)], axis=1),
            "encode": s["z"].T @ d_z, "shift": d_z.sum(axis=0), "tanh": s["h"].T @ d_a, "gate": s["h"].T @ d_g,
            "attend": (s["a"] * s["g"]).T @ d_e, "out": s["bag"].T @ d, "bias": np.array([d.sum()]),
        }

    def learn(self, x, words, sizes, first, label, rounds: int = ROUNDS) -> AttentionModel:
        """Gradient ascent with a ridge."""
        climbs = {name: chain.adam(shape) for name, shape in self.SHAPES}
        for climb in climbs.values():
            next(climb)
        for _ in range(rounds):
            grads = self.gradient(x, words, sizes, first, label)
            for name, climb in climbs.items():
                ridge = RIDGE if name == "words" else 1e-4
                self.w[name] = self.w[name] + 0.03 * climb.send(grads[name] - ridge * self.w[name])
        return self

    def predict(self, texts: Texts) -> np.ndarray:
        """The score of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.forward(*passages(texts))[0]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), SLICE):
            x, words, sizes, cut = passages(texts)
            at = np.concatenate([[0], np.cumsum(sizes)])
            cuts = list(zip(cut[:-1], cut[1:], strict=True))
            told = ((x, lambda k: k), (sizes.astype(np.int64), lambda k: k), (words, lambda k: at[k]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[texts.lo : texts.hi].cast(pa.int64()),
                    batch.column("label")[texts.lo : texts.hi].cast(pa.int32()),
                    *(pa.array([y[place(a) : place(b)].tobytes() for a, b in cuts], pa.binary()) for y, place in told),
                ],
                names=["doc_id", "label", "features", "sizes", "words"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_DOCS) -> AttentionModel:
    """Learn from at most ``limit`` labelled documents, from all passages of each."""
    sample = sampling.labelled_texts(docs, labels, label, limit)
    schema = "doc_id long, label int, features binary, sizes binary, words binary"
    rows = sorted(sample.mapInArrow(_encoded, schema).collect())
    found = np.array([float(r["label"] > 0) for r in rows])
    if len(set(found)) < 2:
        model = AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES))
        model.constant = float(found.mean()) if len(found) else 0.5
        return model
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), dtype=kind)
    x = joined("features", np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(r["sizes"]) // 8 for r in rows])])
    model = AttentionModel(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02))
    return model.learn(x, joined("words", np.uint16).astype(np.int64), joined("sizes", np.int64), first, found)


def score(docs: DataFrame, model: AttentionModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    plain = docs.drop("score")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(names.index(text)), SLICE):
                rows = batch.slice(texts.lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(model.predict(texts), pa.float64())], names=[*names, "score"]
                )

    return plain.mapInArrow(run, plain.select("*", F.lit(0.0).alias("score")).schema)


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", sampling.held_out().alias("held_out"), "score", predicted)
