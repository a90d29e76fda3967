"""Embedding whitening by blockwise TSQR and one-sided Jacobi rotations.

1. Count and sums of the rows, exactly, as a Spark aggregate over places of the vectors.
2. TSQR. Rows, centred by exact sums, are compressed in blocks to triangles (QR), the triangles of a task to one, and
   those of all tasks in a tree of ``FAN`` at a time. What is left is one triangle as wide as a vector.
3. The columns of the triangle are orthogonalised by plane rotations, in rounds of disjoint pairs, until all are orthogonal
   to working precision. The rotations accumulate to the components; the lengths of the columns, which no covariance has
   squared, give standard deviations that are accurate for small ones too.
4. Rows are projected on the components, over their standard deviations. The covariance of what comes out is summed in
   centred blocks, merged pairwise, and compared with the identity.

Entries ``c`` become ``floor(64 * c) + 1000000``. Rows go through Arrow; only counts, sums, triangles and centred products
(as wide as a vector, whatever the number of rows) meet on the driver.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped; shorter vectors have entries
of 0 at their end; entries beyond 2^53 count as 2^53; null and repeated ids are rows of their own; components without
variance have null ``whitened`` and take no part in ``identity_error``; ``deviation`` is exact, as a decimal of 38 digits in
the operator and null in the query where it does not fit a long; no rows, or empty vectors only, give no rows; the
operator takes the columns it needs and adds nothing to others.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ensure_checkpoint_dir

SCALE, SHIFT = 64.0, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 32
#: Rows of a block, triangles that one task merges, and rounds of rotations at most.
BLOCK, FAN, SWEEPS = 4096, 64, 60
_BOUND = float(1 << 53)


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x``: vectors without null or non-finite entries, as arrays of longs."""
    entries = F.col(vector).cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(_BOUND)), F.lit(-_BOUND))).cast("long") + SHIFT
    return rows.filter(F.col(vector).isNotNull() & sound).select(F.col(key).alias("id"), F.transform(entries, scaled).alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of longs; the end of shorter ones is zero entries."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    if (size == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(column), width)
    out = np.full((len(column), width), SHIFT, dtype=np.int64)
    at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)
    out[np.repeat(np.arange(len(column)), size), at] = values[offsets[0] : offsets[-1]]
    return out


class Fit:
    """Count and sums of the rows, the components (columns) and their standard deviations."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.components = np.zeros((len(sums), 0))
        self.deviations = np.zeros(0)
        self.trace = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - S`` as exact integers, and ``x - S / n`` as doubles."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        exact = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return exact, exact.astype(np.float64) / self.n

    def whitened(self, centred: np.ndarray, limit: int) -> np.ndarray:
        """Rows on the first ``limit`` components, over the standard deviations; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = centred @ self.components[:, :limit] / self.deviations[:limit]
        return np.where(self.deviations[:limit] > 0, scores, np.nan)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column("x"), width)
        for lo in range(0, len(x), BLOCK):
            yield x[lo : lo + BLOCK]


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """The triangle of a QR decomposition, filled up to ``width`` rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _triangles(fit: Fit):
    """One triangle for all rows of a task."""
    width = len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in _blocks(batches, width):
            centred = fit.centred(x)[1]
            r = _triangle(centred if r is None else np.vstack([r, centred]), width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _merged_triangles(width: int):
    def run(table: pa.Table) -> pa.Table:
        r = None
        for blob in table.column("r").to_pylist():
            own = np.frombuffer(blob, dtype=np.float64).reshape(width, width)
            r = own if r is None else _triangle(np.vstack([r, own]), width)
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    return run


def _tree(parts: DataFrame, merge, column: str) -> bytes | None:
    """Merge one blob of each task to a single one, ``FAN`` at a time."""
    spark = parts.sparkSession
    parts = parts.checkpoint()
    count = parts.count()
    while count > 1:
        groups = -(-count // FAN)
        number = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(groups))
        dealt = parts.withColumn("g", number if groups > 1 else F.lit(0))
        parts = dealt.groupBy("g").applyInArrow(merge, f"{column} binary").checkpoint()
        count = parts.count()
    found = parts.collect()  # one row
    return bytes(found[0][column]) if found else None


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``columns, lengths``: right singular vectors and singular values of ``r``, falling.

    One-sided Jacobi: each round rotates disjoint pairs of columns, and a sweep of rounds meets every pair once. Rotations
    go on until all pairs are orthogonal to working precision.
    """
    width = r.shape[1]
    even = width + width % 2
    a, v = np.zeros((r.shape[0], even)), np.eye(even)
    a[:, :width] = r
    circle = np.arange(even)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(even - 1):
            p, q = circle[: even // 2], circle[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            cosine = np.abs(np.divide(gamma, size, out=np.zeros_like(gamma), where=size > 0))
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-16
            with np.errstate(over="ignore"):
                zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
                t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
            circle = np.concatenate([circle[:1], circle[-1:], circle[1:-1]])
        if worst < 1e-15:
            break
    lengths = np.sqrt((a * a).sum(0))[:width]
    order = np.argsort(-lengths, kind="stable")
    return v[:width, order], lengths[order]


def fit(vectors: DataFrame) -> Fit:
    """Fit on all rows of ``usable``."""
    width = vectors.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    if width <= 0:
        return Fit(0, [])
    placed = vectors.select(F.posexplode("x").alias("place", "c")).groupBy("place")
    sums = placed.agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("c").alias("k")).collect()  # one row a place
    n = vectors.count()
    total = [n * SHIFT] * width
    for row in sums:
        total[row["place"]] = int(row["s"]) + (n - row["k"]) * SHIFT
    found = Fit(n, total)
    blob = _tree(vectors.select("x").mapInArrow(_triangles(found), "r binary"), _merged_triangles(width), "r")
    r = np.frombuffer(blob, dtype=np.float64).reshape(width, width)
    components, lengths = jacobi(r)
    lengths[lengths <= width * np.finfo(np.float64).eps * lengths.max(initial=0.0)] = 0.0
    found.components, found.deviations = components, lengths / np.sqrt(n)
    found.trace = float((found.deviations**2).sum())
    return found


def _moments(fitted: Fit, limit: int):
    """Count, mean and centred products of the whitened rows of a task."""
    width = len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for x in _blocks(batches, width):
            w = np.nan_to_num(fitted.whitened(fitted.centred(x)[1], limit))
            mean = w.mean(0)
            state = _together(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_blob(state)], pa.binary())], names=["m"])

    return run


def _together(a, b):
    """Moments of two sets of rows as one."""
    if a is None:
        return b
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _blob(state) -> bytes:
    return np.concatenate([[float(state[0])], state[1], state[2].ravel()]).tobytes()


def _state(blob: bytes, limit: int):
    values = np.frombuffer(blob, dtype=np.float64)
    return values[0], values[1 : limit + 1], values[limit + 1 :].reshape(limit, limit)


def _merged_moments(limit: int):
    def run(table: pa.Table) -> pa.Table:
        state = None
        for blob in table.column("m").to_pylist():
            state = _together(state, _state(blob, limit))
        return pa.table({"m": pa.array([_blob(state)], pa.binary())})

    return run


def identity_error(vectors: DataFrame, fitted: Fit, limit: int) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, over components with variance."""
    limit = min(limit, int((fitted.deviations > 0).sum()))
    if not limit:
        return 0.0
    blob = _tree(vectors.select("x").mapInArrow(_moments(fitted, limit), "m binary"), _merged_moments(limit), "m")
    n, _, products = _state(blob, limit)
    return float(np.abs(products / n - np.eye(limit)).max())


def _rows(fitted: Fit, limit: int, error: float):
    width = len(fitted.sums)
    explained = fitted.deviations[:limit] ** 2 / fitted.trace if fitted.trace > 0 else np.zeros(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                exact, centred = fitted.centred(_matrix(part.column("x"), width))
                most = int(np.abs(exact).max(initial=0))
                if most * most * width >= 1 << 63:
                    exact = exact.astype(object)
                squares = (exact * exact).sum(axis=1)
                n = len(centred)
                white = fitted.whitened(centred, limit).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(np.repeat(np.arange(n), limit))),
                        pa.array(np.tile(np.arange(1, limit + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * limit, fitted.n)),
                        pa.array([Decimal(int(d)) for d in squares], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(n), limit))),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * limit, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every usable row and component."""
    ensure_checkpoint_dir(rows.sparkSession)
    vectors = usable(rows, key, vector)
    kind = vectors.schema["id"].dataType.simpleString()
    fitted = fit(vectors)
    limit = min(components, len(fitted.sums))
    error = identity_error(vectors, fitted, limit)
    fields = (
        f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    return vectors.mapInArrow(_rows(fitted, limit, error), fields).withColumnRenamed("id", key)


def op12_tsqr_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 32 components, each with variance 1."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(rows).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
