"""Whitening of embeddings along their leading principal components.

A component c of a vector becomes the integer x = floor(SCALE * c) + SHIFT, so
counts, sums and deviations are exact. The leading eigenpairs of the x-vectors'
covariance V (centred, divisor n) come from Chebyshev-filtered subspace
iteration: V is never formed; a product V Q with a thin block Q is one Spark
pass that sums (x - m)((x - m)' Q) per task and then over tasks. Each round
applies a Chebyshev polynomial in V by its three-term recurrence, scaled to
stay in [-1, 1] over the unwanted part of the spectrum and to grow fast beyond
it; then QR and Rayleigh-Ritz. The unwanted interval is taken from the block's
own Ritz values above and from a short Lanczos run below, so a wrong guess
costs rounds, not correctness. Pairs that are sure stay as they are and are
projected out of the others' products. The rounds end when they are certified: the
wanted pairs' residuals ``|V q - e q|`` are at rounding level, and a fresh
random probe, filtered and orthogonal to the block, shows no direction of a
larger eigenvalue outside of it.

Vectors of another length are spaces of their own: ``whiten`` fits each length
by itself (the number of lengths is bounded by ``MAX_LENGTHS``; more raise).
Memory: a task holds one Arrow batch and a (length x block) matrix; sums of
tasks are added in two grouped steps, so the driver gets one matrix a pass.

Edge cases: rows with a null vector, an empty one, or null or non-finite
entries are dropped; a null id is kept as null; repeated rows count and are
returned each; fewer than ``k`` components than asked are returned where the
covariance has a smaller rank (one vector, constant vectors: no rows); an empty
table gives an empty table; other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_blobs, materialize

SCALE = 1024              # x = floor(SCALE * c) + SHIFT
SHIFT = 100_000
COMPONENTS = 8
GUARD = 24                # further directions in the block, so that the last wanted one is well apart
DEGREE = 12               # degree of the filter's polynomial, passes a round
ROUNDS = 40               # most rounds
CLOSE = 2e-13             # residual of a certified pair, as a share of the largest eigenvalue
LANCZOS = 12              # steps of the run that places the lower end of the spectrum
RANK = 1e-12              # eigenvalues below this share of the largest one count as zero
MAX_LENGTHS = 64

_PARTS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])


def integer_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, d, x): rows whose vector is whole and finite, as arrays of longs."""
    v = F.transform(F.col(f"`{vec}`"), lambda c: c.cast("double"))
    big = float(2 ** 52) / SCALE       # beyond it floor(SCALE * c) is no exact long

    def fits(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    rows = df.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    x = F.transform("v", lambda c: F.when(F.abs(c) < big, F.floor(c * SCALE).cast("bigint") + SHIFT)
                    .otherwise(F.raise_error(F.lit("embedding entry beyond the exact range"))
                               .cast("bigint")))
    return rows.select("id", F.size("v").alias("d"), x.alias("x"))


def _matrices(col: pa.Array) -> np.ndarray:
    """Rows of equal length of an Arrow list column."""
    flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return flat[ends[0]:ends[-1]].reshape(len(col), -1)


class Moments(NamedTuple):
    n: int
    sums: np.ndarray      # object array of exact integers
    mean: np.ndarray


def moments(rows: DataFrame, d: int) -> Moments:
    """Number of vectors and their exact sums per dimension (native aggregates)."""
    got = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.zeros(d, object)
    for r in got:                      # d rows
        sums[r.i] = int(r.s)
    n = got[0].n
    # whole part and fraction apart: one rounding, however large the sums
    return Moments(n, sums, np.array([float(int(s) // n) + (int(s) % n) / n for s in sums]))


@dataclass
class Product:
    """Passes ``Q -> V Q`` over the vectors of one length."""

    rows: DataFrame
    moments: Moments
    passes: int = 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        mean, shape = self.moments.mean, q.shape

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(shape)
            for b in batches:
                if b.num_rows:
                    c = _matrices(b.column("x")) - mean
                    total += c.T @ (c @ q)
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "block": [0], "blob": [total.tobytes()]},
                schema=_PARTS)

        def add(a: bytes, b: bytes) -> bytes:
            return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

        got = add_blobs(self.rows.select("x").mapInArrow(part, "part int, block int, blob binary"), add).collect()
        self.passes += 1
        return np.frombuffer(got[0].blob).reshape(shape) / self.moments.n


class Spectrum(NamedTuple):
    values: np.ndarray    # leading eigenvalues, falling
    vectors: np.ndarray   # unit columns
    trace: float
    residual: float       # largest |V q - e q| of the wanted pairs
    passes: int


def _lowest(product, d: int, rng: np.random.Generator) -> tuple[float, float]:
    """Estimates of the smallest and largest eigenvalue by a Lanczos run with
    full reorthogonalisation; the smallest one is lowered by its residual."""
    q = rng.standard_normal((d, 1))
    basis = [q / np.linalg.norm(q)]
    alpha, beta = [], []
    for j in range(min(LANCZOS, d)):
        w = product(basis[-1])
        alpha.append(float((basis[-1].T @ w)[0, 0]))
        block = np.hstack(basis)
        for _ in range(2):
            w = w - block @ (block.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)) or j + 1 == min(LANCZOS, d):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    off = beta[len(alpha) - 1] * abs(vectors[-1])
    return max(0.0, values[0] - off[0]), values[-1] + off[-1]


def _filter(product, q: np.ndarray, low: float, high: float, top: float, degree: int,
            done: np.ndarray) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` for [low, high] in V, applied to
    ``q`` and scaled by its value at ``top`` so that nothing overflows. The
    pairs found already, ``done``, are projected out at every step."""
    def apart(y: np.ndarray) -> np.ndarray:
        return y - done @ (done.T @ y)

    e, c = max((high - low) / 2, 1e-14 * top), (high + low) / 2
    sigma = first = e / max(top - c, e)            # a flat spectrum: nothing to tell apart
    q = apart(q)
    before, now = q, apart(product(q) - c * q) * (first / e)
    for _ in range(2, degree + 1):
        after = 1.0 / (2.0 / first - sigma)
        before, now = now, apart((product(now) - c * now) * (2 * after / e) - (sigma * after) * before)
        sigma = after
    return now


def leading(product, d: int, k: int = COMPONENTS, seed: int = 7) -> Spectrum:
    """The ``k`` leading eigenpairs of the covariance behind ``product``."""
    rng = np.random.default_rng(seed)
    m = min(d, k + GUARD)
    low, _ = _lowest(product, d, rng) if m < d else (0.0, 0.0)
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    want = min(k, m)
    for _ in range(ROUNDS):
        vq = product(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)        # Rayleigh-Ritz
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        if m == d or top == 0.0:                  # the block is the whole space
            break
        off = np.linalg.norm(vq[:, :want] - q[:, :want] * values[:want], axis=0)
        sure = off <= CLOSE * top * np.sqrt(d)
        locked = want if sure.all() else int(np.argmin(sure))
        done, high = q[:, :locked], max(values[-1], low)
        if locked == want:
            # a fresh direction, filtered at the last wanted value: nothing larger may be left
            probe = rng.standard_normal((d, 1))
            last = max(values[want - 1], low, RANK * top)
            probe = _filter(product, probe, low, last, last * (1 + 1e-3), DEGREE, q)
            for _ in range(2):
                probe = probe - q @ (q.T @ probe)
            size = np.linalg.norm(probe)
            if size <= 1e-10 or float((probe.T @ product(probe))[0, 0]) / size ** 2 \
                    <= last + 1e-9 * top:
                break
            q = np.linalg.qr(np.hstack([q[:, :-1], probe / size]))[0]   # a miss: take it in
            continue
        fresh = _filter(product, q[:, locked:], low, high, max(values[locked], high), DEGREE, done)
        q = np.linalg.qr(np.hstack([done, fresh]))[0]
    else:
        raise ArithmeticError(f"not certified after {ROUNDS} rounds")
    vq = product(q[:, :k])
    values = np.einsum("ij,ij->j", q[:, :k], vq)
    residual = float(np.linalg.norm(vq - q[:, :k] * values, axis=0).max())
    keep = values > RANK * max(top, 1e-300)
    return Spectrum(values[keep], q[:, :k][:, keep], 0.0, residual, product.passes)


def total_variance(rows: DataFrame, m: Moments) -> float:
    """Trace of the covariance: centred squares, native aggregate."""
    mean = F.array(*[F.lit(float(v)) for v in m.mean])
    off = F.aggregate(F.zip_with("x", mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    return rows.agg(F.sum(off).alias("s")).first().s / m.n


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 per row, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in sums)
    if most < 2 ** 62:
        y = x * np.int64(n) - sums.astype(np.int64)
        if int(np.abs(y).max(initial=0)) < 2 ** 52 and x.shape[1] < 1024:
            a, b = y >> 26, y & ((1 << 26) - 1)
            hi, mid, lo = (a * a).sum(1), (a * b).sum(1), (b * b).sum(1)
            return [(int(h) << 52) + (int(t) << 27) + int(u) for h, t, u in zip(hi, mid, lo)]
    y = x.astype(object) * n - sums
    return [int(v) for v in (y * y).sum(axis=1)]


def _transform(rows: DataFrame, m: Moments, s: Spectrum, explained: list[float]) -> DataFrame:
    """(id, component, n, deviation, whitened, explained) per row and component."""
    n, sums, mean = m.n, m.sums, m.mean
    turn = s.vectors / np.sqrt(s.values)
    k = turn.shape[1]
    id_type = rows.schema["id"].dataType

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            if not b.num_rows:
                continue
            x = _matrices(b.column("x"))
            w = (x - mean) @ turn
            each = np.repeat(np.arange(len(x)), k)
            dev = [Decimal(v) for v in _deviation(x, n, sums)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(each)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), n, np.int64)),
                 pa.array(dev, pa.decimal128(38, 0)).take(pa.array(each)),
                 pa.array(w.ravel()), pa.array(np.tile(explained, len(x)))],
                names=["id", "component", "n", "deviation", "whitened", "explained"])

    return rows.select("id", "x").mapInArrow(
        out, f"id {id_type.simpleString()}, component int, n bigint, deviation decimal(38,0), "
             "whitened double, explained double")


def _identity_error(rows: DataFrame, m: Moments, s: Spectrum) -> float:
    """Largest entry of the whitened vectors' centred covariance minus the
    identity; tasks' means and centred products are merged exactly."""
    mean, turn, k = m.mean, s.vectors / np.sqrt(s.values), len(s.values)

    def merged(a, b):
        (na, ma, ca), (nb, mb, cb) = a, b
        n, gap = na + nb, mb - ma
        return n, ma + gap * (nb / n), ca + cb + np.outer(gap, gap) * (na * nb / n)

    def pack(t) -> bytes:
        return np.concatenate([[t[0]], t[1], t[2].ravel()]).tobytes()

    def unpack(blob: bytes):
        v = np.frombuffer(blob)
        return v[0], v[1:k + 1], v[k + 1:].reshape(k, k)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                w = (_matrices(b.column("x")) - mean) @ turn
                at = w.mean(axis=0)
                own = float(len(w)), at, (w - at).T @ (w - at)
                total = own if total is None else merged(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "block": [0], "blob": [pack(total)]},
                schema=_PARTS)

    got = add_blobs(rows.select("x").mapInArrow(part, "part int, block int, blob binary"),
                  lambda a, b: pack(merged(unpack(a), unpack(b)))).collect()
    n, _, c = unpack(got[0].blob)
    return float(np.abs(c / n - np.eye(k)).max())


def fit(rows: DataFrame, d: int, k: int = COMPONENTS) -> tuple[Moments, Spectrum]:
    """Moments and leading eigenpairs of the vectors of length ``d``."""
    m = moments(rows, d)
    found = leading(Product(rows, m), d, min(k, d))
    return m, found._replace(trace=total_variance(rows, m))


def whiten(df: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation decimal(38,0), whitened, explained,
    identity_error`` for every vector and each of its ``k`` leading components."""
    spark = df.sparkSession
    rows = materialize(spark, integer_vectors(df, key, vec), "integer_vectors")
    lengths = [r.d for r in rows.select("d").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out = None
    for d in sorted(lengths):
        own = rows.where(F.col("d") == d).select("id", "x")
        m, s = fit(own, d, k)
        if not len(s.values):
            continue
        part = _transform(own, m, s, [float(e / s.trace) for e in s.values]).withColumn(
            "identity_error", F.lit(_identity_error(own, m, s)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        id_type = rows.schema["id"].dataType.simpleString()
        out = spark.createDataFrame([], f"id {id_type}, component int, n bigint, deviation decimal(38,0), "
                                        "whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", key)
