"""Nearest neighbours by cosine: probed lists scanned in dimension blocks.

Vectors are scaled to length one and turned by a random rotation, so the
distance over the first d of D dimensions, times D / d, estimates the whole
distance. Rows are put into lists around centroids (fitted on a bounded
sample; every row is indexed). A query scans its nearest lists block by block:
after d dimensions a candidate is given up if its estimate is beyond
``(1 + EPS / sqrt(d))**2`` times the query's threshold, the hypothesis that it
is among the nearest being unlikely then. The threshold is the k-th best whole
distance of the 8 k candidates that look nearest after the first block. What is
left at the end is scored exactly: cosine of the original vectors, in doubles.

Lists are cut into cells of at most about ``CELL`` candidates and ``QUERIES``
queries, however the vectors crowd; cells are independent tasks, and the best
k of each meet per query.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite
components, take no part; those of one length are searched among themselves
(more than ``MAX_LENGTHS`` lengths raise); equal scores go to the smaller id;
every query row has its own neighbours, also where ids repeat, and rows of a
query's id are no neighbours of it; an empty table gives an empty result; other
columns take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 8_192            # most vectors the centroids are fitted on
MAX_LISTS = 1_024
PROBE = 0.7               # share of the lists that a query probes
BLOCK = 16                # dimensions of a block
EPS = 2.1
CELL = 4_096              # candidates of a cell
QUERIES = 1_024           # queries of a cell
MAX_LENGTHS = 64          # most lengths of vectors


def usable(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    return F.coalesce(v.isNotNull() & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x)
                                               & (F.abs(x) < float("inf")))
                      & F.exists(d, lambda x: x != 0.0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of extreme size brought near one, so that squares stay finite."""
    top = np.abs(x).max(axis=1, keepdims=True)
    far = (top > 1e100) | (top < 1e-100)
    return np.where(far, x / np.where(top == 0, 1, top), x) if far.any() else x


def unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit(sample: np.ndarray, n_rows: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the lists and the rotation."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    x = unit(sample)
    k = int(max(1, min(MAX_LISTS, round(n_rows ** 0.5), len(x) // 8)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], c)
    return c, turn


def scan_cell(cand: np.ndarray, query: np.ndarray, own: np.ndarray, k: int,
              block: int = BLOCK, eps: float = EPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that may be among the k nearest, with
    their squared distances. ``own`` marks pairs that do not count."""
    dim, nq, nc = cand.shape[1], len(query), len(cand)
    part = (np.einsum("ij,ij->i", query[:, :block], query[:, :block])[:, None]
            + np.einsum("ij,ij->i", cand[:, :block], cand[:, :block])[None, :]
            - 2 * query[:, :block] @ cand[:, :block].T)
    part[own] = np.inf
    m = min(8 * k, nc)
    look = np.argpartition(part, m - 1, axis=1)[:, :m]
    whole = ((query[:, None, :] - cand[look]) ** 2).sum(axis=2)
    whole[np.take_along_axis(own, look, axis=1)] = np.inf
    # the k-th best of those; inf where a query has fewer than k
    limit = np.sort(whole, axis=1)[:, min(k, m) - 1] + 1e-6
    d = min(block, dim)
    q, c = np.nonzero(part * (dim / d) <= (limit * (1 + eps / d ** 0.5) ** 2)[:, None])
    keep = ~own[q, c]
    q, c = q[keep], c[keep]
    dist = part[q, c]
    while d < dim:
        e = min(dim, d + block)
        dist = dist + ((query[q, d:e] - cand[c, d:e]) ** 2).sum(axis=1)
        d = e
        bound = limit[q] * ((1 + eps / d ** 0.5) ** 2 if d < dim else 1.0)
        keep = dist * (dim / d) <= bound
        q, c, dist = q[keep], c[keep], dist[keep]
    return q, c, dist


def _best(q, c, dist, k: int) -> np.ndarray:
    """Indexes of each query's k smallest distances and all that tie with them."""
    order = np.lexsort((dist, q))
    qs, ds = q[order], dist[order]
    first = np.r_[True, qs[1:] != qs[:-1]]
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.r_[start, len(qs)])
    last = ds[start + np.minimum(size, k) - 1]
    return order[ds <= last[group] + 1e-5]


def nearest(vectors: DataFrame, is_query: Column, *, key: str = "vec_id",
            vector: str = "embedding", k: int = 5, probe: float = PROBE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest found, among
    the vectors of its own length."""
    spark = vectors.sparkSession
    good = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        usable(F.col("v")) & F.col("id").isNotNull())
    # one row per length
    dims = good.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("asks").alias("asked")).limit(MAX_LENGTHS + 1).collect()
    if len(dims) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out = None
    for r in sorted(dims, key=lambda r: r.d):
        if r.asked:
            found = _nearest_of_length(good.where(F.size("v") == r.d), r.d, r.n, k, probe)
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return out


def _nearest_of_length(good: DataFrame, dim: int, n: int, k: int, probe: float) -> DataFrame:
    """``nearest`` of (id, v, asks) rows whose vectors have ``dim`` components."""
    spark = good.sparkSession
    good = good.withColumn("v", F.col("v").cast("array<double>"))
    taken = good.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    centroids, turn = fit(_matrix(taken.column("v"), dim), n)

    def place(batches):
        for b in batches:
            x = unit(_matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays(
                [pa.array((x @ centroids.T).argmax(axis=1).astype(np.int32)), *b.columns,
                 pa.array(list((x @ turn).astype(np.float32)), pa.list_(pa.float32()))],
                names=["list", "row", "id", "v", "asks", "r"])

    # a mark of its own for every row: ids may repeat
    marked = good.select(F.monotonically_increasing_id().alias("row"), "id", "v", "asks")
    index = materialize(spark, marked.mapInArrow(
        place, "list int, row bigint, id bigint, v array<double>, asks boolean, r array<float>"), "lists")
    sizes = {r.list: r["count"] for r in index.groupBy("list").count().collect()}   # per list
    held = np.array([sizes.get(i, 0) for i in range(len(centroids))])
    probes = max(1, int(np.ceil(probe * len(centroids))))

    def aim(batches):
        for b in batches:
            x = unit(_matrix(b.column("v"), dim))
            order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")
            enough = np.cumsum(held[order], axis=1) >= 20 * k + 1
            count = np.maximum(probes, np.where(enough.any(axis=1), enough.argmax(axis=1) + 1,
                                                len(centroids)))
            lists = [o[:c][held[o[:c]] > 0].tolist() for o, c in zip(order, count)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("v"), b.column("r"),
                 pa.array(lists, pa.list_(pa.int32()))], names=["row", "id", "v", "r", "lists"])

    asks = index.where("asks").select("row", "id", "v", "r").mapInArrow(
        aim, "row bigint, id bigint, v array<double>, r array<float>, lists array<int>").select(
        "row", "id", "v", "r", F.explode("lists").alias("list"))
    # cells per list: candidate cuts by its size, query cuts by how many probe it
    probed = {r.list: r["count"] for r in asks.groupBy("list").count().collect()}
    cuts = spark.createDataFrame(
        [(i, max(1, -(-int(h) // CELL)), max(1, -(-probed.get(i, 0) // QUERIES)))
         for i, h in enumerate(held)], "list int, nc int, nq int")     # one row per list
    cuts = F.broadcast(cuts)
    left = index.join(cuts, "list").withColumn(
        "cut", F.pmod(F.xxhash64("row"), "nc").cast("int")).select(
        "list", "cut", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qcut"), "id", "v", "r")
    right = asks.join(cuts, "list").withColumn(
        "qcut", F.pmod(F.xxhash64("row"), "nq").cast("int")).select(
        "list", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cut"), "qcut", "row", "id", "v", "r")

    def solve(cands: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})
        if not len(cands) or not len(queries):
            return none
        ci, qi = cands.column("id").to_numpy(), queries.column("id").to_numpy()
        q, c, dist = scan_cell(_matrix(cands.column("r"), dim), _matrix(queries.column("r"), dim),
                               qi[:, None] == ci[None, :], k)
        if not len(q):
            return none
        at = _best(q, c, dist, k)
        q, c = q[at], c[at]
        x, y = _scaled(_matrix(queries.column("v"), dim)), _scaled(_matrix(cands.column("v"), dim))
        length = [np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y)]
        score = np.einsum("ij,ij->i", x[q], y[c]) / (length[0][q] * length[1][c])
        order = np.lexsort((ci[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < k
        return pa.table({"row": queries.column("row").to_numpy()[q[keep]], "query_id": qi[q[keep]], "vec_id": ci[c[keep]], "score": score[keep]})

    found = left.groupBy("list", "cut", "qcut").cogroup(
        right.groupBy("list", "cut", "qcut")).applyInArrow(
        solve, "row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
