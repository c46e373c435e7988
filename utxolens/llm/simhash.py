"""SimHash near-duplicates with vantage-point trees.

A fingerprint has a bit set if more than half of the text's shingle hashes
have it. Equal fingerprints are collapsed first; the distinct ones are dealt
to shards by a vantage-point tree over Hamming distance: at a node with
vantage point v and radius mu, a fingerprint goes left if d <= mu and right if
d > mu - r. By the triangle inequality two fingerprints at distance <= r
always share a leaf: if one of them has d > mu, the other has d > mu - r and
goes right with it. Only the boundary band (mu - r, mu] is in both.

Inside a shard the same split goes on down to small leaves, whose pairs are
compared exactly; a shard reports its links as a spanning forest (at most one
row per fingerprint in it), never all pairs of a group. The forests of the
shards are joined by ``components``.

The tree is fitted on a bounded sample (``TREE_SAMPLE`` fingerprints); any
tree gives exact results, the sample only balances it. Below its leaves, where
a shard would still be large, vantage points derived from the shard's number
split on.

Edge cases: a null or blank text has fingerprint zero and links like any other;
repeated rows keep a row each; a null doc_id belongs to the component of its
fingerprint and gives no component id (a component of null ids only has null);
a text of any length is fingerprinted whole; an empty table gives an empty
table; other columns take no part, whatever their names, and ``keep_one`` hands
them on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import materialize, small_batches, spare
from .components import components

SHINGLE = 3               # words of a shingle
MAX_BITS = 2              # differing bits of a link
TREE_SAMPLE = 16_384      # most fingerprints the tree is fitted on
SHARD_ROWS = 1_024        # fingerprints a shard should hold
LEAF_ROWS = 48            # fingerprints that are compared pair by pair


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text, as an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()          # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter((xxh64_intdigest(b" ".join(w[i:i + shingle]), 42) for i in range(n)),
                    np.uint64, n)
    if n == 1:
        return int(h[0])
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(
        axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = SHINGLE):
    """Fingerprint column (bigint, the same 64 bits) of a text column."""
    @arrow_udf(T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        out = np.fromiter((simhash(t, shingle) for t in texts.cast(pa.binary()).to_pylist()),
                          np.uint64, len(texts))
        return pa.array(out.view(np.int64))
    return prints(F.col(text).cast("string"))


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


# --- the tree over a sample: nodes of (vantage, radius, left, right); a
# --- negative child is the leaf with number -child - 1

def _split(points: np.ndarray, vantage: np.uint64, r: int) -> int | None:
    """Radius for these points, or None where a split separates nothing."""
    d = np.sort(hamming(points, vantage))
    mu = int(d[len(d) // 2])
    for m in (mu - 1, mu, mu - 2, mu - 3, mu + 1):
        left, right = int((d <= m).sum()), int((d > m - r).sum())
        if left and max(left, right) <= 0.9 * len(d):
            return m
    return None


def build_tree(sample: np.ndarray, r: int, leaf: int) -> tuple[list, list[int]]:
    """Nodes of the tree and the sample's rows per leaf."""
    nodes: list[list] = []
    sizes: list[int] = []
    rng = np.random.default_rng(7)

    def grow(points: np.ndarray) -> int:
        for _ in range(3 if len(points) > leaf else 0):
            v = points[rng.integers(len(points))]
            mu = _split(points, v, r)
            if mu is not None:
                at = len(nodes)
                nodes.append([v, mu, 0, 0])
                d = hamming(points, v)
                nodes[at][2] = grow(points[d <= mu])
                nodes[at][3] = grow(points[d > mu - r])
                return at
        sizes.append(len(points))
        return -len(sizes)

    if len(sample):
        grow(sample)
    return nodes, sizes


def _mixed(x: int) -> np.uint64:
    """A vantage point from a number (the finaliser of splitmix64)."""
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return np.uint64(x ^ (x >> 31))


def route(points: np.ndarray, nodes: list, further: list[int], r: int):
    """Pairs (shard, indexes of the points that go to it)."""
    stack = [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node >= 0:
            v, mu, left, right = nodes[node]
            d = hamming(points[at], np.uint64(v))
            stack += [(left, at[d <= mu]), (right, at[d > mu - r])]
            continue
        levels = further[-node - 1]
        below = [(-node, levels, at)]
        while below:                                   # derived vantage points
            path, left, at = below.pop()
            if not left or not len(at):
                if len(at):
                    yield path, at
                continue
            d = hamming(points[at], _mixed(path))
            below += [((path << 1 | 1) + (1 << 40), left - 1, at[d <= 31]),
                      ((path << 1) + (1 << 40), left - 1, at[d > 31 - r])]


def local_roots(points: np.ndarray, r: int, leaf: int = LEAF_ROWS) -> np.ndarray:
    """For distinct fingerprints, the smallest index each is linked to by
    chains of distances <= r, found by a vantage-point tree over them."""
    rng = np.random.default_rng(11)
    root = np.arange(len(points))
    pairs = []
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) > leaf:
            v = points[at[rng.integers(len(at))]]
            d = hamming(points[at], v)
            mu = _split(points[at], v, r)
            if mu is not None:
                stack += [at[d <= mu], at[d > mu - r]]
                continue
        p = points[at]
        for i in range(0, len(at), 256):               # a block of rows at a time
            near = hamming(p[i:i + 256, None], p[None, :]) <= r
            x, y = np.nonzero(near)
            x += i
            keep = x < y
            if keep.any():
                pairs.append((at[x[keep]], at[y[keep]]))
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:                                        # minimum label, with jumps
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(prints: DataFrame, max_bits: int = MAX_BITS, *, tree_sample: int = TREE_SAMPLE,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct bigint fingerprints ``fp`` within
    ``max_bits`` of one another: a spanning forest of each shard."""
    spark: SparkSession = prints.sparkSession
    n = prints.count()
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(tree_sample)
                       .collect()], np.int64).view(np.uint64)
    share = max(1.0, n / max(1, len(sample)))
    nodes, sizes = build_tree(sample, max_bits, max(16, int(shard_rows / share)))
    nodes = [(int(v), m, left, right) for v, m, left, right in nodes]
    further = [max(0, ceil(log2(max(1.0, s * share / (2 * shard_rows))))) for s in sizes] or [0]

    def deal(batches: Iterator) -> Iterator:
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at in route(p, nodes, further, max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard, np.int64)), pa.array(p[at].view(np.int64))],
                    names=["shard", "fp"])

    def solve(t: pa.Table) -> pa.Table:
        p = np.sort(t.column("fp").to_numpy().view(np.uint64))
        root = local_roots(p, max_bits)
        at = np.flatnonzero(root != np.arange(len(p)))
        return pa.table({"a": p[at].view(np.int64), "b": p[root[at]].view(np.int64)})

    # fingerprints are narrow: without dealing them out few tasks would hold all
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000)
    return (prints.select("fp").repartition(tasks, "fp").mapInArrow(deal, "shard bigint, fp bigint")
            .groupBy("shard").applyInArrow(solve, "a bigint, b bigint"))


def cluster(prints: DataFrame, key: str, max_bits: int = MAX_BITS, **sizes) -> DataFrame:
    """(key, fp) rows -> (fp, component_id): the smallest key reachable from
    each distinct fingerprint over links of at most ``max_bits`` bits."""
    spark = prints.sparkSession
    distinct = materialize(spark, prints.groupBy("fp").agg(F.min(key).alias("least")), "prints")
    member = components(links(distinct, max_bits, **sizes))
    labelled = distinct.join(member, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = materialize(spark, labelled, "labelled")
    # written, so that a very large component's rows can be split in the join
    ids = materialize(spark, labelled.groupBy("root").agg(F.min("least").alias("component_id")),
                      "component_ids")
    return labelled.join(ids, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits) and
    ``component_id``."""
    spark = docs.sparkSession
    small_batches(spark)
    prints = materialize(spark, docs.select(key, fingerprint(text, shingle).alias("fp")), "simhash")
    return prints.join(cluster(prints, key, max_bits), "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one of each group kept: that with the smallest key
    (nulls last, then the smallest fingerprint), with all its columns."""
    spark = docs.sparkSession
    small_batches(spark)
    cols = docs.columns
    fp, own, other = (spare(docs, n) for n in ("_fp", "_key", "_other"))
    stored = materialize(spark, docs.withColumn(fp, fingerprint(text, shingle)), "simhash_docs")
    prints = stored.select(F.col(key).alias("_key"), F.col(fp).alias("fp"))
    groups = cluster(prints, "_key", max_bits)
    least = materialize(
        spark, prints.groupBy("fp").agg(F.min("_key").alias("_key")).join(groups, "fp")
        .groupBy("root").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key",
                                            F.col("fp"))).alias("x"))
        .select(F.col("x._key").alias(own), F.col("x.fp").alias(other)), "kept")
    # sort-merge, so that what follows per (key, fingerprint) needs no further sort
    kept = stored.join(least.hint("merge"), (F.col(fp) == F.col(other))
                       & F.col(key).eqNullSafe(F.col(own)), "left_semi")
    return kept.dropDuplicates([fp, key]).select(*cols)
