"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard scores a key with ``-weight / ln(u(key, shard))`` and the largest
score takes it, so a record's shard depends on its key and the shard list
alone, shards get records in proportion to their weights, and a further shard
only takes records into itself (1 in n + 1 of them).

Places inside a shard are gapless. Rows are dealt by range over (shard, key,
the rest), numbered per partition, and each partition's start in a shard comes
from the table of partition counts, whose rows are at most partitions + shards.
The range key ends in a row number, so equal keys spread over partitions.

Edge cases: a null key is a key of its own, a null text has no bytes; repeated
rows get a place each; an empty table stays empty; columns of the input whose
names clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: hex digits of the digest that make up a score: 52 bits, exact in a double
DIGITS = 13


def score(key: Column, shard: Column, weight: Column) -> Column:
    """Weighted rendezvous score of a key for a shard."""
    digest = F.md5(F.concat_ws(":", shard.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** DIGITS)
    return -weight / F.log(u)


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The highest-scoring shard (ties to the smaller number)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = F.array_max(F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(score(key, s, F.get(w, s)).alias("score"), (-s).alias("neg"))))
    return -ranked["neg"]


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Adds each record's shard; a projection, without a shuffle."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    return df.withColumn(out, best_shard(F.col(key), weights))


def _number(batches: Iterator) -> Iterator:
    """Adds this partition's number and each row's place among the rows of its
    shard in this partition."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        place = np.empty(len(shard), np.int64)
        for s in np.unique(shard):                     # at most the number of shards
            at = np.flatnonzero(shard == s)
            first = seen.get(int(s), 0)
            place[at] = first + np.arange(len(at))
            seen[int(s)] = first + len(at)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(shard), part, np.int64)), pa.array(place)],
            names=[*b.schema.names, "_part", "_place"])


def with_slots(assigned: DataFrame, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Adds gapless places per ``shard``, ordered by ``order``.

    Works on narrow rows: keep texts out of ``assigned`` and join them by key."""
    spark = assigned.sparkSession
    dealt = (assigned.drop("_part", "_place", out)
             .withColumn("_row", F.monotonically_increasing_id())
             .repartitionByRange("shard", *order, "_row")
             .sortWithinPartitions("shard", *order, "_row").drop("_row"))
    schema = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes)
    rows = materialize(spark, dealt.mapInArrow(_number, f"{schema}, _part bigint, _place bigint"),
                       "slots")
    # at most partitions + shards rows: each partition holds a range of shards
    starts = (rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.sum("_n").over(
                  Window.partitionBy("shard").orderBy("_part")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
              .select("shard", "_part", "_start"))
    return (rows.join(F.broadcast(starts), ["shard", "_part"])
            .withColumn(out, F.col("_start") + F.col("_place"))
            .drop("_part", "_place", "_start"))


def write_shards(df: DataFrame, path: str, key: str, weights: Sequence[float]) -> None:
    """Writes the records as one folder per shard."""
    assign(df, key, weights).write.partitionBy("shard").parquet(path)
