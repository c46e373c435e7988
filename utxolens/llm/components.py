"""Connected components of an edge table, by large-star and small-star rounds.

Each round is two grouped minima and two joins on the node; hub nodes are
collapsed map-side in the minima and split by the adaptive skew join. Rounds
are written to the shared checkpoint folder, so lineage stays short and a lost
executor re-reads files. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a key of its own gives the join its own exchanges, which adaptive execution
    # can split at a hub; on the aggregate's partitions it could not
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(
        F.col("a").bitwiseXOR(F.lit(0)).alias("k"), "m")
    return (both.join(least, F.col("a") == F.col("k")).where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").bitwiseXOR(F.lit(0)).alias("k"), "m")
    joined = down.join(least, F.col("a") == F.col("k"))
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _sign(df: DataFrame):
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links over bigint nodes -> (node, root) for every linked node but
    the roots themselves, root being the smallest node of the component."""
    now = materialize(edges.sparkSession, edges.select("a", "b").where("a <> b").distinct(), "links")
    sign = _sign(now)
    while sign[0]:
        now = materialize(now.sparkSession, _small_star(_large_star(now)), "links")
        new = _sign(now)
        if new == sign:
            break
        sign = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
