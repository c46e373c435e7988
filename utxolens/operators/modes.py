"""Most frequent value per group, ties broken towards the larger value,
0 for a group without values.

Two grouped aggregates: counts per (group, value) with a map-side partial
step, then ``max_by`` over the (count, value) pair per group. A hot group
only ever holds one row per distinct value in the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_max(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, mode``."""
    per = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    order = F.when(F.col(value).isNotNull(), F.struct(F.col("_c"), F.col(value)))
    return per.groupBy(group).agg(
        F.coalesce(F.max_by(F.col(value), order), F.lit(0)).alias("mode"))


def array_mode_max(values: Column) -> Column:
    """Most frequent element of an int array column, ties → larger, empty or
    NULL → 0 (the list form of the same rule; per-row, no shuffle): one pass
    over the sorted array that keeps the present run and the best one."""
    run = F.struct(F.lit(None).cast("bigint").alias("v"), F.lit(0).alias("n"),
                   F.lit(0).cast("bigint").alias("best"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["v"] == x, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.cast("bigint").alias("v"), n.alias("n"),
                        F.when(n >= a["most"], x.cast("bigint")).otherwise(a["best"]).alias("best"),
                        F.greatest(n, a["most"]).alias("most"))

    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.coalesce(F.aggregate(ordered, run, step, lambda a: a["best"]),
                      F.lit(0).cast("bigint")).cast("int")
