"""CSV sinks of the reference jobs.

``write_single_csv`` writes one headerless CSV file — only for results
bounded by a limit (top-k reports); ``write_csv`` writes one part file per
partition, in order when the frame is sorted. Binary columns
are written as lower-case hex. A sorted result keeps its order: the sort
range-partitions, and ``coalesce(1)`` concatenates partitions in order
without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hex_binary(df: DataFrame) -> DataFrame:
    cols = [F.lower(F.hex(F.col(f.name))).alias(f.name) if isinstance(f.dataType, T.BinaryType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def write_single_csv(df: DataFrame, out: str, header: bool = False) -> None:
    _hex_binary(df).coalesce(1).write.mode("overwrite").option("header", header).csv(out)


def write_csv(df: DataFrame, out: str, header: bool = False) -> None:
    _hex_binary(df).write.mode("overwrite").option("header", header).csv(out)
