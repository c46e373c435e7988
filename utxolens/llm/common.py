"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: the white space that separates words: space and \t \n \v \f \r
WORD_GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\f\r"

__all__ = ["WORD_GAP", "add_blobs", "arrow_rows", "let", "materialize", "small_batches", "spare",
           "table", "text_or_empty", "words"]


def spare(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable
    cannot be inlined into the places that use it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: str) -> Column:
    """Words of a text column: runs of anything but ASCII white space."""
    trimmed = F.btrim(text_or_empty(text), F.lit(_GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_GAP))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs within; the session
    has its own setting back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts can be very long: keep the Arrow batches of this session small, so
    a Python worker holds some megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


FAN_IN = 64               # tasks' sums are first added up in this many groups


def add_blobs(parts: DataFrame, add: Callable[[bytes, bytes], bytes]) -> DataFrame:
    """(block, blob): blobs of (part, block, blob) added per block, in two steps,
    so no task reads more than a share of all tasks' sums; one blob is held."""
    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for blob in b.column("blob").to_pylist():
                total = blob if total is None else add(total, blob)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([total], pa.binary())], names=["block", "blob"])

    few = parts.withColumn("part", F.col("part") % FAN_IN).groupBy("block", "part").applyInArrow(
        merge, "block int, blob binary")
    return few.groupBy("block").applyInArrow(merge, "block int, blob binary")
