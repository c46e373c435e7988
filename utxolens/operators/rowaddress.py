"""Row addresses: fetch the payload of a few rows without a second full scan.

A row of a stored table has an address: its file and its place in it, which
Spark's file sources show as ``_metadata``. As two numbers (the file's path
hashed to 64 bits, and ``row_index``) it rides through a numeric aggregate and
a top-k. The winners' files are then named in a filter on file metadata alone,
which Spark applies when it lists files, so the second scan opens the winners'
files and no other. Rows are matched by address and by the caller's own keys,
so files whose paths hash alike cannot bring in a wrong row.

Sources without such metadata (views over joins, formats without row places)
have no addresses: ``with_address`` gives None and callers join instead.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

FILE, PLACE = "_file", "_place"
ADDRESS = [FILE, PLACE]
MAX_ROWS = 10_000         # most rows fetched by address


def _address() -> list[Column]:
    return [F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE)]


def with_address(df: DataFrame) -> DataFrame | None:
    """``df`` with ``_file, _place`` of each row, None if it has no addresses."""
    try:
        out = df.select(*df.columns, *_address())
        out.schema                                      # resolved now, not when it runs
    except AnalysisException:
        return None
    return out


def fetch(df: DataFrame, winners: list[Row], *columns: str | Column) -> DataFrame:
    """The rows of ``df`` at the winners' addresses, joined with the winners."""
    spark = df.sparkSession
    files = sorted({r[FILE] for r in winners})
    named = df.where(F.xxhash64("_metadata.file_path").isin(files)).select(*columns, *_address())
    return named.join(F.broadcast(spark.createDataFrame(winners, _schema(winners))), ADDRESS)


def _schema(winners: list[Row]):
    from pyspark.sql import types as T

    kinds = {int: T.LongType(), str: T.StringType(), bytes: T.BinaryType(), bytearray: T.BinaryType()}

    def kind(name: str):
        return next((kinds[type(r[name])] for r in winners if r[name] is not None), T.LongType())

    return T.StructType([T.StructField(n, kind(n)) for n in winners[0].__fields__])
