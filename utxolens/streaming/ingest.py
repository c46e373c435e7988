"""Incremental block-file ingest with Structured Streaming.

The reference has no streaming queries; ledgers only grow by appending
block files, so the one streaming piece is the decoder run as a file
stream: new files under ``source_dir`` are decoded (same record scan as the
batch source, a file per row) and appended to a Parquet table, with
exactly-once bookkeeping in a checkpoint that the caller names. A table has
to be restarted with the checkpoint it was begun with: with another one the
sink's own log would take new files for old ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import ship_package
from ..sources.blockfile import BLOCK_FILE_ROWS, MAINNET_MAGIC
from ..sources.blockscan import decode_paths

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def ingest_block_files(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                       name: str = "blocks", glob: str = "*.dat",
                       magic: bytes = MAINNET_MAGIC, available_now: bool = True,
                       max_files_per_trigger: int = 64) -> StreamingQuery:
    """Start the ingest stream; with ``available_now`` it processes the files
    present now (in bounded micro-batches) and stops."""
    ship_package(spark)
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("pathGlobFilter", glob)
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(source_dir))
    # only names and lengths are taken from the stream; each task opens its files
    blocks = files.select("path", "length").mapInArrow(decode_paths(magic, 64), BLOCK_FILE_ROWS)
    writer = (blocks.writeStream.format("parquet")
              .option("path", table_path)
              .option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.queryName(f"utxolens_ingest_{name}").start()
