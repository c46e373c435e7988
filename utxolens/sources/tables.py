"""Readers for the canonical ledger tables and SQL view registration.

The block/transaction index tables can live in any Spark data source; the
schema is always given explicitly (no inference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from . import fixtures


def read_block_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.BLOCK_INDEX).load(path)


def read_tx_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.TX_INDEX).load(path)


def read_elements(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.ELEMENTS).load(path)


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.BLOCKS_NESTED).load(path)


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> dict[str, str]:
    """Register the ledger views over the test tables as temp views.

    Returns the view names: ``elements``, ``block_index``, ``blocks`` (block
    index with a ``ts`` column), ``tx_index``.
    """
    from ..operators.blocks import with_ts

    bi = fixtures.block_index(spark, sf_dir)
    views = {
        "elements": fixtures.elements(spark, sf_dir),
        "block_index": bi,
        "blocks": with_ts(bi),
        "tx_index": fixtures.tx_index(spark, sf_dir),
    }
    names = {}
    for name, df in views.items():
        full = f"{prefix}{name}"
        df.createOrReplaceTempView(full)
        names[name] = full
    return names



def register_decoded_views(spark: SparkSession, blocks_path: str, prefix: str = "",
                           fmt: str = "parquet") -> dict[str, str]:
    """Register views over a decoded block table (``decode_to_parquet``
    output): ``blocks_nested``, ``elements``, ``block_index`` (+ ``blocks``
    with ``ts``) and ``tx_index``. Returns the view names."""
    from ..operators import blocks as B
    from .blockfile import block_file_index

    nested = spark.read.format(fmt).load(blocks_path)
    bi = block_file_index(nested)
    views = {
        "blocks_nested": nested,
        "elements": B.elements_from_blocks(nested),
        "block_index": bi,
        "blocks": B.with_ts(bi),
        "tx_index": B.tx_index_from_blocks(nested),
    }
    names = {}
    for name, df in views.items():
        full = f"{prefix}{name}"
        df.createOrReplaceTempView(full)
        names[name] = full
    return names
