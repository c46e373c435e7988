"""Canonical ledger schemas.

``elements`` has one row per transaction input or output. For an output,
``(tx_hash, idx)`` is its own outpoint; for an input it is the outpoint the
input spends. ``type`` is 1 for outputs and 0 for inputs.
"""

from pyspark.sql import types as T

ELEMENTS = T.StructType([
    T.StructField("type", T.IntegerType()),
    T.StructField("block_hash", T.StringType()),
    T.StructField("tx_idx", T.IntegerType()),
    T.StructField("tx_hash", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("amount", T.LongType()),
    T.StructField("script", T.BinaryType()),
])

TX_INPUT = T.StructType([
    T.StructField("prev_hash", T.StringType()),
    T.StructField("prev_idx", T.LongType()),
    T.StructField("script", T.BinaryType()),
])

TX_OUTPUT = T.StructType([
    T.StructField("value", T.LongType()),
    T.StructField("script", T.BinaryType()),
])

TRANSACTION = T.StructType([
    T.StructField("tx_hash", T.StringType()),
    T.StructField("inputs", T.ArrayType(TX_INPUT)),
    T.StructField("outputs", T.ArrayType(TX_OUTPUT)),
])

BLOCKS_NESTED = T.StructType([
    T.StructField("block_hash", T.StringType()),
    T.StructField("t", T.IntegerType()),
    T.StructField("transactions", T.ArrayType(TRANSACTION)),
])

BLOCK_INDEX = T.StructType([
    T.StructField("rowkey", T.StringType()),
    T.StructField("transactionCounter", T.LongType()),
    T.StructField("transactionDate", T.IntegerType()),
    T.StructField("file", T.StringType()),
    T.StructField("size", T.IntegerType()),
])

TX_INDEX = T.StructType([
    T.StructField("rowkey", T.StringType()),
    T.StructField("inputNo", T.IntegerType()),
    T.StructField("outputNo", T.IntegerType()),
])

CHUNK = T.StructType([
    T.StructField("opcode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("start", T.IntegerType()),
])

PARSED_SCRIPT = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("chunks", T.ArrayType(CHUNK)),
])
