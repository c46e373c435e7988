"""Block-level operators: counts, calendar rollups, top-k, block values.

Inputs are the ``block_index`` table (one row per block) and, for block
values, either nested block records (from the block-file decoder) or the
flat ``elements`` / transaction tables. Every rollup is a grouped
aggregate with a partial step; nothing collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import block_time_text, epoch_to_ts, iso_time_text


def with_ts(block_index: DataFrame) -> DataFrame:
    """Add ``ts`` (TIMESTAMP_NTZ, UTC) from ``transactionDate`` epoch seconds."""
    return block_index.withColumn("ts", epoch_to_ts(F.col("transactionDate")))


def row_count(df: DataFrame) -> DataFrame:
    """One row ``("result", n)`` as columns ``_1, _2``; 0 on an empty input."""
    return df.agg(F.count(F.lit(1)).alias("_2")).select(F.lit("result").alias("_1"), "_2")


def blocks_per_year(block_index: DataFrame) -> DataFrame:
    b = with_ts(block_index)
    return (b.groupBy(F.year("ts").alias("year"))
             .agg(F.count(F.lit(1)).alias("n_blocks"))
             .orderBy("year"))


def block_extremes_per_month(block_index: DataFrame) -> DataFrame:
    b = with_ts(block_index)
    return (b.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"))
             .agg(F.min("transactionCounter").alias("min_tx"),
                  F.max("transactionCounter").alias("max_tx"),
                  F.min("size").alias("min_size"),
                  F.max("size").alias("max_size"))
             .orderBy("year", "month"))


def small_blocks_per_month(block_index: DataFrame, max_tx: int = 10) -> DataFrame:
    """Blocks with fewer than ``max_tx`` transactions, counted per month."""
    b = with_ts(block_index).where(F.col("transactionCounter") < max_tx)
    return (b.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"))
             .agg(F.count(F.lit(1)).alias("n_blocks"))
             .orderBy("year", "month"))


def blocks_fewest_tx(block_index: DataFrame, k: int = 1000) -> DataFrame:
    return block_index.orderBy(F.col("transactionCounter").asc(), "rowkey").limit(k)


def largest_blocks(block_index: DataFrame, k: int = 100) -> DataFrame:
    """The k largest blocks, with the ``ts`` column (the shell query sorts the
    time-stamped block frame)."""
    return with_ts(block_index).orderBy(F.col("size").desc(), "rowkey").limit(k)


def block_ts(block_index: DataFrame) -> DataFrame:
    return with_ts(block_index).select("rowkey", "transactionDate", "ts")


def block_iso_time(block_index: DataFrame) -> DataFrame:
    return block_index.select("rowkey", iso_time_text(F.col("transactionDate")).alias("iso_time"))


# --- nested block records (decoder output) ---------------------------------

def block_output_value(transactions: Column) -> Column:
    """Total output value of a block's nested transactions (no shuffle)."""
    values = F.flatten(F.transform(transactions, lambda t: F.transform(t["outputs"],
                                                                       lambda o: o["value"])))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def block_values_nested(blocks: DataFrame) -> DataFrame:
    """``t, time, hash, value, no`` per nested block record, ordered by time."""
    return (blocks.select(
        F.col("t"),
        block_time_text(F.col("t")).alias("time"),
        F.col("block_hash").alias("hash"),
        block_output_value(F.col("transactions")).alias("value"),
        F.size("transactions").alias("no"))
        .orderBy("t", "hash"))


def flatten_outputs_nested(blocks: DataFrame) -> DataFrame:
    """``block_hash, tx_hash, idx, value, script``: transactions → outputs."""
    tx = blocks.select("block_hash", F.explode("transactions").alias("tx"))
    return tx.select("block_hash", F.col("tx.tx_hash").alias("tx_hash"),
                     F.posexplode("tx.outputs").alias("idx", "o")) \
             .select("block_hash", "tx_hash", F.col("idx").cast("bigint").alias("idx"),
                     F.col("o.value").alias("value"), F.col("o.script").alias("script"))


def transactions_with_block(blocks: DataFrame) -> DataFrame:
    """One row per transaction with its block: ``block_hash, t, tx_idx,
    tx_hash, inputs, outputs`` (nested lists kept)."""
    tx = blocks.select("block_hash", "t", F.posexplode("transactions").alias("tx_idx", "tx"))
    return tx.select("block_hash", "t", F.col("tx_idx").cast("int"),
                     F.col("tx.tx_hash").alias("tx_hash"), F.col("tx.inputs").alias("inputs"),
                     F.col("tx.outputs").alias("outputs"))


def tx_index_from_blocks(blocks: DataFrame) -> DataFrame:
    """The transaction index table (``rowkey, inputNo, outputNo``) of decoded blocks."""
    return transactions_with_block(blocks).select(
        F.col("tx_hash").alias("rowkey"), F.size("inputs").alias("inputNo"),
        F.size("outputs").alias("outputNo"))


def elements_from_blocks(blocks: DataFrame, *more: str) -> DataFrame:
    """Nested block records → the flat ``elements`` table (inputs + outputs), and
    ``more`` columns of the block: one scan, a transaction's outputs and inputs
    exploded together."""
    tx = blocks.select("block_hash", *more, F.posexplode("transactions").alias("tx_idx", "tx"))
    none = F.lit(0).cast("bigint")
    outs = F.transform("tx.outputs", lambda o, i: F.struct(
        F.lit(1).alias("type"), F.col("tx.tx_hash").alias("tx_hash"), i.cast("bigint").alias("idx"),
        o["value"].alias("amount"), o["script"].alias("script")))
    ins = F.transform("tx.inputs", lambda x: F.struct(
        F.lit(0).alias("type"), x["prev_hash"].alias("tx_hash"), x["prev_idx"].alias("idx"),
        none.alias("amount"), x["script"].alias("script")))
    both = F.concat(F.coalesce(outs, F.array()), F.coalesce(ins, F.array()))
    e = tx.select("block_hash", *more, F.col("tx_idx").cast("int").alias("tx_idx"),
                  F.explode(both).alias("e"))
    return e.select("e.type", "block_hash", "tx_idx", "e.tx_hash", "e.idx", "e.amount", "e.script", *more)


# --- flat form of the block values (any table source) ----------------------

def block_values_flat(transactions: DataFrame, elements: DataFrame) -> DataFrame:
    """``t, time, hash, value, no`` from flat tables.

    ``transactions`` has ``block_hash, t, tx_hash`` (one row per
    transaction); ``elements`` supplies the outputs. Both sides are reduced
    to one row per block by partial aggregation before they are joined, so
    the join moves one row per block.
    """
    return _join_block_sums(transactions, elements.where(F.col("type") == 1))


def _join_block_sums(transactions: DataFrame, outputs: DataFrame) -> DataFrame:
    per_tx = (transactions.groupBy("block_hash")
              .agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("no")))
    per_out = outputs.groupBy("block_hash").agg(F.sum("amount").alias("value"))
    j = per_tx.join(per_out, "block_hash", "left")
    return j.select(
        F.col("t"),
        block_time_text(F.col("t")).alias("time"),
        F.col("block_hash").alias("hash"),
        F.coalesce(F.col("value"), F.lit(0).cast("bigint")).alias("value"),
        F.col("no").cast("int").alias("no"),
    ).orderBy("t", "hash")


def recent(df: DataFrame, time_col: str = "t", days: int = 30,
           newest: Column | None = None) -> DataFrame:
    """Rows newer than ``days`` before ``newest`` (default: the newest row of
    ``df`` itself, as a scalar subquery — the data's own 'now')."""
    if newest is None:
        newest = df.select(F.max(time_col)).scalar()
    return df.where(F.col(time_col) > newest - F.lit(days * 86400))


def recent_block_values(transactions: DataFrame, outputs: DataFrame,
                        days: int = 30) -> DataFrame:
    """Block values of the blocks newer than ``days`` before the newest block.

    ``outputs`` has ``block_hash, t, amount``. 'Now' comes from the narrow
    transactions table (one scalar), and both sides are bounded in time before
    they are aggregated, so older outputs are never summed."""
    newest = transactions.select(F.max("t")).scalar()
    return _join_block_sums(recent(transactions, "t", days, newest),
                            recent(outputs, "t", days, newest))


def recent_blocks_nested(blocks: DataFrame, days: int = 30) -> DataFrame:
    """Nested block records newer than ``days`` before the newest one. On a
    table partitioned by ``month`` (``decode_to_parquet``) the same bound also
    prunes partitions."""
    newest = blocks.select(F.max("t")).scalar()
    out = recent(blocks, "t", days, newest)
    if "month" in blocks.columns:
        since = epoch_to_ts(newest - F.lit(days * 86400))
        out = out.where(F.col("month").cast("string") >= F.date_format(since, "yyyy-MM"))
    return out
