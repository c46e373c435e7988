"""Ledger-shaped views derived from the driver's test tables.

Mapping (see FIXTURES.md): one order date is one block, one order is one
transaction, one lineitem is one output, and one returned lineitem
(``l_returnflag = 'R'``) is an input spending outpoint
``(l_orderkey, l_linenumber)``. Amounts are integer cents. The locking
script of an output is chosen by ``l_suppkey % 8`` from eight script
classes (plus an empty script on line 7).

Everything here is a lazy DataFrame over the parquet files, so Catalyst
prunes columns (a query that never touches ``script`` never builds it) and
pushes filters into the scans.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SCHEMAS: dict[tuple, object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table. The schema inferred on first read (from the
    file itself) is reused, keyed by path, size and modification time, so
    later reads skip the footer-reading job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        st = os.stat(path)
        key = (path, st.st_size, st.st_mtime_ns)
    except OSError:
        key = None
    schema = _SCHEMAS.get(key) if key else None
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    if key:
        _SCHEMAS[key] = df.schema
    return df


def _sha_hex(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def _output_script_hex(linenumber: Column, suppkey: Column, partkey: Column) -> Column:
    part_h = _sha_hex(partkey)
    supp_h = _sha_hex(suppkey)
    cls = suppkey % 8
    # Fixed script templates of the fixture, one per class (FIXTURES.md §2).
    return (
        F.when(linenumber == 7, F.lit(""))
        .when(cls == 0, F.concat(F.lit("76a914"), F.substring(part_h, 1, 40), F.lit("88ac")))
        .when(cls == 1, F.concat(F.lit("76a94c14"), F.substring(part_h, 1, 40), F.lit("88ac")))
        .when(cls == 2, F.concat(F.lit("a914"), F.substring(part_h, 1, 40), F.lit("87")))
        .when(cls == 3, F.concat(F.lit("2102"), part_h, F.lit("ac")))
        .when(cls == 4, F.lit("6a04deadbeef"))
        .when(cls == 5, F.concat(F.lit("512102"), part_h, F.lit("2102"), supp_h, F.lit("52ae")))
        .when(cls == 6, F.lit("76a94c"))
        .otherwise(F.concat(F.lit("632102"), part_h, F.lit("ad670340420fb175682102"),
                            supp_h, F.lit("ac")))
    )


def _input_script_hex(suppkey: Column, partkey: Column) -> Column:
    return (F.when(suppkey % 8 == 2,
                   F.concat(F.lit("25512102"), _sha_hex(partkey), F.lit("51ae")))
            .otherwise(F.lit("")))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``type, block_hash, tx_idx, tx_hash, idx, amount, script``.

    Outputs need the order date (the block), so lineitem is joined to
    orders on the order key. Orders grows with the data (no size bound), so
    the join is a shuffle sort-merge join on the key, as it is at scale;
    the per-row script work after it then runs in every shuffle partition.
    """
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").hint("merge")
    outputs = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.lit(1).alias("type"),
        _sha_hex(F.col("o_orderdate").cast("date")).alias("block_hash"),
        (F.col("l_orderkey") % 1000).cast("int").alias("tx_idx"),
        F.col("l_orderkey").cast("string").alias("tx_hash"),
        F.col("l_linenumber").cast("bigint").alias("idx"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
        F.unhex(_output_script_hex(F.col("l_linenumber"), F.col("l_suppkey"),
                                   F.col("l_partkey"))).alias("script"),
    )
    inputs = li.where(F.col("l_returnflag") == "R").select(
        F.lit(0).alias("type"),
        _sha_hex(F.col("l_shipdate").cast("date")).alias("block_hash"),
        F.lit(0).alias("tx_idx"),
        F.col("l_orderkey").cast("string").alias("tx_hash"),
        F.col("l_linenumber").cast("bigint").alias("idx"),
        F.lit(0).cast("bigint").alias("amount"),
        F.unhex(_input_script_hex(F.col("l_suppkey"), F.col("l_partkey"))).alias("script"),
    )
    return outputs.unionByName(inputs)


def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rowkey, transactionCounter, transactionDate, file, size``: one row per block.

    A grouped aggregate over orders (partial + final, no collect).
    """
    od = read_table(spark, sf_dir, "orders")
    per_day = (od.select(F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
               .groupBy("d")
               .agg(F.count(F.lit(1)).alias("transactionCounter"),
                    F.sum(F.round("o_totalprice")).alias("_size")))
    rowkey = F.col("d").cast("string")
    return per_day.select(
        rowkey.alias("rowkey"),
        F.col("transactionCounter"),
        (F.unix_date("d") * 86400).cast("int").alias("transactionDate"),
        F.concat(F.lit("blk"), F.substring(rowkey, 1, 4), F.lit(".dat")).alias("file"),
        F.col("_size").cast("int").alias("size"),
    )


def tx_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rowkey, inputNo, outputNo``: one row per transaction.

    Lineitem is pre-aggregated per order key before the join, so the join
    shuffles at most one row per order from that side and a hot order key
    collapses map-side.
    """
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_in"),
               F.count(F.lit(1)).alias("n_out")))
    od = read_table(spark, sf_dir, "orders").select("o_orderkey")
    j = od.join(li, od.o_orderkey == li.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").cast("string").alias("rowkey"),
        F.coalesce(F.col("n_in"), F.lit(0)).cast("int").alias("inputNo"),
        F.coalesce(F.col("n_out"), F.lit(0)).cast("int").alias("outputNo"),
    )


def transactions_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block_hash, t, tx_hash``: one row per transaction (order), with its block."""
    od = read_table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    return od.select(
        _sha_hex(d).alias("block_hash"),
        (F.unix_date(d) * 86400).cast("int").alias("t"),
        F.col("o_orderkey").cast("string").alias("tx_hash"),
    )


def outputs_with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block_hash, t, amount``: one row per output with its block's time, so
    that a time bound reaches the orders before they are joined."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").hint("merge")
    d = F.col("o_orderdate").cast("date")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        _sha_hex(d).alias("block_hash"),
        (F.unix_date(d) * 86400).cast("int").alias("t"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"))


def nested_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block_hash, t, transactions``: nested block records, one per lineitem.

    Each is a fragment of the block of its ship date with two transactions:
    the line's own (an input if it was returned; price, discount and tax as
    outputs, of which the first ``l_linenumber % 4``) and one of its part
    without inputs (one output: the quantity). Nothing is grouped, so a
    record's size does not depend on the data.
    """
    li = read_table(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    key = F.col("l_orderkey").cast("string")
    script = F.unhex(_output_script_hex(F.col("l_linenumber"), F.col("l_suppkey"),
                                        F.col("l_partkey")))

    def output(value: Column) -> Column:
        return F.struct(F.round(value).cast("bigint").alias("value"), script.alias("script"))

    spent = F.struct(key.alias("prev_hash"),
                     F.col("l_linenumber").cast("bigint").alias("prev_idx"),
                     F.unhex(_input_script_hex(F.col("l_suppkey"), F.col("l_partkey"))).alias("script"))
    returned = F.array(F.when(F.col("l_returnflag") == "R", spent))
    outputs = F.array(output(F.col("l_extendedprice") * 100), output(F.col("l_discount") * 100),
                      output(F.col("l_tax") * 100))
    own = F.struct(key.alias("tx_hash"), F.array_compact(returned).alias("inputs"),
                   F.slice(outputs, F.lit(1), F.col("l_linenumber") % 4).alias("outputs"))
    part = F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tx_hash"),
                    F.array_compact(F.array(F.when(F.lit(False), spent))).alias("inputs"),
                    F.array(output(F.col("l_quantity"))).alias("outputs"))
    return li.select(_sha_hex(d).alias("block_hash"),
                     (F.unix_date(d) * 86400).cast("int").alias("t"),
                     F.array(own, part).alias("transactions"))


def mode_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_type, v``: the integer values whose per-group mode is taken."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_type", F.floor("value").cast("int").alias("v"))
