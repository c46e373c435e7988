"""Named queries: ``(spark, sf_dir) -> DataFrame``.

Each reads the driver's test tables through the ledger views of
``sources.fixtures`` and applies the library operators. Column names
match ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding as enc
from ..functions.validate import decode_address, pubkey_to_hash160
from ..functions.address import with_hash160_address
from ..functions.tablefuncs import register_table_functions
from ..operators import blocks, modes, scriptstats, utxo
from ..session import checkpoint_dir, materialize
from ..sources import blockfile, blockwrite, cells
from ..sources import fixtures as fx
from ..sources.tables import register_views

Query = Callable[[SparkSession, str], DataFrame]


def _el(spark: SparkSession, sf: str) -> DataFrame:
    return fx.elements(spark, sf)


def _bi(spark: SparkSession, sf: str) -> DataFrame:
    return fx.block_index(spark, sf)


def elements_scan(spark, sf):
    """Element rows per type with their total amount (the element scan, S1/P1)."""
    return (_el(spark, sf).groupBy("type")
            .agg(F.count(F.lit(1)).alias("n_elements"), F.sum("amount").alias("total_amount")))


def blocks_scan(spark, sf):
    """Per block: time, transactions and outputs (the block scan, S2), from flat tables."""
    tx = fx.transactions_flat(spark, sf)
    per_tx = tx.groupBy("block_hash").agg(F.max("t").alias("t"),
                                          F.count(F.lit(1)).cast("int").alias("n_transactions"))
    per_out = (_el(spark, sf).where(F.col("type") == 1).groupBy("block_hash")
               .agg(F.count(F.lit(1)).alias("n_outputs")))
    return (per_tx.join(per_out, "block_hash", "left")
            .select("block_hash", "t", "n_transactions",
                    F.coalesce("n_outputs", F.lit(0).cast("bigint")).alias("n_outputs")))


def unspent_outputs(spark, sf):
    """Every unspent output with its script as hex (A1 + F1)."""
    u = utxo.unspent_outputs(_el(spark, sf))
    return u.select("type", "block_hash", "tx_idx", "tx_hash", "idx", "amount",
                    enc.hex_lower(F.col("script")).alias("script_hex"))


def address_validation(spark, sf):
    """Decode and check the addresses of unspent outputs."""
    a = utxo.output_addresses(_el(spark, sf))
    d = decode_address(F.col("address"))
    return a.select("tx_hash", "idx", "address", d["valid"].alias("valid"),
                    d["version"].alias("version"), d["payload_hex"].alias("payload_hex"))


def pubkey_addresses(spark, sf):
    """Raw-key outputs → hash160 → address (G16 + G20)."""
    k = scriptstats.script_pubkeys(_el(spark, sf).where(F.col("type") == 1))
    h = k.select("tx_hash", "idx", "pubkey_hex",
                 pubkey_to_hash160(F.col("pubkey_hex")).alias("hash160"))
    return with_hash160_address(h, "hash160", "address")


def sql_over_views(spark, sf):
    """The interactive-shell query, as SQL text over registered views."""
    names = register_views(spark, sf, prefix="ul_")
    return spark.sql(f"""
        SELECT YEAR(ts) AS year, MONTH(ts) AS month,
               min(transactionCounter) AS min_tx, max(transactionCounter) AS max_tx,
               min(size) AS min_size, max(size) AS max_size
        FROM {names['blocks']} GROUP BY YEAR(ts), MONTH(ts) ORDER BY YEAR(ts), MONTH(ts)""")


def reversed_hash(spark, sf):
    """Block hashes in reversed byte order."""
    b = _bi(spark, sf).select("rowkey", F.sha2(F.col("rowkey").cast("binary"), 256).alias("block_hash"))
    return b.select("rowkey", "block_hash",
                    enc.reverse_bytes_hex(F.col("block_hash")).alias("display_hash"))


def double_sha256(spark, sf):
    """Double SHA-256 of each block key."""
    return _bi(spark, sf).select(
        "rowkey", enc.double_sha256_hex(F.col("rowkey").cast("binary")).alias("hash256"))


def base58_text(spark, sf):
    """Base58 of hashes of 1 to 64 bytes, some with leading zero bytes."""
    size = F.pmod(F.floor(F.col("transactionDate") / 86400), F.lit(64)).cast("int") + 1
    zeros = F.pmod(F.col("transactionCounter"), F.lit(3)).cast("int")
    h = F.concat(F.sha2(F.col("rowkey").cast("binary"), 256),
                 F.sha2(F.concat(F.col("rowkey"), F.lit("#")).cast("binary"), 256))
    return _bi(spark, sf).select("rowkey", F.concat(
        F.repeat(F.lit("00"), zeros), F.substring(h, F.lit(1), 2 * size)).alias("bytes_hex")).select(
        "rowkey", "bytes_hex", enc.base58_hex(F.col("bytes_hex")).alias("text"))


def block_values(spark, sf):
    """Per-block output value and transaction count, ordered by time."""
    return blocks.block_values_flat(fx.transactions_flat(spark, sf), _el(spark, sf))


def flatten_outputs(spark, sf):
    """Transactions flattened to their outputs."""
    return (_el(spark, sf).where(F.col("type") == 1)
            .select("block_hash", "tx_hash", "idx", F.col("amount").alias("value")))


def nested_block_values(spark, sf):
    """Value and transaction count of nested records, summed per block."""
    v = blocks.block_values_nested(fx.nested_fragments(spark, sf))
    return v.groupBy("t", "time", "hash").agg(F.sum("value").alias("value"),
                                              F.sum("no").alias("no"))


def nested_transactions(spark, sf):
    """Transactions of nested records with their block and list sizes."""
    t = blocks.transactions_with_block(fx.nested_fragments(spark, sf))
    return t.select("block_hash", "t", "tx_idx", "tx_hash", F.size("inputs").alias("n_inputs"),
                    F.size("outputs").alias("n_outputs"))


def nested_outputs(spark, sf):
    """Outputs of nested records, two levels flattened."""
    o = blocks.flatten_outputs_nested(fx.nested_fragments(spark, sf))
    return o.select("block_hash", "tx_hash", "idx", "value",
                    enc.hex_lower(F.col("script")).alias("script_hex"))


def nested_elements(spark, sf):
    """Flat inputs and outputs of nested records."""
    e = blocks.elements_from_blocks(fx.nested_fragments(spark, sf))
    return e.select("type", "block_hash", "tx_idx", "tx_hash", "idx", "amount",
                    enc.hex_lower(F.col("script")).alias("script_hex"))


def address_checks(spark, sf):
    """Whole and damaged address texts, decoded and checked (G8): by part key, the
    text as it is, its last character changed, an illegal character, too short,
    the empty payload, and NULL."""
    p = fx.read_table(spark, sf, "part").select("p_partkey")
    h = F.substring(F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256), 1, 40)
    a = with_hash160_address(p.withColumn("h", h), "h", "a")
    last = F.substring("a", -1, 1)
    cut = F.substring("a", F.lit(1), F.length("a") - 1)
    case = F.col("p_partkey") % 7
    text = (F.when(case == 1, F.concat(cut, F.when(last == "2", F.lit("3")).otherwise(F.lit("2"))))
            .when(case == 2, F.concat(F.lit("0"), F.col("a")))
            .when(case == 3, F.substring("a", 1, 3))
            .when(case == 4, F.lit("3QJmnh"))
            .when(case == 5, F.lit(None).cast("string"))
            .otherwise(F.col("a")))
    d = a.select("p_partkey", text.alias("text"))
    c = decode_address(F.col("text"))
    return d.select("p_partkey", "text", c["valid"].alias("valid"), c["version"].alias("version"),
                    c["payload_hex"].alias("payload_hex"))


def _stored_elements(spark, sf):
    """The element table as a stored table, as a decode leaves it."""
    return materialize(spark, _el(spark, sf), "elements")


def top_unspent_by_address(spark, sf):
    """The largest unspent outputs of a stored table: addresses of the winners'
    rows ride through the top-k, and only their files are read again (T1)."""
    return utxo.top_unspent(_stored_elements(spark, sf), 100)


def unspent_outputs_filtered(spark, sf):
    """Every unspent output, spent ones dropped by a Bloom filter of the
    surviving keys before the payload is shuffled (A1, F1)."""
    u = utxo.unspent_outputs(_el(spark, sf), strategy="filter")
    return u.select("type", "block_hash", "tx_idx", "tx_hash", "idx", "amount",
                    enc.hex_lower(F.col("script")).alias("script_hex"))


def sql_script_chunks(spark, sf):
    """Script chunks by a table function in SQL."""
    register_table_functions(spark)
    name = register_views(spark, sf, prefix="ul_")["elements"]
    return spark.sql(f"""
        SELECT e.type, e.tx_hash, e.idx, c.pos, c.opcode, c.name, c.data_hex, c.start
        FROM {name} e, LATERAL script_chunks_of(e.script) c""")


def block_index_cells(spark, sf):
    """The block index from exported cells through its catalog."""
    return cells.read_cells(cells.to_cells(_bi(spark, sf), cells.BLOCK_CATALOG), cells.BLOCK_CATALOG)


def tx_index_cells(spark, sf):
    """The transaction index from exported cells through its catalog."""
    return cells.read_cells(cells.to_cells(fx.tx_index(spark, sf), cells.TRANSACTION_CATALOG),
                            cells.TRANSACTION_CATALOG)


def block_file_scan(spark, sf):
    """Raw block files made of the tables' nested records, read by byte ranges
    with their hashes checked, summed per block time (S1, S2, S3)."""
    # the test tables are one file each: dealt anew, so that many tasks write
    folder = blockwrite.write_block_files(fx.nested_fragments(spark, sf).repartition("t"),
                                          f"{checkpoint_dir(spark).rstrip('/')}/utxolens/blocks-{uuid.uuid4().hex}")
    found = blockfile.read_block_files(spark, folder, verify=True, split_bytes=4 << 20,
                                       max_block=1 << 20)
    v = found.select("t", F.size("transactions").alias("n_tx"),
                     blocks.block_output_value(F.col("transactions")).alias("value"),
                     F.aggregate("transactions", F.lit(0), lambda a, x: a + F.size(x["inputs"])).alias("n_in"),
                     F.aggregate("transactions", F.lit(0), lambda a, x: a + F.size(x["outputs"])).alias("n_out"))
    return v.groupBy("t").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tx").alias("n_transactions"),
                              F.sum("n_in").alias("n_inputs"), F.sum("n_out").alias("n_outputs"),
                              F.sum("value").alias("value"))


QUERIES: dict[str, Query] = {
    # sources / views
    "elements_scan": elements_scan,
    "blocks_scan": blocks_scan,
    "block_index_scan": lambda s, d: _bi(s, d),
    "tx_index_scan": lambda s, d: fx.tx_index(s, d),
    "sql_over_views": sql_over_views,
    # outpoints and unspent outputs
    "outpoint_key": lambda s, d: utxo.outpoint_keys(_el(s, d)),
    "outpoint_state": lambda s, d: utxo.outpoint_state(_el(s, d)),
    "unspent_outputs": unspent_outputs,
    "top_unspent": lambda s, d: utxo.top_unspent(_el(s, d), 100),
    "top_unspent_with_script": lambda s, d: utxo.top_unspent(_el(s, d), 100, with_script=True),
    # addresses
    "output_addresses": lambda s, d: utxo.output_addresses(_el(s, d)),
    "element_addresses": lambda s, d: utxo.element_addresses(_el(s, d)),
    "top_addresses": lambda s, d: utxo.top_addresses(_el(s, d), 10_000),
    "address_balances": lambda s, d: utxo.address_balances(_el(s, d)),
    "address_validation": address_validation,
    "address_checks": address_checks,
    "pubkey_addresses": pubkey_addresses,
    # scripts
    "block_script_structs": lambda s, d: scriptstats.block_script_structs(_el(s, d)),
    "blocks_without_opcodes": lambda s, d: scriptstats.blocks_without_opcodes(_el(s, d), 30),
    "script_distribution": lambda s, d: scriptstats.script_distribution(_el(s, d)),
    "unspent_script_types": lambda s, d: scriptstats.unspent_script_types(_el(s, d)),
    "script_type_distribution": lambda s, d: scriptstats.script_type_distribution(_el(s, d)),
    "script_chunks": lambda s, d: scriptstats.script_chunks(_el(s, d)),
    "opcode_histogram": lambda s, d: scriptstats.opcode_histogram(_el(s, d)),
    "script_asm": lambda s, d: scriptstats.script_asm(_el(s, d)),
    "script_flags": lambda s, d: scriptstats.script_flags(_el(s, d)),
    "script_pubkeys": lambda s, d: scriptstats.script_pubkeys(_el(s, d)),
    "cltv_channels": lambda s, d: scriptstats.cltv_channels(_el(s, d)),
    "sigops_per_block": lambda s, d: scriptstats.sigops_per_block(_el(s, d)),
    "p2sh_sigops_per_block": lambda s, d: scriptstats.p2sh_sigops_per_block(_el(s, d)),
    "nonminimal_pushes": lambda s, d: scriptstats.nonminimal_pushes(_el(s, d)),
    # block index
    "block_count": lambda s, d: blocks.row_count(_bi(s, d)),
    "transaction_count": lambda s, d: blocks.row_count(fx.tx_index(s, d)),
    "block_ts": lambda s, d: blocks.block_ts(_bi(s, d)),
    "block_iso_time": lambda s, d: blocks.block_iso_time(_bi(s, d)),
    "blocks_per_year": lambda s, d: blocks.blocks_per_year(_bi(s, d)),
    "block_extremes_per_month": lambda s, d: blocks.block_extremes_per_month(_bi(s, d)),
    "small_blocks_per_month": lambda s, d: blocks.small_blocks_per_month(_bi(s, d), 10),
    "blocks_fewest_tx": lambda s, d: blocks.blocks_fewest_tx(_bi(s, d), 1000),
    "largest_blocks": lambda s, d: blocks.largest_blocks(_bi(s, d), 100),
    "reversed_hash": reversed_hash,
    "double_sha256": double_sha256,
    "base58_text": base58_text,
    # block values
    "block_values": block_values,
    "recent_blocks": lambda s, d: blocks.recent_block_values(
        fx.transactions_flat(s, d), fx.outputs_with_time(s, d), 30),
    "flatten_outputs": flatten_outputs,
    # nested records
    "nested_block_values": nested_block_values,
    "nested_transactions": nested_transactions,
    "nested_outputs": nested_outputs,
    "nested_elements": nested_elements,
    # stored tables, raw files, cells, SQL table functions
    "top_unspent_by_address": top_unspent_by_address,
    "unspent_outputs_filtered": unspent_outputs_filtered,
    "block_file_scan": block_file_scan,
    "block_index_cells": block_index_cells,
    "tx_index_cells": tx_index_cells,
    "sql_script_chunks": sql_script_chunks,
    # other aggregates
    "mode_max": lambda s, d: modes.mode_max(fx.mode_input(s, d), "event_type", "v")
    .withColumnRenamed("mode", "mode_value"),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
