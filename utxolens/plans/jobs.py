"""The reference's batch jobs as ``run_job(spark, name, input_path, output_path)``.

Block-file jobs take a block-file path/glob (or, with ``input_format`` set,
an already decoded nested-block table); table jobs take the path of the
block or transaction index table. Results are written as CSV.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocks as B
from ..operators import scriptstats, utxo
from ..sources import manifest, sinks, tables

Job = Callable[[SparkSession, str, str, str | None], None]


def _blocks(spark: SparkSession, path: str, fmt: str | None) -> DataFrame:
    """Nested blocks: a decoded table as is, or raw files through the decode
    store under the shared checkpoint folder, so that all jobs share a decode."""
    if fmt:
        return spark.read.format(fmt).load(path)
    return manifest.DecodeStore(spark).blocks(path)


def _elements(spark: SparkSession, path: str, fmt: str | None) -> DataFrame:
    return B.elements_from_blocks(_blocks(spark, path, fmt))


# Decoded hashes are canonical lower-case hex, so the outpoint fold can
# shuffle binary keys (compact_keys).

def _amounts(spark, inp, out, fmt=None):
    sinks.write_single_csv(utxo.top_unspent_nested(_blocks(spark, inp, fmt), 100), out)


def _addresses(spark, inp, out, fmt=None):
    sinks.write_single_csv(
        utxo.top_addresses(_elements(spark, inp, fmt), 10_000, compact_keys=True), out)


def _unspent_scripts(spark, inp, out, fmt=None):
    sinks.write_single_csv(utxo.top_unspent_nested(_blocks(spark, inp, fmt), 100, with_script=True), out)


def _block_with_script(spark, inp, out, fmt=None):
    sinks.write_single_csv(scriptstats.blocks_without_opcodes(_elements(spark, inp, fmt), 30), out)


def _transaction_amount(spark, inp, out, fmt=None):
    # one row per block grows with the chain: written as ordered part files
    # (range-partitioned sort), not through a single task
    sinks.write_csv(B.block_values_nested(_blocks(spark, inp, fmt)), out)


def _script_distribution(spark, inp, out, fmt=None):
    sinks.write_csv(scriptstats.script_distribution(_elements(spark, inp, fmt)), out)


def _block_count(spark, inp, out, fmt="parquet"):
    sinks.write_csv(B.row_count(tables.read_block_index(spark, inp, fmt or "parquet")), out)


def _transaction_count(spark, inp, out, fmt="parquet"):
    sinks.write_csv(B.row_count(tables.read_tx_index(spark, inp, fmt or "parquet")), out)


def _few_transactions(spark, inp, out, fmt="parquet"):
    sinks.write_csv(B.blocks_fewest_tx(tables.read_block_index(spark, inp, fmt or "parquet"), 1000),
                    out)


JOBS: dict[str, Job] = {
    "amounts": _amounts,
    "addresses": _addresses,
    "find_address": _addresses,
    "unspent_script_types": _unspent_scripts,
    "unspent_script_distribution": _unspent_scripts,
    "block_with_script": _block_with_script,
    "transaction_amount": _transaction_amount,
    "script_distribution": _script_distribution,
    "block_count": _block_count,
    "transaction_count": _transaction_count,
    "block_with_few_transactions": _few_transactions,
}


# Default result folders of the table jobs.
DEFAULT_OUTPUTS = {
    "block_count": "/result/block-count",
    "block_with_few_transactions": "/result/block-few-trans",
    "transaction_count": "/result/transaction-count",
}


def run_job(spark: SparkSession, name: str, input_path: str, output_path: str | None = None,
            input_format: str | None = None) -> str:
    """Run one named job end to end (read → operators → CSV); returns the
    output folder (a table job's default folder when none is given)."""
    from ..session import ship_package

    if name not in JOBS:
        raise KeyError(f"unknown job {name!r}; known: {sorted(JOBS)}")
    out = output_path or DEFAULT_OUTPUTS.get(name)
    if out is None:
        raise ValueError(f"job {name!r} needs an output path")
    ship_package(spark)
    JOBS[name](spark, input_path, out, input_format)
    return out
