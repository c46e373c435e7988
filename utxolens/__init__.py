"""utxolens — UTXO ledger analytics as Spark DataFrame operators.

Subpackages:
  sources    ledger views/readers, raw block-file decoder, CSV sinks
  functions  column functions (hex, hashes, Base58, addresses, script parsing)
  operators  unspent-output fold, block rollups, script statistics, modes
  plans      named queries, their DuckDB oracles, the job registry
  streaming  incremental block-file ingest (file stream → Parquet)
"""

__version__ = "0.1.0"
