"""Operators over ledger DataFrames: unspent-output fold, block rollups,
script statistics, modes."""
