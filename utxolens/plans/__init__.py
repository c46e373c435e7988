"""Named queries with their DuckDB oracles, and the batch-job registry."""
