"""Sources and sinks: test-table ledger views, explicit-schema readers, the
raw block-file decoder, CSV writers."""
