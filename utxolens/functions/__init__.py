"""Column functions: hex/hash/Base58 encodings, script templates and
addresses, the script parser, opcode names, validation, time formats, SQL
registration."""
