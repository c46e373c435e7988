"""Table functions for SQL.

``script_chunks_of(script)``: a row per chunk of a script that parses, none for
NULL and malformed ones. Used beside a table,

    SELECT e.tx_hash, c.* FROM elements e, LATERAL script_chunks_of(e.script) c

it gives the rows of ``operators.scriptstats.script_chunks``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import opcodes as op
from .scripts import is_opcode, parse


class ScriptChunks:
    """Chunks of one script: place, opcode, name, data as hex, first byte."""

    def eval(self, script: bytes) -> Iterator[tuple]:
        chunks, ok = parse(bytes(script)) if script is not None else ([], False)
        for pos, (code, data, start) in enumerate(chunks if ok else ()):
            yield (pos, code, op.opcode_name(code) if is_opcode(code) else op.push_name(code),
                   None if data is None else data.hex(), start)


def register_table_functions(spark: SparkSession) -> list[str]:
    """Register the table functions for SQL; returns their names."""
    from ..session import ship_package

    ship_package(spark)
    spark.udtf.register("script_chunks_of", udtf(
        ScriptChunks, returnType="pos int, opcode int, name string, data_hex string, start int"))
    return ["script_chunks_of"]
