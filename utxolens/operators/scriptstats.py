"""Script-level operators over ``elements``: structures, types, chunks,
disassembly, flags, keys, signature-operation counts.

Distributions are grouped aggregates on a short string key (partial
aggregation first). Per-block sums group on the block hash. Python only
parses scripts (Arrow batches); everything around it is native.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import scriptscan as V
from ..functions.address import script_type
from ..functions.encoding import hex_lower
from . import utxo

KEY = ["tx_hash", "idx"]


def block_script_structs(elements: DataFrame) -> DataFrame:
    """``blockId, scriptStruct`` for every input and output."""
    return S.with_structure(elements.select(F.col("block_hash").alias("blockId"), "script"),
                            "script", "scriptStruct").drop("script")


def blocks_without_opcodes(elements: DataFrame, k: int = 30) -> DataFrame:
    """k rows (by block id) whose script has no opcode at all (structure '').

    A script that starts with an opcode byte (> 0x4e) always has a non-empty
    structure, so that native test drops most outputs before structures are
    computed."""
    first = F.conv(hex_lower(F.substring(F.col("script"), 1, 1)), 16, 10).cast("int")
    cand = elements.where((F.length("script") == 0) | (first <= 0x4E))
    return (block_script_structs(cand)
            .where(F.col("scriptStruct") == "")
            .orderBy("blockId").limit(k))


def script_distribution(elements: DataFrame) -> DataFrame:
    """``scriptType, count``: structure strings over all outputs."""
    outs = elements.where(F.col("type") == 1)
    return (S.with_structure(outs.select("script"), "script", "scriptType")
                .groupBy("scriptType").agg(F.count(F.lit(1)).alias("count"))
                .orderBy("count", "scriptType"))


def unspent_script_types(elements: DataFrame, compact_keys: bool = False) -> DataFrame:
    """``scriptStruct, count``: structure strings over unspent outputs.

    The structure (a short text) rides through the outpoint fold in place of the
    script: one scan, one shuffle of keys, one of distinct structures."""
    own = elements.select("type", *KEY, F.when(F.col("type") == 1, F.col("script")).alias("script"))
    told = S.with_structure(own, "script", "scriptStruct").drop("script")
    return (utxo.unspent_keys(told, "scriptStruct", compact_keys=compact_keys)
            .groupBy("scriptStruct").agg(F.count(F.lit(1)).alias("count")))


def script_type_distribution(elements: DataFrame) -> DataFrame:
    """``script_type, n`` over all outputs (P2PKH, PUB_KEY, P2SH, NO_TYPE)."""
    outs = elements.where(F.col("type") == 1)
    return (outs.select(script_type(F.col("script")).alias("script_type"))
                .groupBy("script_type").agg(F.count(F.lit(1)).alias("n")))


def script_chunks(elements: DataFrame) -> DataFrame:
    """One row per chunk of every well-formed script:
    ``type, tx_hash, idx, pos, opcode, name, data_hex, start``."""
    c = elements.select("type", *KEY, F.explode(S.script_chunk_rows(F.col("script"))).alias("c"))
    return c.select("type", *KEY, "c.pos", "c.opcode", "c.name", "c.data_hex", "c.start")


def opcode_histogram(elements: DataFrame) -> DataFrame:
    """``name, n``: how often each opcode occurs across all well-formed scripts.

    A task hands on at most 256 counts per Arrow batch, not a row per opcode."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for scan in V.slices(b.column(0)):
                total += V.opcode_counts(scan)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])],
                                         names=["opcode", "n"])

    per_task = elements.select("script").mapInArrow(count, "opcode int, n bigint")
    return (per_task.groupBy("opcode").agg(F.sum("n").alias("n"))
            .select(S.opcode_name_col(F.col("opcode")).alias("name"), "n"))


def script_asm(elements: DataFrame) -> DataFrame:
    return elements.select("type", *KEY, S.script_asm(F.col("script")).alias("asm"))


def script_flags(elements: DataFrame) -> DataFrame:
    """``type, tx_hash, idx, is_multisig, is_cltv, is_op_return`` (false when malformed)."""
    f = S.script_flags(F.col("script"))
    return elements.select("type", *KEY, *[f[c].alias(c) for c in ("is_multisig", "is_cltv", "is_op_return")])


def script_pubkeys(elements: DataFrame) -> DataFrame:
    """``type, tx_hash, idx, pubkey_hex`` for two-chunk scripts that carry a key.

    Both key forms start with a push (first byte <= 0x4e); other scripts are
    dropped natively before the parser runs."""
    first = F.conv(hex_lower(F.substring(F.col("script"), 1, 1)), 16, 10).cast("int")
    # exploding a list of none or one parses each script once; a filter on the
    # key would be pushed down and parse it again
    return elements.where(first <= 0x4E).select(
        "type", *KEY, F.explode(S.script_pubkeys(F.col("script"))).alias("pubkey_hex"))


def cltv_channels(elements: DataFrame) -> DataFrame:
    """``tx_hash, idx, sender_hex, recipient_hex, expiry`` of CLTV payment-channel outputs."""
    h = hex_lower(F.col("script"))
    # the channel shape starts with IF and ends with CHECKSIG: a native
    # necessary condition, so only candidates reach the parser
    cand = elements.where((F.col("type") == 1) & h.startswith("63") & h.endswith("ac"))
    one = F.array(S.chunks_of(S.parsed_script(F.col("script"))))
    p = cand.select(*KEY, F.explode(F.filter(one, S.is_cltv_channel)).alias("ch"))
    ch = F.col("ch")
    return p.select(*KEY, S.cltv_sender_hex(ch).alias("sender_hex"),
                    S.cltv_recipient_hex(ch).alias("recipient_hex"),
                    S.cltv_expiry(ch).alias("expiry"))


def sigops_per_block(elements: DataFrame) -> DataFrame:
    """``block_hash, sigops``: legacy signature operations of all scripts in a block."""
    return (S.with_sigops(elements.select("block_hash", "script"), "script", "s")
                    .groupBy("block_hash").agg(F.sum("s").alias("sigops")))


def p2sh_sigops_per_block(elements: DataFrame) -> DataFrame:
    """``block_hash, p2sh_sigops, n_unparsable``: accurate redeem-script sigops
    of all inputs, and how many inputs have a last push that is no script (the
    sum leaves those out)."""
    ins = elements.where(F.col("type") == 0)
    return (ins.select("block_hash", S.script_p2sh_sigops(F.col("script")).alias("s"))
               .groupBy("block_hash").agg(F.sum("s").alias("p2sh_sigops"),
                    F.count(F.when(F.col("s").isNull(), 1)).alias("n_unparsable")))


def nonminimal_pushes(elements: DataFrame) -> DataFrame:
    """``block_hash, n_nonminimal``: pushes not using their shortest encoding,
    per block (blocks with none are omitted)."""
    bad = elements.select("block_hash", S.script_nonminimal(F.col("script")).alias("k"))
    return (bad.groupBy("block_hash").agg(F.sum("k").alias("n_nonminimal"))
               .where(F.col("n_nonminimal") > 0))
