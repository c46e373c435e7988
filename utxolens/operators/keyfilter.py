"""A Bloom filter of a key set, to drop rows before they are shuffled.

A join of wide rows against a key set moves every wide row, also those without
a partner. ``KeyFilter`` is a bit table of the keys, small enough to broadcast:
its size follows from their count (``BITS_PER_KEY`` each) and is checked against
``MAX_BYTES``; beyond that there is no filter and the join does all the work.
Rows that pass may still be without a partner (less than one in a thousand), so
the exact join stays.

The table is cut into blocks of ``BLOCK`` bytes and all bits of a key lie in
one block. Key hashes are computed natively and dealt to tasks by block; a task
sets the bits of its blocks, and the blocks are gathered once. The test is an
Arrow UDF over the 64-bit hash alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS_PER_KEY = 16
HASHES = 8
BLOCK = 4096
MAX_BYTES = 64 << 20


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of each hash's bits, one row per hash."""
    h = h.view(np.uint64)
    block = (h % np.uint64(blocks)).astype(np.int64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    first, step = (h >> np.uint64(20)).astype(np.int64), (h >> np.uint64(41)).astype(np.int64) | 1
    at = (first[:, None] + step[:, None] * np.arange(HASHES)) % (8 * BLOCK)
    return block[:, None] * BLOCK + (at >> 3), np.left_shift(1, at & 7).astype(np.uint8)


class KeyFilter:
    """The bit table of a key set; ``test`` keeps its keys and few others."""

    def __init__(self, spark, blocks: int, table: bytes):
        self.blocks, self.size = blocks, len(table)
        self._known = spark.sparkContext.broadcast(table)

    def test(self, *key: str | Column) -> Column:
        known, blocks = self._known, self.blocks

        @F.arrow_udf(T.BooleanType())
        def held(hashes: pa.Array) -> pa.Array:
            table = np.frombuffer(known.value, np.uint8)
            byte, bit = _places(hashes.to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            return pa.array((table[byte] & bit != 0).all(axis=1))

        return held(F.xxhash64(*key))


def build(keys: DataFrame, key: list[str], n: int, bits_per_key: int = BITS_PER_KEY,
          max_bytes: int = MAX_BYTES) -> KeyFilter | None:
    """The filter of the ``n`` rows of ``keys``, or None beyond ``max_bytes``."""
    spark = keys.sparkSession
    blocks = max(1, -(-n * bits_per_key // (8 * BLOCK)))
    if blocks * BLOCK > max_bytes:
        return None

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column("h").to_numpy()
            byte, bit = _places(h, blocks)
            block = byte[:, 0] // BLOCK
            order = np.argsort(block, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(rows):
                    own = tables.setdefault(int(block[rows[0]]), np.zeros(BLOCK, np.uint8))
                    np.bitwise_or.at(own, byte[rows] % BLOCK, bit[rows])
        if tables:
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(list(tables), pa.int64()),
                 "bits": pa.array([t.tobytes() for t in tables.values()], pa.binary())})

    h = F.xxhash64(*key)
    # the block of a hash taken as unsigned, as in ``_places``
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    block = (high % blocks * (2 ** 32 % blocks) + low) % blocks
    rows = (keys.select(h.alias("h")).repartition(block).mapInArrow(fill, "block bigint, bits binary")
            .collect())                                    # at most ``max_bytes``
    table = bytearray(blocks * BLOCK)
    for r in rows:
        table[r.block * BLOCK:(r.block + 1) * BLOCK] = r.bits
    return KeyFilter(spark, blocks, bytes(table))
