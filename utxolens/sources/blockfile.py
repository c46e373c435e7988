"""Raw block files → nested block records (and, by ``explode``, elements).

A block file is a sequence of records ``magic(4) size(4, LE) block(size)``;
a block is an 80-byte header (version, previous hash, merkle root, time,
bits, nonce), a varint transaction count and the transactions in wire
format (with the optional segregated-witness marker, whose witness data is
skipped). Hashes are double SHA-256, shown as lower-case hex in reversed
byte order (the usual display order); an input's previous-output hash uses
the same form, so outpoints match transaction hashes.

Files are read by the ``blockfile`` data source (``blockscan``): its
partitions are byte ranges, so a file of any size is read by many tasks of
bounded memory. Here are the block decoder, which fills Arrow columns
directly, the integrity checks, and the DataFrame readers. With
``verify=True`` a block counts only if its transactions hash to the merkle
root of its header (and witness data to the coinbase's commitment); any other
record is a rejected range. Damaged ranges fail a read unless
``on_damage="skip"``; ``rejected_ranges`` lists them. Decode once and write
Parquet; query the Parquet.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas

# Fixed value: the main network's record marker.
MAINNET_MAGIC = bytes.fromhex("f9beb4d9")
# Fixed value: how a coinbase output commits to the witness data (RETURN, a
# push of 36 bytes, the commitment header; the 32-byte commitment follows).
WITNESS_COMMITMENT = bytes.fromhex("6a24aa21a9ed")

MAX_BLOCK = 8 << 20       # longest block that is read
SPLIT_BYTES = 64 << 20    # bytes of a file per task
BATCH_BYTES = 16 << 20    # bytes of blocks in one Arrow batch

BLOCK_FILE_ROWS = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("size", T.IntegerType())]
    + list(schemas.BLOCKS_NESTED.fields))


class DamagedBlock(ValueError):
    """Bytes that are no block, or one that fails its own hashes."""


class DamagedBlockFile(ValueError):
    """A byte range of a block file that is neither a block nor zero fill."""


_SHA = hashlib.sha256


def _sha256d(b: bytes) -> bytes:
    return _SHA(_SHA(b).digest()).digest()


def _display(h: bytes) -> str:
    return h[::-1].hex()


_U32, _I64 = struct.Struct("<I").unpack_from, struct.Struct("<q").unpack_from
_WIDTH = {0xFD: 2, 0xFE: 4, 0xFF: 8}
_ENDS_EARLY = "record ends early"


def _varint(buf: bytes, pos: int) -> tuple[int, int]:
    """A varint of more than one byte at ``pos``, and where it ends."""
    end = pos + 1 + _WIDTH[buf[pos]]
    if end > len(buf):
        raise DamagedBlock(_ENDS_EARLY)
    return int.from_bytes(buf[pos + 1:end], "little"), end


@dataclass(slots=True)
class Block:
    """One decoded block as flat columns: the lists below ``n_inputs`` and
    ``n_outputs`` run over all its transactions."""

    block_hash: str
    t: int
    merkle_root: bytes
    tx_hash: list[bytes] = field(default_factory=list)
    witness_hash: list[bytes] = field(default_factory=list)
    n_inputs: list[int] = field(default_factory=list)
    prev_hash: list[str] = field(default_factory=list)
    prev_idx: list[int] = field(default_factory=list)
    in_script: list[bytes] = field(default_factory=list)
    n_outputs: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)
    out_script: list[bytes] = field(default_factory=list)
    has_witness: bool = False
    reserved: bytes | None = None              # first witness item of the coinbase


def _read_transaction(buf: bytes, pos: int, b: Block, verify: bool) -> int:
    """Add the transaction at ``pos`` to ``b``; where it ends. Numbers past the
    end raise by themselves (``parse_block``), a slice has to be looked at."""
    start, end = pos, len(buf)
    pos += 4
    segwit = pos + 2 <= end and buf[pos] == 0 and buf[pos + 1] == 1
    if segwit:
        pos += 2
    body_start = pos
    n_in, pos = (buf[pos], pos + 1) if buf[pos] < 0xFD else _varint(buf, pos)
    for _ in range(n_in):
        prev, (idx,) = pos, _U32(buf, pos + 32)
        pos += 36
        n, pos = (buf[pos], pos + 1) if buf[pos] < 0xFD else _varint(buf, pos)
        if pos + n + 4 > end:                       # the script and the sequence
            raise DamagedBlock(_ENDS_EARLY)
        b.prev_hash.append(buf[prev:prev + 32][::-1].hex())
        b.prev_idx.append(idx)
        b.in_script.append(buf[pos:pos + n])
        pos += n + 4
    b.n_inputs.append(n_in)
    n_out, pos = (buf[pos], pos + 1) if buf[pos] < 0xFD else _varint(buf, pos)
    for _ in range(n_out):
        b.value.append(_I64(buf, pos)[0])
        pos += 8
        n, pos = (buf[pos], pos + 1) if buf[pos] < 0xFD else _varint(buf, pos)
        if pos + n > end:
            raise DamagedBlock(_ENDS_EARLY)
        b.out_script.append(buf[pos:pos + n])
        pos += n
    b.n_outputs.append(n_out)
    body_end = pos
    if segwit:
        b.has_witness = True
        for i in range(n_in):
            items, pos = (buf[pos], pos + 1) if buf[pos] < 0xFD else _varint(buf, pos)
            for k in range(items):
                n, pos = (buf[pos], pos + 1) if buf[pos] < 0xFD else _varint(buf, pos)
                if pos + n > end:
                    raise DamagedBlock(_ENDS_EARLY)
                if not b.tx_hash and i == 0 and k == 0:
                    b.reserved = buf[pos:pos + n]
                pos += n
    pos += 4                                        # lock time
    if pos > end:
        raise DamagedBlock(_ENDS_EARLY)
    if segwit:
        b.tx_hash.append(_sha256d(buf[start:start + 4] + buf[body_start:body_end] + buf[pos - 4:pos]))
        b.witness_hash.append(_sha256d(buf[start:pos]) if verify else b"")
    else:
        b.tx_hash.append(_sha256d(buf[start:pos]))
        b.witness_hash.append(b.tx_hash[-1])
    return pos


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the hash tree over ``hashes``, level by level; the last of an odd
    level is paired with itself. Two equal hashes that are a real pair would
    give the same root as a shorter list, so they are refused."""
    if len(hashes) == 2 and hashes[0] != hashes[1]:
        return _sha256d(hashes[0] + hashes[1])
    level = list(hashes)
    while len(level) > 1:
        left, right = level[::2], level[1::2]
        if any(map(eq, left, right)):
            raise DamagedBlock("ambiguous merkle tree")
        if len(level) % 2:
            right.append(left[-1])
        level = [_sha256d(x + y) for x, y in zip(left, right)]
    return level[0] if level else b"\x00" * 32


def check_integrity(b: Block) -> None:
    """The transactions hash to the header's root, and witness data, if there
    is any, to the coinbase's commitment."""
    if merkle_root(b.tx_hash) != b.merkle_root:
        raise DamagedBlock("transactions do not hash to the merkle root")
    if not b.has_witness:
        return
    own = [s for s in b.out_script[:b.n_outputs[0]]
           if s.startswith(WITNESS_COMMITMENT) and len(s) >= len(WITNESS_COMMITMENT) + 32]
    if not own or b.reserved is None:
        raise DamagedBlock("witness data without a commitment")
    root = merkle_root([b"\x00" * 32, *b.witness_hash[1:]])
    at = len(WITNESS_COMMITMENT)
    if _sha256d(root + b.reserved) != own[-1][at:at + 32]:
        raise DamagedBlock("witness data does not hash to its commitment")


def parse_block(raw: bytes, verify: bool = False) -> Block:
    """One serialised block; raises ``DamagedBlock`` for anything else."""
    if len(raw) < 80:
        raise DamagedBlock(_ENDS_EARLY)
    try:
        header = raw[:80]
        # header time as a signed 32-bit int (the ``t int`` column; a value past
        # 2**31 wraps as in a Java int instead of failing the whole file)
        b = Block(_display(_sha256d(header)), struct.unpack_from("<i", header, 68)[0], header[36:68])
        n_tx, pos = (raw[80], 81) if raw[80] < 0xFD else _varint(raw, 80)
        for _ in range(n_tx):
            pos = _read_transaction(raw, pos, b, verify)
        if pos != len(raw):
            raise DamagedBlock(f"{len(raw) - pos} bytes after the last transaction")
    except (IndexError, struct.error) as e:
        raise DamagedBlock(_ENDS_EARLY) from e
    if verify:
        check_integrity(b)
    return b


def decode_block(raw: bytes, verify: bool = False) -> dict:
    """One serialised block → ``{block_hash, t, transactions}``."""
    b = parse_block(raw, verify)
    ins, outs, txs = zip(b.prev_hash, b.prev_idx, b.in_script), zip(b.value, b.out_script), []
    for h, n_in, n_out in zip(b.tx_hash, b.n_inputs, b.n_outputs):
        txs.append({
            "tx_hash": _display(h),
            "inputs": [dict(zip(("prev_hash", "prev_idx", "script"), next(ins))) for _ in range(n_in)],
            "outputs": [dict(zip(("value", "script"), next(outs))) for _ in range(n_out)]})
    return {"block_hash": b.block_hash, "t": b.t, "transactions": txs}


_INPUTS = pa.struct([("prev_hash", pa.string()), ("prev_idx", pa.int64()), ("script", pa.binary())])
_OUTPUTS = pa.struct([("value", pa.int64()), ("script", pa.binary())])
ARROW_ROWS = pa.schema([
    ("file", pa.string()), ("size", pa.int32()), ("block_hash", pa.string()), ("t", pa.int32()),
    ("transactions", pa.list_(pa.struct([("tx_hash", pa.string()), ("inputs", pa.list_(_INPUTS)),
                                         ("outputs", pa.list_(_OUTPUTS))])))])


class BlockColumns:
    """Decoded blocks gathered as Arrow columns; no object per transaction."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str, int]] = []
        self.n_tx: list[int] = []
        self.all = Block("", 0, b"")
        self.bytes = 0

    def add(self, file: str, size: int, b: Block) -> None:
        self.rows.append((file, size, b.block_hash, b.t))
        self.n_tx.append(len(b.tx_hash))
        a = self.all
        a.tx_hash += b.tx_hash
        a.n_inputs += b.n_inputs
        a.prev_hash += b.prev_hash
        a.prev_idx += b.prev_idx
        a.in_script += b.in_script
        a.n_outputs += b.n_outputs
        a.value += b.value
        a.out_script += b.out_script
        self.bytes += size

    @staticmethod
    def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
        ends = [0]
        for n in counts:
            ends.append(ends[-1] + n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def batch(self) -> pa.RecordBatch:
        a = self.all
        inputs = pa.StructArray.from_arrays(
            [pa.array(a.prev_hash, pa.string()), pa.array(a.prev_idx, pa.int64()),
             pa.array(a.in_script, pa.binary())], fields=list(_INPUTS))
        outputs = pa.StructArray.from_arrays(
            [pa.array(a.value, pa.int64()), pa.array(a.out_script, pa.binary())], fields=list(_OUTPUTS))
        txs = pa.StructArray.from_arrays(
            [pa.array([_display(h) for h in a.tx_hash], pa.string()), self._lists(a.n_inputs, inputs),
             self._lists(a.n_outputs, outputs)], fields=list(ARROW_ROWS.field("transactions").type.value_type))
        file, size, block_hash, t = zip(*self.rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(file, pa.string()), pa.array(size, pa.int32()), pa.array(block_hash, pa.string()),
             pa.array(t, pa.int32()), self._lists(self.n_tx, txs)], schema=ARROW_ROWS)


def batches_of(found: Iterator[tuple[str, int, Block] | pa.RecordBatch], blocks_per_batch: int
               ) -> Iterator[pa.RecordBatch]:
    """(file, size, block) as Arrow batches of bounded size; rows are handed on."""
    held = BlockColumns()
    for x in found:
        if isinstance(x, pa.RecordBatch):
            if held.rows:
                yield held.batch()
                held = BlockColumns()
            yield x
            continue
        held.add(*x)
        if len(held.rows) >= blocks_per_batch or held.bytes >= BATCH_BYTES:
            yield held.batch()
            held = BlockColumns()
    if held.rows:
        yield held.batch()


def read_block_files(spark: SparkSession, path: str, magic: bytes = MAINNET_MAGIC,
                     blocks_per_batch: int = 64, on_damage: str = "fail", verify: bool = False,
                     split_bytes: int = SPLIT_BYTES, max_block: int = MAX_BLOCK,
                     whole_files: bool = False) -> DataFrame:
    """``file, size, block_hash, t, transactions`` for every block in the files
    at ``path`` (a file, directory or glob), read in ranges of ``split_bytes``;
    the rows do not depend on the ranges. Damaged ranges fail the read unless
    ``on_damage="skip"``; ``rejected_ranges`` lists them. ``whole_files`` reads
    through Spark's own file systems, a file a task."""
    from . import blockscan

    return blockscan.load(spark, path, whole_files, magic=magic, verify=verify, splitBytes=split_bytes,
                          maxBlock=max_block, blocksPerBatch=blocks_per_batch, onDamage=on_damage)


def rejected_ranges(spark: SparkSession, path: str, magic: bytes = MAINNET_MAGIC, verify: bool = False,
                    split_bytes: int = SPLIT_BYTES, max_block: int = MAX_BLOCK,
                    whole_files: bool = False) -> DataFrame:
    """``file, offset, length, reason`` of every byte range that is not read:
    what lies before the first damaged record of a run, and the run from it on.

    Tasks report pieces; those that touch are joined per file (a file's pieces
    are as many as its damaged records and ranges)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from . import blockscan

    pieces = blockscan.load(spark, path, whole_files, magic=magic, verify=verify, splitBytes=split_bytes,
                            maxBlock=max_block, rows="rejected")
    w = Window.partitionBy("file").orderBy("offset")
    touches = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset"), F.lit(False))
    run = F.sum(F.when(touches, 0).otherwise(1)).over(w)
    failed = F.min(F.when(F.col("damaged"), F.col("offset"))).over(Window.partitionBy("file", "run"))
    return (pieces.withColumn("run", run).withColumn("tail", F.coalesce(F.col("offset") >= failed, F.lit(False)))
            .groupBy("file", "run", "tail")
            .agg(F.min("offset").alias("offset"), F.sum("length").alias("length"),
                 F.min_by("reason", "offset").alias("reason"), F.bool_or("filled").alias("filled"))
            .where("filled").select("file", "offset", "length", "reason"))


def block_file_index(blocks: DataFrame) -> DataFrame:
    """The block index table (``rowkey, transactionCounter, transactionDate,
    file, size``) from decoded blocks; ``size`` is the block's size in bytes."""
    from pyspark.sql import functions as F

    return blocks.select(
        F.col("block_hash").alias("rowkey"),
        F.size("transactions").cast("bigint").alias("transactionCounter"),
        F.col("t").alias("transactionDate"),
        F.col("file"),
        F.col("size"),
    )


def decode_to_parquet(spark: SparkSession, path: str, out: str,
                      magic: bytes = MAINNET_MAGIC, by_month: bool = True,
                      verify: bool = False) -> None:
    """Decode block files once and store the nested records as Parquet.

    With ``by_month`` the table is partitioned by the block's UTC month
    (``month = 'yyyy-MM'``): block files are roughly time ordered, so each
    task writes few partitions, and time-bounded queries prune the rest."""
    blocks = read_block_files(spark, path, magic, verify=verify)
    w = blocks.write.mode("overwrite")
    if by_month:
        w = with_month(blocks).write.mode("overwrite").partitionBy("month")
    w.parquet(out)


def with_month(blocks: DataFrame) -> DataFrame:
    """Blocks with ``month``, the UTC month of their time as ``yyyy-MM``."""
    from pyspark.sql import functions as F

    from ..functions.timefmt import epoch_to_ts

    return blocks.withColumn("month", F.date_format(epoch_to_ts(F.col("t")), "yyyy-MM"))
