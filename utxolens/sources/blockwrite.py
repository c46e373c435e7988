"""Nested block records → raw block files, for tests of readers and for export.

Every record is one block: a header that holds the root of its transactions,
and the transactions in wire format. Hashes of earlier outputs that are no
64-digit hex text are written as the SHA-256 of the text, and a transaction
without inputs gets the null input, so any table of nested records can be written. A task writes one file, named by its partition
and moved into place when it is complete, so a task that runs again leaves one.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .blockfile import MAINNET_MAGIC, _sha256d, merkle_root
from .blockscan import _local, _remote


def _varint(n: int) -> bytes:
    if n < 0xFD:
        return bytes([n])
    for mark, width in ((0xFD, 2), (0xFE, 4), (0xFF, 8)):
        if n < 1 << 8 * width:
            return bytes([mark]) + n.to_bytes(width, "little")
    raise ValueError("a count beyond 64 bits")


def _hash_bytes(text: str) -> bytes:
    try:
        raw = bytes.fromhex(text)[::-1]
    except ValueError:
        raw = b""
    return raw if len(raw) == 32 else hashlib.sha256(text.encode()).digest()


# the input of a transaction that spends nothing
NULL_INPUT = {"prev_hash": "00" * 32, "prev_idx": 0xFFFFFFFF, "script": b""}


def transaction_bytes(tx: dict, lock: int = 0) -> bytes:
    inputs = tx["inputs"] or [NULL_INPUT]           # none at all would read as the witness marker
    out = [struct.pack("<i", 1), _varint(len(inputs))]
    for i in inputs:
        script = bytes(i["script"] or b"")
        out += [_hash_bytes(i["prev_hash"]), struct.pack("<I", i["prev_idx"]), _varint(len(script)), script,
                b"\xff" * 4]
    out.append(_varint(len(tx["outputs"])))
    for o in tx["outputs"]:
        script = bytes(o["script"] or b"")
        out += [struct.pack("<q", o["value"]), _varint(len(script)), script]
    return b"".join([*out, struct.pack("<I", lock)])


def block_record(t: int, transactions: list[dict], magic: bytes = MAINNET_MAGIC) -> bytes:
    """One record of a block file. A transaction's place is its lock time, so
    that transactions of equal content have hashes of their own."""
    txs = [transaction_bytes(tx, i) for i, tx in enumerate(transactions)]
    header = b"".join([struct.pack("<i", 1), b"\x00" * 32, merkle_root([_sha256d(x) for x in txs]),
                       struct.pack("<iII", t, 0, 0)])
    block = b"".join([header, _varint(len(txs)), *txs])
    return magic + struct.pack("<I", len(block)) + block


_VARINT = [bytes([n]) for n in range(0xFD)]
_VERSION, _SEQUENCE, _HEAD = struct.pack("<i", 1), b"\xff" * 4, struct.pack("<i", 1) + b"\x00" * 32
_NULL_INPUT = _hash_bytes(NULL_INPUT["prev_hash"]) + struct.pack("<IB", NULL_INPUT["prev_idx"], 0) + _SEQUENCE


def _count(n: int) -> bytes:
    return _VARINT[n] if n < 0xFD else _varint(n)


def _scripts(values: pa.Array) -> Iterator[bytes]:
    """Scripts with their lengths before them; a null one is empty."""
    return (_count(len(s)) + s if s else b"\x00" for s in values.to_pylist())


def _fields(lists: pa.Array) -> tuple[list[int | None], dict[str, pa.Array]]:
    """How long each list is (null: no list), and the fields of all their items."""
    items = lists.flatten()
    return (lists.value_lengths().to_pylist(),
            dict(zip((f.name for f in items.type), items.flatten(), strict=True)))


def block_records(batch: pa.RecordBatch, magic: bytes = MAINNET_MAGIC) -> Iterator[bytes]:
    """``block_record`` of every row of ``t, transactions``. Inputs and outputs of
    all rows are written column by column, so no row becomes nested objects."""
    n_tx, tx = _fields(batch.column("transactions"))
    n_in, ins = _fields(tx["inputs"])
    n_out, outs = _fields(tx["outputs"])
    u32, i64 = struct.Struct("<I").pack, struct.Struct("<q").pack
    inputs = [_hash_bytes(h) + u32(i) + s + _SEQUENCE for h, i, s in zip(
        ins["prev_hash"].to_pylist(), ins["prev_idx"].to_pylist(), _scripts(ins["script"]))]
    outputs = [i64(v) + s for v, s in zip(outs["value"].to_pylist(), _scripts(outs["script"]))]
    at = i = o = 0
    for t, n in zip(batch.column("t").to_pylist(), n_tx):
        txs = []
        for lock in range(n):
            k, m = n_in[at], n_out[at]
            txs.append(b"".join((
                _VERSION, _count(k) if k else b"\x01", *(inputs[i:i + k] if k else (_NULL_INPUT,)),
                _count(m), *outputs[o:o + m], u32(lock))))
            at, i, o = at + 1, i + (k or 0), o + m
        block = b"".join((_HEAD, merkle_root([_sha256d(x) for x in txs]), struct.pack("<iII", t, 0, 0),
                          _count(n), *txs))
        yield magic + u32(len(block)) + block


def write_block_files(blocks: DataFrame, folder: str, magic: bytes = MAINNET_MAGIC) -> str:
    """Write ``t, transactions`` of nested blocks as files under ``folder``, one
    per task; returns the folder."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = _local(folder)
        system, base = (None, own) if own is not None else _remote(folder)
        name = f"{base}/blk{TaskContext.get().partitionId():05d}.dat"
        draft = f"{base}/.{uuid.uuid4().hex}"
        if system is None:
            os.makedirs(base, exist_ok=True)
        else:
            system.create_dir(base)
        n = 0
        with open(draft, "wb") if system is None else system.open_output_stream(draft) as f:
            for b in batches:
                for record in block_records(b, magic):
                    f.write(record)
                n += b.num_rows
        if system is None:
            os.replace(draft, name)
        else:
            system.move(draft, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    blocks.select("t", "transactions").mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()
    return folder
