"""Byte-range reading of block files: the same rows for every split, integrity."""

import os
import random
import struct
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_blockfile import MAGIC, record, sha256d, tx_bytes, varint
from utxolens.sources import blockfile as bf
from utxolens.sources import blockscan as bs
from utxolens.sources import blockwrite

COINBASE_IN = (b"\x00" * 32, 0xFFFFFFFF, b"\x01\x02")
P2PKH = bytes.fromhex("76a914" + "11" * 20 + "88ac")


def brute_root(hashes):
    while len(hashes) > 1:
        if len(hashes) % 2:
            hashes = hashes + hashes[-1:]
        hashes = [sha256d(a + b) for a, b in zip(hashes[::2], hashes[1::2])]
    return hashes[0]


def sealed(t, raws, plains):
    """A block whose header holds the root of its transactions."""
    header = struct.pack("<i", 1) + b"\x00" * 32 + brute_root([sha256d(p) for p in plains]) \
        + struct.pack("<III", t, 0x1D00FFFF, 7)
    return header + varint(len(raws)) + b"".join(raws)


def simple_block(t, n, payload=b""):
    txs = [tx_bytes([COINBASE_IN], [(t % 1000, P2PKH + payload)])[0]]
    txs += [tx_bytes([(sha256d(bytes([i])), i, b"\x51")], [(i, P2PKH)])[0] for i in range(n)]
    return sealed(t, txs, txs)


def witness_tx(inputs, outputs, items):
    body = varint(len(inputs))
    for prev, idx, script in inputs:
        body += prev + struct.pack("<I", idx) + varint(len(script)) + script + b"\xff" * 4
    body += varint(len(outputs))
    for value, script in outputs:
        body += struct.pack("<q", value) + varint(len(script)) + script
    wit = b"".join(varint(len(i)) + b"".join(varint(len(x)) + x for x in i) for i in items)
    ver, lock = struct.pack("<i", 2), b"\x00" * 4
    return ver + b"\x00\x01" + body + wit + lock, ver + body + lock


def witness_block(t=1_500_000_000, n=3, odd=False):
    spends = [witness_tx([(sha256d(bytes([i])), 0, b"")], [(i, P2PKH)], [[b"sig%d" % i, b"key"]])
              for i in range(n)]
    reserved = b"\x07" * 32
    root = brute_root([b"\x00" * 32] + [sha256d(r) for r, _ in spends])
    commitment = b"\x6a\x24\xaa\x21\xa9\xed" + sha256d(root + reserved)
    cb = witness_tx([COINBASE_IN], [(50, P2PKH), (0, commitment)], [[reserved]])
    return sealed(t, [cb[0]] + [r for r, _ in spends], [cb[1]] + [p for _, p in spends])


GENESIS = bytes.fromhex(
    "0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e"
    "67768f617fc81bc3888a51323a9fb8aa4b1e5e4a29ab5f49ffff001d1dac2b7c01010000000100000000000000000000"
    "00000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f"
    "4a616e2f32303039204368616e63656c6c6f72206f6e206272696e6b206f66207365636f6e64206261696c6f75742066"
    "6f722062616e6b73ffffffff0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a6"
    "7962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000")


def test_genesis_and_witness_blocks_pass():
    b = bf.decode_block(GENESIS, verify=True)
    assert b["transactions"][0]["tx_hash"] == "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"
    for n in (1, 2, 3, 6):
        assert len(bf.decode_block(witness_block(n=n), verify=True)["transactions"]) == n + 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12])
def test_merkle_root_equals_brute_force(n):
    hashes = [sha256d(bytes([i])) for i in range(n)]
    assert bf.merkle_root(hashes) == brute_root(hashes)


def test_ambiguous_tree_is_refused():
    txs = [tx_bytes([(sha256d(bytes([i])), i, b"")], [(i, P2PKH)])[0] for i in range(3)]
    doubled = txs + txs[-1:]                              # the same root as the three alone
    assert brute_root([sha256d(x) for x in txs]) == brute_root([sha256d(x) for x in doubled])
    assert bf.parse_block(sealed(1, txs, txs), verify=True)
    with pytest.raises(bf.DamagedBlock, match="ambiguous"):
        bf.parse_block(sealed(1, doubled, doubled), verify=True)


@pytest.mark.parametrize("block", [GENESIS, witness_block(), simple_block(1_400_000_000, 4)])
def test_any_changed_byte_of_a_transaction_is_found(block):
    for at in range(81, len(block)):
        bad = bytearray(block)
        bad[at] ^= 0x01
        with pytest.raises(bf.DamagedBlock):
            bf.parse_block(bytes(bad), verify=True)


def scanned(path, split, verify=True, max_block=1 << 20):
    """(blocks, pieces) of a file by ranges of ``split`` bytes, in this process."""
    blocks, pieces = [], []
    for f in bs.list_files(path):
        file = bs.ByteFile(f.path, f.length)
        for start in range(0, f.length, split):
            for x in bs.Scan(file, MAGIC, verify, max_block).range(start, start + split):
                (pieces if isinstance(x, bs.Piece) else blocks).append(
                    x if isinstance(x, bs.Piece) else (x[0], x[1].block_hash))
        file.close()
    return blocks, pieces


def sequential(data, verify=True, max_block=1 << 20):
    """The plain scan from the first byte on."""
    out, pos = [], 0
    while (pos := data.find(MAGIC, pos)) >= 0:
        size = int.from_bytes(data[pos + 4:pos + 8], "little")
        if 80 <= size <= max_block and pos + 8 + size <= len(data):
            try:
                out.append((size, bf.parse_block(data[pos + 8:pos + 8 + size], verify).block_hash))
                pos += 8 + size
                continue
            except bf.DamagedBlock:
                pass
        pos += 1
    return out


def messy_file(seed):
    """Blocks, fill, junk, cut and changed records, and whole records within scripts."""
    rng = random.Random(seed)
    data = b""
    for i in range(25):
        inner = record(simple_block(1_300_000_000 + 1000 * i, 1)) if rng.random() < 0.4 else b""
        block = simple_block(1_400_000_000 + i, rng.randrange(5), inner * rng.randrange(3))
        kind = rng.random()
        if kind < 0.1:
            at = rng.randrange(81, len(block))
            block = block[:at] + bytes([block[at] ^ 1]) + block[at + 1:]
        r = record(block)
        if 0.1 < kind < 0.2:
            r = r[:rng.randrange(4, len(r))]
        data += r + rng.choice([b"", b"", b"\x00" * rng.randrange(40), rng.randbytes(rng.randrange(30)), MAGIC])
    return data


@pytest.mark.parametrize("seed", range(6))
def test_blocks_do_not_depend_on_the_split(seed):
    d = tempfile.mkdtemp(prefix="utxolens-split-")
    path = os.path.join(d, "a.dat")
    data = messy_file(seed)
    with open(path, "wb") as f:
        f.write(data)
    want = sequential(data)
    assert len(want) >= 10
    for split in (97, 211, 1000, 5000, len(data), 10 * len(data)):
        blocks, pieces = scanned(path, split)
        assert blocks == want, split
        assert sum(s + 8 for s, _ in blocks) + sum(p.length for p in pieces) == len(data), split


def test_ranges_of_a_spark_read(spark):
    d = tempfile.mkdtemp(prefix="utxolens-ranges-")
    for seed in range(3):
        with open(os.path.join(d, f"blk{seed}.dat"), "wb") as f:
            f.write(messy_file(seed))
    path = os.path.join(d, "*.dat")
    kept, lost = None, None
    for split in (700, 4096, 1 << 30, None):               # the last: whole files through Spark's reader
        how = {"whole_files": True} if split is None else {"split_bytes": split}
        df = bf.read_block_files(spark, path, on_damage="skip", verify=True, **how)
        rows = sorted((r.file, r.t, r["size"], r.block_hash, r.n) for r in df.select(
            "file", "t", "size", "block_hash", F.size("transactions").alias("n")).collect())
        gone = sorted(map(tuple, bf.rejected_ranges(spark, path, verify=True, **how).collect()))
        if kept is None:
            kept, lost = rows, gone
            assert df.rdd.getNumPartitions() > 20
        assert rows == kept and gone == lost, split
    assert kept and lost
    # without verification a changed byte that still parses is not seen
    assert bf.read_block_files(spark, path, on_damage="skip").count() >= len(kept)


def test_columns_equal_the_decoded_block(spark):
    d = tempfile.mkdtemp(prefix="utxolens-cols-")
    blocks = [GENESIS, witness_block(), simple_block(1_400_000_000, 4)]
    with open(os.path.join(d, "a.dat"), "wb") as f:
        f.write(b"".join(map(record, blocks)))
    rows = bf.read_block_files(spark, d, verify=True, blocks_per_batch=2).collect()
    got = sorted((r.asDict(recursive=True) for r in rows), key=lambda r: r["t"])
    for raw, r in zip(sorted(blocks, key=lambda b: bf.parse_block(b).t), got):
        want = bf.decode_block(raw)
        for tx in r["transactions"]:
            for x in tx["inputs"] + tx["outputs"]:
                x["script"] = bytes(x["script"])
        assert {k: r[k] for k in want} == want and r["size"] == len(raw)


def test_sparse_file_past_two_gib_in_bounded_tasks(spark):
    d = tempfile.mkdtemp(prefix="utxolens-huge-")
    path = os.path.join(d, "huge.dat")
    one, two = record(simple_block(1_400_000_000, 2)), record(simple_block(1_400_000_001, 2))
    size = (2 << 30) + 12_345_678
    with open(path, "wb") as f:                           # zero fill takes no disk
        f.write(one)
        f.truncate(size - len(two))
        f.seek(size - len(two))
        f.write(two)
    df = bf.read_block_files(spark, path, verify=True)
    assert df.rdd.getNumPartitions() >= 33
    assert sorted(r.t for r in df.select("t").collect()) == [1_400_000_000, 1_400_000_001]
    assert bf.rejected_ranges(spark, path, verify=True).count() == 0


def test_one_changed_byte_is_a_rejected_range(spark):
    d = tempfile.mkdtemp(prefix="utxolens-byte-")
    blocks = [simple_block(1_400_000_000 + i, 2) for i in range(3)]
    bad = bytearray(blocks[1])
    bad[-10] ^= 1
    with open(os.path.join(d, "a.dat"), "wb") as f:
        f.write(record(blocks[0]) + record(bytes(bad)) + record(blocks[2]))
    lost = bf.rejected_ranges(spark, d, verify=True).collect()
    assert [(r.offset, r.length) for r in lost] == [(len(blocks[0]) + 8, len(bad) + 8)]
    assert "merkle root" in lost[0].reason
    kept = bf.read_block_files(spark, d, verify=True, on_damage="skip").collect()
    assert sorted(r.t for r in kept) == [1_400_000_000, 1_400_000_002]
    with pytest.raises(Exception, match="merkle root"):
        bf.read_block_files(spark, d, verify=True).collect()


def test_sql_and_options(spark):
    d = tempfile.mkdtemp(prefix="utxolens-sqlscan-")
    with open(os.path.join(d, "a.dat"), "wb") as f:
        f.write(record(simple_block(1_400_000_000, 2)))
    spark.dataSource.register(bs.BlockFileSource)
    assert spark.read.format("blockfile").load(d).count() == 1
    with pytest.raises(Exception, match="onDamage"):
        spark.read.format("blockfile").option("onDamage", "ignore").load(d).count()
    empty = tempfile.mkdtemp(prefix="utxolens-none-")
    assert spark.read.format("blockfile").load(empty).count() == 0


def small_chain(n, seed=3):
    """Blocks that follow each other: plain ones, with witness data, with long
    counts and scripts, of equal transactions, and damaged ones."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        txs = [{"tx_hash": "", "inputs": [{"prev_hash": rnd.randbytes(32).hex(), "prev_idx": rnd.randrange(1 << 32),
                                            "script": rnd.randbytes(rnd.choice([0, 1, 40, 252]))}
                                           for _ in range(rnd.randrange(4))],
                "outputs": [{"value": rnd.randrange(-5, 1 << 60), "script": rnd.choice([None, MAGIC, rnd.randbytes(30)])}
                            for _ in range(rnd.randrange(4))]} for _ in range(rnd.randrange(5))]
        if i % 29 == 7:
            txs += [{"tx_hash": "", "inputs": [], "outputs": [{"value": 1, "script": bytes(600)}] * 260}]
        raw = blockwrite.block_record(i - 4, txs)
        if i % 31 == 11:
            raw = MAGIC + struct.pack("<I", len(witness_block(n=2))) + witness_block(n=2)
        if i % 43 == 20:
            bad = bytearray(raw)
            bad[rnd.randrange(8, len(bad))] ^= 1 + rnd.randrange(255)
            raw = bytes(bad)
        out.append(raw if i % 97 != 50 else raw[:-1])
    return b"".join(out)


@pytest.mark.parametrize("verify", [False, True])
@pytest.mark.parametrize("rows", ["blocks", "rejected"])
def test_blocks_decoded_together_equal_single_ones(tmp_path, monkeypatch, verify, rows):
    path, data = tmp_path / "a.dat", small_chain(700)
    path.write_bytes(data)
    own = bs.BlockFileReader({"path": str(path), "verify": str(verify), "onDamage": "skip", "rows": rows,
                              "maxBlock": str(1 << 18)})

    def read():
        spans = [(i, min(i + 50_000, len(data))) for i in range(0, len(data), 50_000)]
        found = [b for a, e in spans for b in own.read(bs.Ranges([(str(path), a, e, len(data))]))]
        assert all(b.num_rows <= bs.RUN or not bs.RUN for b in found)
        return [r for b in found for r in b.to_pylist()]

    got = read()
    monkeypatch.setattr(bs, "RUN", 0)
    assert got == read() and got


def test_small_blocks_take_no_parse_each(tmp_path, monkeypatch):
    path = tmp_path / "a.dat"
    path.write_bytes(b"".join(blockwrite.block_record(i, [{"inputs": [], "outputs": [{"value": i, "script": b"x"}]}])
                              for i in range(3000)))
    parsed, parse = [], bs.parse_block
    monkeypatch.setattr(bs, "parse_block", lambda *a: parsed.append(1) or parse(*a))
    own = bs.BlockFileReader({"path": str(path), "verify": "true"})
    assert sum(b.num_rows for p in own.partitions() for b in own.read(p)) == 3000
    assert len(parsed) < 300


def test_records_of_a_batch_equal_single_ones():
    t = [5, -1, 7, 8]
    one = {"prev_hash": "ab" * 32, "prev_idx": 1 << 31, "script": None}
    rows = [[], [{"inputs": None, "outputs": []}, {"inputs": [one, one | {"prev_hash": "text"}], "outputs": []}],
            [{"inputs": [one | {"script": bytes(300)}], "outputs": [{"value": -3, "script": bytes(70_000)}]}],
            [{"inputs": [], "outputs": [{"value": i, "script": None} for i in range(300)]}] * 2]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(t, pa.int32()), "transactions": pa.array(
        rows, pa.list_(pa.struct([("inputs", pa.list_(bf._INPUTS)), ("outputs", pa.list_(bf._OUTPUTS))])))})
    want = [blockwrite.block_record(x, y) for x, y in zip(t, rows)]
    assert list(blockwrite.block_records(batch)) == want
    assert list(blockwrite.block_records(batch.slice(1, 2))) == want[1:3]
