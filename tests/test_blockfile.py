"""Raw block-file decoding: a test-side serialiser, round trips, damage."""

import hashlib
import os
import struct
import tempfile

import pytest

from pyspark.sql import functions as F

from utxolens.operators import blocks as B
from utxolens.operators import utxo
from utxolens.plans.jobs import run_job
from utxolens.sources import blockfile as bf

MAGIC = bf.MAINNET_MAGIC


def varint(n: int) -> bytes:
    if n < 0xFD:
        return bytes([n])
    if n <= 0xFFFF:
        return b"\xfd" + n.to_bytes(2, "little")
    return b"\xfe" + n.to_bytes(4, "little")


def tx_bytes(inputs, outputs, witness=False):
    body = varint(len(inputs))
    for prev, idx, script in inputs:
        body += prev + struct.pack("<I", idx) + varint(len(script)) + script + b"\xff" * 4
    body += varint(len(outputs))
    for value, script in outputs:
        body += struct.pack("<q", value) + varint(len(script)) + script
    ver, lock = struct.pack("<i", 2), b"\x00" * 4
    plain = ver + body + lock
    if not witness:
        return plain, plain
    wit = b"".join(varint(1) + varint(3) + b"abc" for _ in inputs)
    return ver + b"\x00\x01" + body + wit + lock, plain


def block_bytes(t: int, txs, prev=b"\x00" * 32):
    header = struct.pack("<i", 1) + prev + b"\x11" * 32 + struct.pack("<III", t, 0x1D00FFFF, 7)
    return header, header + varint(len(txs)) + b"".join(txs)


def record(block: bytes) -> bytes:
    return MAGIC + struct.pack("<I", len(block)) + block


def sha256d(b):
    return hashlib.sha256(hashlib.sha256(b).digest()).digest()


def test_genesis_header_hash():
    header = bytes.fromhex(
        "01000000" + "00" * 32
        + "3ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a"
        + "29ab5f49" + "ffff001d" + "1dac2b7c")
    blk = bf.decode_block(header + b"\x00")
    assert blk["block_hash"] == "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"
    assert blk["t"] == 1231006505


def _write_chain(path):
    p2pkh = bytes.fromhex("76a914" + "62e907b15cbf27d5425399ebf6f0fb50ebb88f18" + "88ac")
    cb_raw, cb_plain = tx_bytes([(b"\x00" * 32, 0xFFFFFFFF, b"\x01\x02")], [(5000, p2pkh)])
    cb_hash = sha256d(cb_plain)
    sw_raw, sw_plain = tx_bytes([(cb_hash, 0, b"")], [(3000, p2pkh), (1999, b"\x6a\x01\x00")],
                                witness=True)
    _h1, b1 = block_bytes(1231006505, [cb_raw])
    _h2, b2 = block_bytes(1231007000, [sw_raw])
    with open(path, "wb") as f:
        f.write(record(b1) + b"\x00" * 7 + record(b2) + b"\x00" * 9)
    return cb_hash[::-1].hex(), sha256d(sw_plain)[::-1].hex()


def test_decode_round_trip_and_unspent(spark):
    d = tempfile.mkdtemp(prefix="utxolens-blk-")
    cb, sw = _write_chain(os.path.join(d, "blk00000.dat"))
    blocks = bf.read_block_files(spark, os.path.join(d, "*.dat"))
    rows = blocks.orderBy("t").collect()
    assert [r.t for r in rows] == [1231006505, 1231007000]
    assert rows[0].transactions[0].tx_hash == cb
    assert rows[1].transactions[0].tx_hash == sw          # witness excluded from the id
    assert rows[1].transactions[0].inputs[0].prev_hash == cb
    vals = B.block_values_nested(blocks).collect()
    assert [(v.value, v.no) for v in vals] == [(5000, 1), (4999, 1)]
    assert vals[0].time == "2009-01-03 18::15"
    el = B.elements_from_blocks(blocks)
    unspent = sorted((r.tx_hash, r.idx, r.amount) for r in utxo.unspent_outputs(el).collect())
    assert unspent == sorted([(sw, 0, 3000), (sw, 1, 1999)])
    outs = B.flatten_outputs_nested(blocks).count()
    assert outs == 3
    txi = {r.rowkey: (r.inputNo, r.outputNo) for r in B.tx_index_from_blocks(blocks).collect()}
    assert txi == {cb: (1, 1), sw: (1, 2)}
    bi = bf.block_file_index(blocks).orderBy("transactionDate").collect()
    assert [r.transactionCounter for r in bi] == [1, 1] and bi[0].file.endswith("blk00000.dat")
    compact = sorted((r.tx_hash, r.idx, r.amount)
                     for r in utxo.unspent_outputs(el, compact_keys=True).collect())
    assert compact == unspent
    assert ([tuple(r) for r in utxo.top_unspent(el, 5, compact_keys=True).collect()]
            == [tuple(r) for r in utxo.top_unspent(el, 5).collect()])
    states = {(r.tx_hash, r.idx): r.state for r in utxo.outpoint_state(el, True).collect()}
    assert states[(cb, 0)] == 2 and states[(sw, 0)] == 1


def test_jobs_write_csv(spark):
    d = tempfile.mkdtemp(prefix="utxolens-job-")
    _write_chain(os.path.join(d, "blk00000.dat"))
    out = os.path.join(d, "out")
    run_job(spark, "amounts", os.path.join(d, "*.dat"), out)
    parts = [p for p in os.listdir(out) if p.startswith("part-")]
    assert len(parts) == 1
    lines = open(os.path.join(out, parts[0])).read().strip().splitlines()
    assert len(lines) == 2 and lines[0].split(",")[-1] == "3000"
    run_job(spark, "transaction_amount", os.path.join(d, "*.dat"), os.path.join(d, "tv"))
    idx_out = os.path.join(d, "bi")
    bf.block_file_index(bf.read_block_files(spark, os.path.join(d, "*.dat"))) \
        .write.parquet(idx_out)
    run_job(spark, "block_count", idx_out, os.path.join(d, "bc"))
    got = spark.read.csv(os.path.join(d, "bc")).collect()
    assert [tuple(r) for r in got] == [("result", "2")]
    run_job(spark, "block_with_few_transactions", idx_out, os.path.join(d, "few"))
    assert spark.read.csv(os.path.join(d, "few")).select(F.col("_c1")).count() == 2


def test_streaming_ingest(spark):
    from utxolens.streaming.ingest import ingest_block_files

    d = tempfile.mkdtemp(prefix="utxolens-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    cb, sw = _write_chain(os.path.join(src, "blk00000.dat"))
    table = os.path.join(d, "table")
    def ingest():
        ingest_block_files(spark, src, table, os.path.join(d, "checkpoint"),
                           name=os.path.basename(d)).awaitTermination(120)
        return sorted(r.t for r in spark.read.parquet(table).collect())

    assert ingest() == [1231006505, 1231007000]
    _write_chain(os.path.join(src, "blk00001.dat"))
    assert ingest() == [1231006505] * 2 + [1231007000] * 2      # restarted: the new file only


def test_damage_is_never_silent(spark):
    d = tempfile.mkdtemp(prefix="utxolens-bad-")
    whole = os.path.join(d, "whole.dat")
    _write_chain(whole)
    data = open(whole, "rb").read().rstrip(b"\x00")
    cb_raw, _ = tx_bytes([(b"\x00" * 32, 0xFFFFFFFF, b"\x01")], [(1, b"\x51")])
    _, block = block_bytes(1231006505, [cb_raw])
    cases = {"cut": data[:-3], "after": record(block + b"x" * 50), "text": b"junk" + data,
             "magic": data + MAGIC + b"\xff\xff\x00\x00" + b"junk", "short": record(b"x" * 10) + data}
    for name, raw in cases.items():
        path = os.path.join(d, f"{name}.dat")
        with open(path, "wb") as f:
            f.write(raw)
        with pytest.raises(Exception, match="bytes at"):
            bf.read_block_files(spark, path).collect()
        blocks = bf.read_block_files(spark, path, on_damage="skip").collect()
        lost = bf.rejected_ranges(spark, path).collect()
        # every byte is in a block, its record head, or a rejected range (or zero fill)
        fill = 7 if data[:20] in raw or name == "cut" else 0
        assert sum(b["size"] + 8 for b in blocks) + sum(r.length for r in lost) + fill >= len(raw.rstrip(b"\x00")), name
        assert lost, name
    assert bf.rejected_ranges(spark, whole).count() == 0


def test_decode_to_parquet_by_month(spark):
    d = tempfile.mkdtemp(prefix="utxolens-dec-")
    _write_chain(os.path.join(d, "blk00000.dat"))
    out = os.path.join(d, "blocks")
    bf.decode_to_parquet(spark, os.path.join(d, "*.dat"), out)
    assert "month=2009-01" in os.listdir(out)
    got = spark.read.parquet(out).where(F.col("month") == "2009-01")
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "(month#" in plan


def test_single_csv_sink_hex_and_order(spark):
    from utxolens.sources import sinks

    d = tempfile.mkdtemp(prefix="utxolens-sink-")
    df = spark.createDataFrame([(i, bytes([i, 255])) for i in range(50)], "n int, b binary")
    sinks.write_single_csv(df.orderBy(F.col("n").desc()).repartition(4).orderBy(F.col("n").desc()),
                           os.path.join(d, "o"))
    parts = [p for p in os.listdir(os.path.join(d, "o")) if p.startswith("part-")]
    assert len(parts) == 1
    lines = open(os.path.join(d, "o", parts[0])).read().split()
    assert lines[0] == "49,31ff" and lines[-1] == "0,00ff" and len(lines) == 50


def test_every_job_runs(spark):
    from utxolens.plans.jobs import JOBS

    d = tempfile.mkdtemp(prefix="utxolens-alljobs-")
    _write_chain(os.path.join(d, "blk00000.dat"))
    files = os.path.join(d, "*.dat")
    blocks = bf.read_block_files(spark, files)
    bf.block_file_index(blocks).write.parquet(os.path.join(d, "bi"))
    B.tx_index_from_blocks(blocks).write.parquet(os.path.join(d, "ti"))
    table_input = {"block_count": "bi", "block_with_few_transactions": "bi",
                   "transaction_count": "ti"}
    for name in JOBS:
        inp = os.path.join(d, table_input[name]) if name in table_input else files
        out = run_job(spark, name, inp, os.path.join(d, "out-" + name))
        assert any(p.startswith("part-") for p in os.listdir(out)), name
    got = spark.read.csv(os.path.join(d, "out-transaction_count")).collect()
    assert [tuple(r) for r in got] == [("result", "2")]
    addr = spark.read.csv(os.path.join(d, "out-addresses")).collect()
    assert {r._c0 for r in addr} == {"1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"}


def test_header_time_past_2038_does_not_fail():
    header = struct.pack("<i", 1) + b"\x00" * 64 + struct.pack("<III", 3_000_000_000, 0, 0)
    blk = bf.decode_block(header + b"\x00")
    assert blk["t"] == 3_000_000_000 - 2 ** 32


def test_sql_over_decoded_views(spark):
    from utxolens.sources.tables import register_decoded_views

    d = tempfile.mkdtemp(prefix="utxolens-views-")
    _write_chain(os.path.join(d, "blk00000.dat"))
    out = os.path.join(d, "blocks")
    bf.decode_to_parquet(spark, os.path.join(d, "*.dat"), out)
    v = register_decoded_views(spark, out, prefix="dv_")
    per_year = spark.sql(f"SELECT YEAR(ts) AS y, COUNT(1) AS n FROM {v['blocks']} GROUP BY YEAR(ts)")
    assert [tuple(r) for r in per_year.collect()] == [(2009, 2)]
    few = spark.sql(f"""SELECT YEAR(ts), MONTH(ts), COUNT(1) FROM
                        (SELECT * FROM {v['blocks']} WHERE transactionCounter < 10)
                        GROUP BY YEAR(ts), MONTH(ts) ORDER BY YEAR(ts), MONTH(ts)""").collect()
    assert [tuple(r) for r in few] == [(2009, 1, 2)]
    n_el = spark.sql(f"SELECT type, count(*) FROM {v['elements']} GROUP BY type ORDER BY type")
    assert [tuple(r) for r in n_el.collect()] == [(0, 2), (1, 3)]
    assert spark.sql(f"SELECT count(*) FROM {v['tx_index']}").first()[0] == 2


def test_decoder_batches_across_files(spark):
    d = tempfile.mkdtemp(prefix="utxolens-multi-")
    p2pkh = bytes.fromhex("76a914" + "11" * 20 + "88ac")
    want = []
    for f in range(3):
        data = b""
        for b in range(5):
            t = 1_300_000_000 + 1000 * (5 * f + b)
            raw, _plain = tx_bytes([(b"\x00" * 32, 0xFFFFFFFF, bytes([f, b]))], [(f * 10 + b, p2pkh)])
            _h, blk = block_bytes(t, [raw])
            data += record(blk)
            want.append((t, f * 10 + b))
        with open(os.path.join(d, f"blk{f:05d}.dat"), "wb") as fh:
            fh.write(data)
    blocks = bf.read_block_files(spark, os.path.join(d, "*.dat"), blocks_per_batch=2)
    got = sorted((r.t, r.transactions[0].outputs[0].value) for r in blocks.collect())
    assert got == sorted(want)
    assert blocks.select("file").distinct().count() == 3
