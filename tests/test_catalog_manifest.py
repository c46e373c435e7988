"""Catalog cells, the decode manifest, table functions and the SQL surface."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_blockscan import record, simple_block
from utxolens.functions import scripts as S
from utxolens.functions.sql import register_functions
from utxolens.operators import scriptstats
from utxolens.plans.jobs import run_job
from utxolens.sources import cells as C
from utxolens.sources import fixtures as fx
from utxolens.sources.blockwrite import write_block_files
from utxolens.sources.blockfile import read_block_files
from utxolens.sources.manifest import DecodeStore

CELLS = "key binary, family string, qualifier string, value binary, version bigint"
CATALOG = """{"table": {"namespace": "d", "name": "x"}, "rowkey": "key", "columns": {
  "k": {"cf": "rowkey", "col": "key", "type": "string"}, "b": {"cf": "f", "col": "b", "type": "byte"},
  "s": {"cf": "f", "col": "s", "type": "short"}, "i": {"cf": "f", "col": "i", "type": "int"},
  "l": {"cf": "f", "col": "l", "type": "long"}, "d": {"cf": "g", "col": "d", "type": "double"},
  "r": {"cf": "g", "col": "r", "type": "float"}, "o": {"cf": "g", "col": "o", "type": "boolean"},
  "t": {"cf": "g", "col": "t", "type": "string"}, "x": {"cf": "g", "col": "x", "type": "binary"}}}"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cell_types_missing_cells_and_versions(spark):
    import struct

    def cell(k, f, q, v, n=1):
        return (k, f, q, v, n)

    data = [cell(b"a", "f", "b", b"\xff"), cell(b"a", "f", "s", b"\x80\x00"), cell(b"a", "f", "i", b"\xff\xff\xff\xfe"),
            cell(b"a", "f", "l", b"\x7f" + b"\xff" * 7), cell(b"a", "g", "d", struct.pack(">d", -1.5e300)),
            cell(b"a", "g", "r", struct.pack(">f", 0.25)), cell(b"a", "g", "o", b"\xff"),
            cell(b"a", "g", "t", "é".encode()), cell(b"a", "g", "x", b"\x00\x01"),
            cell(b"b", "f", "l", b"\x80" + b"\x00" * 7), cell(b"b", "g", "o", b"\x00"),
            cell(b"b", "f", "i", b"\x00\x00\x00\x05", 3), cell(b"b", "f", "i", b"\x00\x00\x00\x09", 2),
            cell(b"c", "f", "i", b"\x01"),                             # too short for an int
            cell(b"d", "other", "z", b"zz"), cell(b"e", "f", "unknown", b"zz")]
    df = spark.createDataFrame(data, CELLS)
    got = {r.k: r for r in C.read_cells(df, CATALOG).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    a = got["a"]
    assert (a.b, a.s, a.i, a.l, a.d, a.r, a.o, a.t, bytes(a.x)) == (
        -1, -32768, -2, 2 ** 63 - 1, -1.5e300, 0.25, True, "é", b"\x00\x01")
    assert (got["b"].l, got["b"].o, got["b"].i, got["b"].t) == (-2 ** 63, False, 5, None)
    assert got["c"].i is None and got["d"].i is None and got["e"].l is None
    assert {r.k for r in C.read_cells(df, CATALOG, start=b"b", stop=b"d").collect()} == {"b", "c"}
    assert C.read_cells(df.limit(0), CATALOG).count() == 0


def test_catalog_errors_are_named():
    for text, words in (('{"columns": {"a": {"cf": "x", "col": "y", "type": "int"}}}', "row key"),
                        ('{"columns": {"a": {"cf": "rowkey", "col": "key", "type": "uuid"}}}', "unknown type"),
                        ('{"columns": {"a": {"cf": "rowkey", "col": "key"}}}', "no type"),
                        ('{"columns": {"k": {"cf": "rowkey", "col": "key", "type": "string"}, "a": {"cf": "x",'
                         '"col": "y", "type": "int"}, "b": {"cf": "x", "col": "y", "type": "int"}}}', "same cell")):
        with pytest.raises(ValueError, match=words):
            C.Catalog.parse(text)


def test_key_range_and_columns_reach_the_scan(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="utxolens-cells-"), "cells")
    C.to_cells(fx.block_index(spark, SF_SMALL), C.BLOCK_CATALOG).write.parquet(path)
    stored = spark.read.parquet(path)
    df = C.read_cells(stored, C.BLOCK_CATALOG, start=b"1995-01-01", stop=b"1996-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert rows(df) == rows(fx.block_index(spark, SF_SMALL).where("rowkey >= '1995-01-01' and rowkey < '1996-01-01'"))
    assert rows(C.read_cells(stored, C.BLOCK_CATALOG)) == rows(fx.block_index(spark, SF_SMALL))


def _chain(folder, name, times, n=2):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"".join(record(simple_block(t, n)) for t in times))


def test_second_job_runs_no_decoder(spark, monkeypatch):
    from utxolens.sources import manifest

    d = tempfile.mkdtemp(prefix="utxolens-manifest-")
    src = os.path.join(d, "in")
    _chain(src, "blk0.dat", [1_400_000_000, 1_400_000_001])
    _chain(src, "blk1.dat", [1_400_000_002])
    decoded = []
    real = manifest.read_block_files
    monkeypatch.setattr(manifest, "read_block_files",
                        lambda spark, path, *a, **k: decoded.append(path.split("\n")) or real(spark, path, *a, **k))
    store = DecodeStore(spark, os.path.join(d, "store"), keep=0)
    first = store.blocks(src)
    assert sorted(r.t for r in first.collect()) == [1_400_000_000, 1_400_000_001, 1_400_000_002]
    again = DecodeStore(spark, os.path.join(d, "store"), keep=0).blocks(os.path.join(src, "*.dat"))
    assert rows(again) == rows(first) and len(decoded) == 1
    assert "blockfile" not in again._jdf.queryExecution().optimizedPlan().toString().lower()
    _chain(src, "blk2.dat", [1_400_000_003])                          # a grown folder
    assert store.blocks(src).count() == 4
    assert [len(x) for x in decoded] == [2, 1] and decoded[1][0].endswith("blk2.dat")
    assert store.blocks(os.path.join(src, "blk1.dat")).count() == 1 and len(decoded) == 2
    time.sleep(0.02)
    _chain(src, "blk0.dat", [1_400_000_000, 1_400_000_001, 1_400_000_009])    # a grown file
    old = [e for e in store.entries() if e.path.endswith("blk0.dat")][0]
    assert sorted(r.t for r in store.blocks(src).collect())[-1] == 1_400_000_009
    assert store.blocks(src).count() == 5 and [len(x) for x in decoded] == [2, 1, 1]
    assert not os.path.exists(store._folder(old))                     # the former decode is gone
    assert store.blocks(src, verify=True).count() == 5 and len(decoded) == 4      # other checks, other decode
    store.forget(src)
    assert store.entries() == [] and store.blocks(src).count() == 5 and len(decoded) == 5
    empty = os.path.join(d, "none")
    _chain(empty, "blk0.dat", [])
    assert store.blocks(empty).count() == 0


def test_a_failed_decode_is_never_read(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="utxolens-fail-")
    src = os.path.join(d, "in")
    _chain(src, "a.dat", [1_400_000_000])
    with open(os.path.join(src, "b.dat"), "wb") as f:
        f.write(b"junk")
    store = DecodeStore(spark, os.path.join(d, "store"))
    with pytest.raises(Exception, match="no record magic"):
        store.blocks(src)
    assert store.entries() == []
    os.replace(os.path.join(src, "b.dat"), os.path.join(d, "elsewhere"))
    assert store.blocks(src).count() == 1


def test_jobs_share_a_decode(spark):
    d = tempfile.mkdtemp(prefix="utxolens-jobs-")
    src = os.path.join(d, "in")
    _chain(src, "a.dat", [1_400_000_000, 1_400_000_001])
    for name in ("amounts", "transaction_amount", "addresses"):
        run_job(spark, name, src, os.path.join(d, name))
    own = [e for e in DecodeStore(spark).entries() if d in e.path]
    assert len(own) == 1


def test_written_blocks_read_back(spark):
    d = tempfile.mkdtemp(prefix="utxolens-write-")
    nested = fx.nested_fragments(spark, SF_SMALL).limit(500).repartition(3)
    folder = write_block_files(nested, os.path.join(d, "out"))
    got = read_block_files(spark, folder, verify=True, split_bytes=10_000)

    def shape(df):
        return sorted((r.t, [[(o.value, bytes(o.script)) for o in tx.outputs] for tx in r.transactions])
                      for r in df.collect())
    assert shape(got) == shape(nested)


def test_sql_script_functions(spark):
    assert {"script_type", "script_structure", "script_cltv", "script_chunks_of"} <= set(register_functions(spark))
    key = b"\x21\x02" + b"k" * 32
    big = b"\x4d\x00\x01" + b"q" * 256
    scripts = [None, b"", b"\x00", b"\x4c", b"\x03abc", b"\x6a\x01", key + b"\xac", key + key, big + b"\xac",
               b"\x4c\x02ab\xac", b"\x4e\x02\x00\x00\x00ab\xac", b"\x01a\xac",
               b"\x76\xa9\x14" + b"h" * 20 + b"\x88\xac", b"\x76\xa9\x4c\x14" + b"h" * 20 + b"\x88\xac",
               b"\xa9\x14" + b"h" * 20 + b"\x87", b"\x51" + key + key + b"\x52\xae", b"\x52" + key + key + b"\x52\xae",
               b"\x00\x14" + b"h" * 20, b"\x51\x20" + b"h" * 32, b"\x51\xac\x69", b"\x76\xa9\x4c",
               b"\x63" + key + b"\xad\x67\x03\x40\x42\x8f\xb1\x75\x68" + key + b"\xac"]
    df = spark.createDataFrame(list(enumerate(scripts)), "n int, s binary")
    df.createOrReplaceTempView("sqlscripts")
    got = {r.n: r for r in spark.sql("""
        SELECT n, script_structure(s) AS st, script_type(s) AS ty, script_is_multisig(s) AS m, script_is_cltv(s) AS c,
               script_is_op_return(s) AS o, script_pubkey(s) AS p, cltv_expiry(s) AS e, cltv_sender(s) AS se,
               script_nonminimal(s) AS nm FROM sqlscripts""").collect()}
    from utxolens.functions.address import script_type
    types = {r.n: r.t for r in df.select("n", script_type(F.col("s")).alias("t")).collect()}
    ch = {r.n: r for r in df.select("n", S.chunks_of(S.parsed_script(F.col("s"))).alias("ch")).select(
        "n", S.cltv_expiry(F.col("ch")).alias("e"), S.cltv_sender_hex(F.col("ch")).alias("se"),
        S.pubkey_hex(F.col("ch")).alias("p"), S.is_multisig(F.col("ch")).alias("m")).collect()}
    for n, s in enumerate(scripts):
        r = got[n]
        assert r.st == S.structure(s), s
        assert r.ty == types[n], s
        assert (r.e, r.se, r.p, r.m) == (ch[n].e, ch[n].se, ch[n].p, ch[n].m), s
    assert got[len(scripts) - 1].c and got[len(scripts) - 1].e == -(0x0F4240)
    assert got[5].o and not got[4].o


def test_table_function_equals_the_operator(spark):
    register_functions(spark)
    el = fx.elements(spark, SF_SMALL)
    el.createOrReplaceTempView("tf_elements")
    got = spark.sql("""SELECT e.type, e.tx_hash, e.idx, c.* FROM tf_elements e, LATERAL script_chunks_of(e.script) c
                       WHERE e.type = 0""")
    assert rows(got) == rows(scriptstats.script_chunks(el).where("type = 0"))
    assert spark.sql("SELECT * FROM script_chunks_of(X'4c')").count() == 0
    assert spark.sql("SELECT * FROM script_chunks_of(NULL)").count() == 0
