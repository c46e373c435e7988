
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utxolens.functions import address as A
from utxolens.functions import encoding as enc
from utxolens.functions import scripts as S
from utxolens.functions import timefmt
from utxolens.functions.validate import b58encode, decode_checked, ripemd160, ripemd160_py
from utxolens.operators import modes, utxo

GENESIS_HASH160 = "62e907b15cbf27d5425399ebf6f0fb50ebb88f18"


def _one(spark, col, value, dtype):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", dtype)]))
    return df.select(col(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("script_hex,address", [
    ("76a914" + GENESIS_HASH160 + "88ac", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    ("76a914" + "00" * 20 + "88ac", "1111111111111111111114oLvT2"),
    ("76a914751e76e8199196d454941c45d1b3a323f1433bd688ac", "1BgGZ9tcN4rm9KBzDn7KprQz87SZ26SAMH"),
    ("76a94c14" + GENESIS_HASH160 + "88ac", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    ("76a97688ac", None), ("51", None), ("", None), ("4c", None), (None, None),
])
def test_address_vectors(spark, script_hex, address):
    b = None if script_hex is None else bytes.fromhex(script_hex)
    assert _one(spark, A.address_col, b, T.BinaryType()) == address


def test_p2sh_address_uses_version_zero(spark):
    b = bytes.fromhex("a914" + GENESIS_HASH160 + "87")
    assert _one(spark, A.address_col, b, T.BinaryType()) == "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
    v5 = _one(spark, lambda c: A.address_col(c, p2sh_version=5), b, T.BinaryType())
    assert v5.startswith("3")


@pytest.mark.parametrize("script_hex,structure", [
    ("acac", "CHECKSIG"), ("acacac87", "CHECKSIG[3] EQUAL"), ("ba", "NON_OP(186)"),
    ("05aa", "ERROR"), ("4c", "ERROR"), (None, "ERROR"), ("", ""),
    ("76a914" + "11" * 20 + "88ac", "DUP[1] HASH160[1] EQUALVERIFY[1] CHECKSIG"),
    ("a914" + "11" * 20 + "87", "HASH160[1] EQUAL"),
    ("21" + "02" * 33 + "ac", "CHECKSIG"),
    ("5121" + "02" * 33 + "21" + "03" * 33 + "52ae", "1[1] 2[1] CHECKMULTISIG"),
    ("5221" + "02" * 33 + "21" + "03" * 33 + "52ae", "2[2] CHECKMULTISIG"),
    ("6a04deadbeef", "RETURN"), ("0102", ""), ("6a", "RETURN"),
])
def test_structure_vectors(spark, script_hex, structure):
    b = None if script_hex is None else bytes.fromhex(script_hex)
    assert S.structure(b) == structure
    assert _one(spark, S.script_structure, b, T.BinaryType()) == structure


@pytest.mark.parametrize("script_hex,stype", [
    ("76a914" + "11" * 20 + "88ac", "P2PKH"), ("76a94c14" + "11" * 20 + "88ac", "P2PKH"),
    ("76a94d1400" + "11" * 20 + "88ac", "P2PKH"), ("21" + "02" * 33 + "ac", "PUB_KEY"),
    ("4c21" + "02" * 33 + "ac", "PUB_KEY"), ("01ffac", "NO_TYPE"),
    ("a914" + "11" * 20 + "87", "P2SH"), ("6a04deadbeef", "NO_TYPE"), ("", "NO_TYPE"),
])
def test_script_type_vectors(spark, script_hex, stype):
    assert _one(spark, A.script_type, bytes.fromhex(script_hex), T.BinaryType()) == stype


def test_block_time_formats(spark):
    assert _one(spark, timefmt.block_time_text, 1231006505, T.IntegerType()) == "2009-01-03 18::15"
    assert _one(spark, timefmt.iso_time_text, 1231006505, T.IntegerType()) == "2009-01-03T18:15:05Z"


def test_reverse_and_double_sha(spark):
    assert _one(spark, enc.reverse_bytes_hex, "0a0b0c", T.StringType()) == "0c0b0a"
    import hashlib
    want = hashlib.sha256(hashlib.sha256(b"abc").digest()).hexdigest()
    assert _one(spark, enc.double_sha256_hex, b"abc", T.BinaryType()) == want


def test_base58_of_any_length(spark):
    import random
    rnd = random.Random(7)
    vals = ["00" * rnd.randint(0, 3) + bytes(rnd.getrandbits(8) for _ in range(n)).hex()
            for n in [*range(101), *range(101), 300]] + ["", "00", "0000ff", None, "ff" * 100]
    df = spark.createDataFrame([(v,) for v in vals], "h string").coalesce(1)
    rows = df.select("h", enc.base58_hex(F.col("h")).alias("b")).collect()
    assert len(rows) == len(vals)
    for r in rows:
        assert r["b"] == (None if r["h"] is None else b58encode(bytes.fromhex(r["h"]))), r


def test_base58_of_odd_and_illegal_hex(spark):
    texts = ["f", "00f", "A", "0", "", None, "zz", "a b", "6162\u00e9"]
    rows = spark.createDataFrame([(t,) for t in texts], "h string").select(
        "h", enc.base58_hex(F.col("h")).alias("b")).collect()
    want = {"f": "G", "00f": "1G", "A": "B", "0": "1", "": ""}
    for r in rows:
        assert r.b == want.get(r.h), r.h


def test_decode_checked():
    assert decode_checked("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") == (True, 0, GENESIS_HASH160)
    assert decode_checked("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb")[0] is False
    assert decode_checked("0OIl")[0] is False
    assert decode_checked("1")[0] is False


def test_decode_checked_batches():
    from utxolens.functions.validate import b58decode_batch, decode_checked_batch

    assert decode_checked("3QJmnh") == (True, None, "")          # a checksum over nothing
    assert decode_checked("") == (False, None, None)
    values = [bytes(z) + bytes((7 * i + 1) % 256 for i in range(k)) for z in (0, 1, 5)
              for k in (0, 1, 2, 3, 20, 25, 33, 64, 200)]
    texts = [b58encode(v) for v in values]
    assert b58decode_batch(texts + [None, "1l1", "é", "1é1"]) == values + [None] * 4
    assert decode_checked_batch([None, "0"]) == [None, (False, None, None)]


def test_ripemd160_in_batches():
    from utxolens.functions.validate import ripemd160_arrays

    assert ripemd160_arrays([]) == []
    mixed = [b"abc", b"", b"a" * 200, b"b" * 55, b"c" * 56, b"abc"]
    assert ripemd160_arrays(mixed) == [ripemd160_arrays([m])[0] for m in mixed]
    assert ripemd160_arrays([b"abc"])[0].hex() == "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc"


def test_ripemd160_pure_python_matches():
    for msg in [b"", b"abc", b"message digest", bytes(range(200))]:
        assert ripemd160_py(msg) == ripemd160(msg)
    assert ripemd160_py(b"").hex() == "9c1185a5c5e9fc54612808977ee8f548b2258d31"


def test_unspent_rule(spark):
    rows = [(1, "a", 0), (0, "a", 0), (1, "b", 0), (1, "d", 0), (1, "d", 0), (0, "q", 0)]
    df = spark.createDataFrame([(t, "blk", 0, h, i, 10, b"") for t, h, i in rows],
                               "type int, block_hash string, tx_idx int, tx_hash string, "
                               "idx bigint, amount bigint, script binary")
    got = [(r.tx_hash, r.idx) for r in utxo.unspent_outputs(df).collect()]
    assert got == [("b", 0)]
    states = {(r.tx_hash): r.state for r in utxo.outpoint_state(df).collect()}
    assert states == {"a": 2, "b": 1, "d": 2, "q": 0}


def test_mode_max(spark):
    df = spark.createDataFrame([("g", v) for v in [1, 1, 3, 3, 2]] + [("e", None)],
                               "g string, v int")
    got = {r.g: r["mode"] for r in modes.mode_max(df, "g", "v").collect()}
    assert got == {"g": 3, "e": 0}


def test_sigops_and_p2sh_sigops():
    assert S.sigops(bytes.fromhex("5121" + "02" * 33 + "51ae")) == 20
    assert S.sigops(bytes.fromhex("76a94c")) == 0
    assert S.sigops(bytes.fromhex("acad4c")) == 2          # well-formed prefix counted
    redeem = "5121" + "02" * 33 + "21" + "03" * 33 + "52ae"
    sig = "00" + "%02x" % (len(redeem) // 2) + redeem
    assert S.p2sh_sigops(bytes.fromhex(sig)) == 2
    assert S.p2sh_sigops(b"") == 0


def test_chunk_predicates(spark):
    cltv = ("632102" + "11" * 32 + "ad670340420fb175682102" + "22" * 32 + "ac")
    multisig = "5121" + "02" * 33 + "21" + "03" * 33 + "52ae"
    df = spark.createDataFrame([(bytes.fromhex(h),) for h in [cltv, multisig, "6a01ff", "0102ac"]],
                               "script binary")
    p = df.select(S.chunks_of(S.parsed_script(F.col("script"))).alias("ch"))
    r = p.select(S.is_cltv_channel(F.col("ch")).alias("c"), S.is_multisig(F.col("ch")).alias("m"),
                 S.is_op_return(F.col("ch")).alias("o"), S.cltv_expiry(F.col("ch")).alias("e"),
                 S.cltv_sender_hex(F.col("ch")).alias("s")).collect()
    assert [(x.c, x.m, x.o) for x in r] == [(True, False, False), (False, True, False),
                                            (False, False, True), (False, False, False)]
    assert r[0].e == 1000000 and r[0].s == "02" + "22" * 32


def test_sql_functions(spark):
    from utxolens.functions.sql import register_functions

    names = register_functions(spark)
    assert "script_address" in names
    r = spark.sql(f"""SELECT script_address(X'76a914{GENESIS_HASH160}88ac') AS a,
                             script_address(X'51') AS n,
                             script_structure_parse(X'acacac87') AS s,
                             block_time_text(1231006505) AS t,
                             decode_address('1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa').payload_hex AS p
                   """).first()
    assert r.a == "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa" and r.n is None
    assert r.s == "CHECKSIG[3] EQUAL" and r.t == "2009-01-03 18::15" and r.p == GENESIS_HASH160


def test_array_mode_max(spark):
    df = spark.createDataFrame([([1, 1, 3, 3, 2],), ([],), (None,), ([5, None, 5, 7],)],
                               "a array<int>")
    got = [r.m for r in df.select(modes.array_mode_max(F.col("a")).alias("m")).collect()]
    assert got == [3, 0, 0, 5]


def test_opcode_lookup_both_ways(spark):
    from utxolens.functions import opcodes as op
    df = spark.createDataFrame([("CHECKSIG",), ("NOP2",), ("CHECKLOCKTIMEVERIFY",), ("BOGUS",)], "n string")
    got = [r.c for r in df.select(S.opcode_code_col(F.col("n")).alias("c")).collect()]
    assert got == [0xAC, 0xB1, 0xB1, 0xFF]
    assert [op.opcode_of(n) for n in ["CHECKSIG", "NOP2", "BOGUS"]] == [0xAC, 0xB1, 0xFF]
    codes = spark.createDataFrame([(0xAC,), (0xBA,), (0x00,)], "c int")
    names = [r.n for r in codes.select(S.opcode_name_col(F.col("c")).alias("n")).collect()]
    assert names == ["CHECKSIG", "NON_OP(186)", "0"]
