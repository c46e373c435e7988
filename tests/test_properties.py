"""Property tests: native/UDF paths against slow independent Python."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from utxolens.functions import address as A
from utxolens.functions import scripts as S
from utxolens.operators import utxo


def _slow_type(b: bytes) -> str:
    chunks, ok = S.parse(b)
    if not ok:
        return "NO_TYPE"
    ops = [c for c, _d, _s in chunks]
    data = [d for _c, d, _s in chunks]
    if (len(chunks) == 5 and ops[0] == 0x76 and ops[1] == 0xA9 and data[2] is not None
            and not S.is_opcode(ops[2]) and len(data[2]) == 20 and ops[3] == 0x88 and ops[4] == 0xAC):
        return "P2PKH"
    if (len(chunks) == 2 and ops[1] == 0xAC and not S.is_opcode(ops[0])
            and len(data[0]) > 1):
        return "PUB_KEY"
    if len(b) == 23 and b[0] == 0xA9 and b[1] == 0x14 and b[22] == 0x87:
        return "P2SH"
    return "NO_TYPE"


script_bytes = st.one_of(
    st.binary(max_size=40),
    st.builds(lambda h: bytes.fromhex("76a914") + h + bytes.fromhex("88ac"), st.binary(min_size=20, max_size=20)),
    st.builds(lambda h: bytes([len(h)]) + h + b"\xac", st.binary(min_size=0, max_size=70)),
    st.builds(lambda h: b"\x4c" + bytes([len(h)]) + h + b"\xac", st.binary(min_size=0, max_size=70)),
    st.builds(lambda h: bytes([len(h)]) + h, st.binary(min_size=0, max_size=75)),
    st.builds(lambda h: b"\x4d" + len(h).to_bytes(2, "little") + h + b"\xac",
              st.binary(min_size=0, max_size=40)),
    st.builds(lambda h: b"\x4e" + len(h).to_bytes(4, "little") + h + b"\xac",
              st.binary(min_size=0, max_size=40)),
    st.builds(lambda h, p: bytes.fromhex("76a9") + p + h + bytes.fromhex("88ac"),
              st.binary(min_size=20, max_size=20),
              st.sampled_from([bytes.fromhex("4d1400"), bytes.fromhex("4e14000000"),
                               bytes.fromhex("4c15")])),
    st.builds(lambda h: b"\x6a" + h, st.binary(max_size=10)),
    st.builds(lambda h: b"\x00" + bytes([len(h)]) + h, st.sampled_from([b"\x01" * 20, b"\x02" * 32])),
    st.builds(lambda m, ks, n, tail: bytes([0x50 + m]) + b"".join(bytes([len(k)]) + k for k in ks)
              + bytes([0x50 + n]) + tail,
              st.integers(1, 16),
              st.lists(st.sampled_from([b"\x02" * 33, b"\x04" * 65, b"\x03" * 32]),
                       min_size=1, max_size=3),
              st.integers(1, 16), st.sampled_from([b"\xae", b"\xaf", b"\xae\xae"])),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(script_bytes, min_size=300, max_size=300))
def test_native_functions_match_slow_parser(spark, scripts):
    df = spark.createDataFrame([(s,) for s in scripts], "script binary")
    rows = df.select("script", A.script_type(F.col("script")).alias("t"),
                     S.script_structure(F.col("script")).alias("s"),
                     S.script_sigops(F.col("script")).alias("n")).collect()
    for r in rows:
        b = bytes(r.script)
        assert r.t == _slow_type(b), b.hex()
        assert r.s == S.structure(b), b.hex()
        assert r.n == S.sigops(b), b.hex()
        if r.s == "":      # the pre-filter of blocks_without_opcodes is a necessary condition
            assert len(b) == 0 or b[0] <= 0x4E, b.hex()


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from("abcdef"), st.integers(0, 2)),
                min_size=0, max_size=60))
def test_unspent_matches_fold_replay(spark, elems):
    # replay of the reference fold: pairwise combine keeps one row, marks it 2
    state = {}
    for t, h, i in elems:
        k = (h, i)
        state[k] = t if k not in state else 2
    want = sorted(k for k, v in state.items() if v == 1)
    df = spark.createDataFrame([(t, "b", 0, h, i, 1, b"") for t, h, i in elems],
                               "type int, block_hash string, tx_idx int, tx_hash string, "
                               "idx bigint, amount bigint, script binary")
    got = sorted((r.tx_hash, r.idx) for r in utxo.unspent_outputs(df).collect())
    assert got == want



@settings(max_examples=3, deadline=None)
@given(st.lists(script_bytes, min_size=300, max_size=300))
def test_parsed_chunks_match_parser(spark, scripts):
    df = spark.createDataFrame([(s,) for s in scripts] + [(None,)], "script binary")
    rows = df.select("script", S.parsed_script(F.col("script")).alias("p")).collect()
    for r in rows:
        if r.script is None:
            assert r.p is None
            continue
        chunks, ok = S.parse(bytes(r.script))
        got = [(c.opcode, None if c.data is None else bytes(c.data), c.start) for c in r.p.chunks]
        assert r.p.ok == ok and got == chunks, bytes(r.script).hex()
