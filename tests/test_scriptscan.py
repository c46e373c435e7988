"""The batch parser against the parser of one script, on fuzzed and odd scripts."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utxolens.functions import opcodes as op
from utxolens.functions import scripts as S
from utxolens.functions import scriptscan as V

KEY = b"\x21\x02" + b"k" * 32
FIXED = [
    None, b"", b"\x00", b"\x4c", b"\x4d\x01", b"\x4e\x01\x00\x00", b"\x4b", b"\x01", b"\x6a", b"\x6a\x4c\xff",
    b"\x4c\x00", b"\x4d\x00\x00", b"\x4e\x00\x00\x00\x00", b"\x4e\xff\xff\xff\xff", b"\x4c\x01\x05", b"\x01\x81",
    b"\x76\xa9\x14" + b"h" * 20 + b"\x88\xac", b"\xa9\x14" + b"h" * 20 + b"\x87", KEY + b"\xac", KEY + KEY,
    b"\x51" + KEY + KEY + b"\x52\xae", b"\x51" + KEY + b"\x52\xaf", b"\x52" + KEY + b"\xac\x52\xae",
    b"\x63" + KEY + b"\xad\x67\x03\x40\x42\x0f\xb1\x75\x68" + KEY + b"\xac", b"\x4d\x10\x00" + b"p" * 16,
    b"\x25\x51" + KEY + KEY[:0] + b"\x51\xae"[:1] + b"\xae\xae", b"\x02\x4c\x05", b"\x51" * 5000, b"\x03abc" * 700,
    b"\x4f\xae", b"\x60\xae\xaf\xad", b"\x00\xae", b"\x01\x10", b"\x01\x11", b"\x76\xa9\x4c"]


def brute_flags(p):
    chunks, ok = S.parse(p) if p is not None else ([], False)
    if not ok:
        return (False, False, False)
    codes = [c for c, _, _ in chunks]
    n = len(codes)
    multi = (n >= 4 and codes[-1] in (0xAE, 0xAF) and 0x51 <= codes[-2] <= 0x60 and n == codes[-2] - 0x50 + 3
             and all(c <= 0x4E for c in codes[1:-2]) and 0x51 <= codes[0] <= 0x60)
    cltv = n == 10 and all(codes[k] == c for k, c in V.CLTV_SHAPE.items())
    return (multi, cltv, n > 0 and codes[0] == 0x6A)


def brute_nonminimal(p):
    chunks, ok = S.parse(p) if p is not None else ([], False)
    if not ok:
        return None
    bad = 0
    for code, data, _ in chunks:
        if code <= 0x4E:
            n = len(data)
            best = (0 if n == 0 else data[0] + 0x50 if n == 1 and 1 <= data[0] <= 16 else
                    0x4F if data == b"\x81" else n if n < 0x4C else 0x4C if n < 256 else 0x4D if n < 65536 else 0x4E)
            bad += code != best
    return bad


def brute_pubkey(p):
    chunks, ok = S.parse(p) if p is not None else ([], False)
    if not ok or len(chunks) != 2:
        return []
    (_, a, _), (code, b, _) = chunks
    if a is None or len(a) <= 2:
        return []
    if b is not None and len(b) > 2:
        return [b.hex()]
    return [a.hex()] if code == op.OP_CHECKSIG else []


def check(scripts):
    a = pa.array(scripts, pa.binary())
    got = V.chunks(V.Scan(a)).to_pylist()
    for p, g in zip(scripts, got):
        if p is None:
            assert g is None
            continue
        chunks, ok = S.parse(p)
        assert g["ok"] == ok, p
        assert [(c["opcode"], c["data"], c["start"]) for c in g["chunks"]] == chunks, p
    s = V.Scan(a)
    assert V.structure(s).to_pylist() == [S.structure(p) for p in scripts]
    assert V.disassembly(s).to_pylist() == [S.disassemble(p) for p in scripts]
    assert V.sigops(s).to_pylist() == [S.sigops(p) for p in scripts]
    assert V.p2sh_sigops(s).to_pylist() == [S.p2sh_sigops(p) for p in scripts]
    assert [tuple(f.values()) for f in V.flags(s).to_pylist()] == [brute_flags(p) for p in scripts]
    assert V.nonminimal(s).to_pylist() == [brute_nonminimal(p) for p in scripts]
    assert V.pubkeys(s).to_pylist() == [brute_pubkey(p) for p in scripts]
    rows = V.chunk_rows(s).to_pylist()
    for p, r in zip(scripts, rows):
        chunks, ok = S.parse(p) if p is not None else ([], False)
        want = [{"pos": i, "opcode": c, "name": op.opcode_name(c) if c > 0x4E else op.push_name(c),
                 "data_hex": None if d is None else d.hex(), "start": at}
                for i, (c, d, at) in enumerate(chunks)] if ok else None
        assert r == want, p


def test_fixed_scripts():
    check(FIXED)
    check(FIXED[::-1])
    for p in FIXED:
        check([p])
    check([])


@pytest.mark.parametrize("seed", range(40))
def test_fuzzed_scripts(seed):
    rng = random.Random(seed)
    near = [0, 1, 2, 5, 0x4B, 0x4C, 0x4D, 0x4E, 0x4F, 0x51, 0x52, 0x60, 0x6A, 0x76, 0xAC, 0xAE, 0xAF]
    out = []
    for _ in range(300):
        n = rng.choice([0, 1, 2, 3, 8, 30, 100])
        out.append(None if rng.random() < 0.03 else rng.randbytes(n) if rng.random() < 0.5
                   else bytes(rng.choice(near) for _ in range(n)))
    check(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=60)), max_size=20))
def test_any_scripts(scripts):
    check(scripts)


def test_slices_and_offsets(monkeypatch):
    a = pa.array(FIXED * 3, pa.binary())
    whole = V.structure(V.Scan(a)).to_pylist()
    monkeypatch.setattr(V, "SLICE", 50)
    assert V.by_slices(a, pa.string(), V.structure).to_pylist() == whole
    part = a.slice(7, 20)                                  # an array with an offset
    assert V.by_slices(part, pa.string(), V.structure).to_pylist() == whole[7:27]
    large = a.cast(pa.large_binary())
    assert V.by_slices(large, pa.string(), V.structure).to_pylist() == whole
    assert V.by_slices(a.slice(0, 0), pa.string(), V.structure).to_pylist() == []


def test_opcode_counts():
    want = [0] * 256
    for p in FIXED:
        chunks, ok = S.parse(p) if p is not None else ([], False)
        for c, _, _ in chunks if ok else ():
            want[c] += c > 0x4E
    assert V.opcode_counts(V.Scan(pa.array(FIXED, pa.binary()))).tolist() == want


@pytest.mark.parametrize("steps", [0, 1, 3])
def test_doubling_takes_over_anywhere(monkeypatch, steps):
    monkeypatch.setattr(V, "STEPS", steps)
    check(FIXED)
    rng = random.Random(steps)
    check([rng.randbytes(rng.randrange(80)) for _ in range(200)])
