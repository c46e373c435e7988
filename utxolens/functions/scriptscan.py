"""Scripts of a whole Arrow batch parsed at once in numpy.

All scripts of a batch lie in one buffer. A step finds the chunk at the present
place of every script together; few scripts have more than some chunks, so a
few steps do, each over the scripts that go on. What is left of scripts with
more than ``STEPS`` chunks is done by pointer doubling: for every byte, taken as
if a chunk began there, the next chunk's place follows from that byte (and the
length bytes after it) alone; the true chunk starts are the places reached from
the first bytes, and round k follows 2^k steps at once. So neither many scripts
nor long ones cost a loop of their own.

``Scan`` holds the result; the functions below turn it into Arrow columns:
chunks, structures, disassembly, signature operations, flags and counts. A
batch is worked on in slices of at most ``SLICE`` script bytes (or one script).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import opcodes as op

SLICE = 4 << 20
STEPS = 32                # chunks found a step at a time before pointer doubling
MULTISIG_WEIGHT = 20

_CODES = np.arange(256)
_HEAD = np.ones(256, np.int64)                      # bytes before a chunk's data
_HEAD[[op.OP_PUSHDATA1, op.OP_PUSHDATA2, op.OP_PUSHDATA4]] = 2, 3, 5
_DIRECT = np.where(_CODES < op.OP_PUSHDATA1, _CODES, 0)
_HAS_DATA = (_CODES <= op.OP_PUSHDATA4) | (_CODES == op.OP_RETURN)
_IS_OP = _CODES > op.OP_PUSHDATA4
_KEYS = np.where((_CODES >= op.OP_1) & (_CODES <= op.OP_16), _CODES - op.OP_1 + 1, 0)
_WEIGHT = np.zeros(256, np.int64)                   # signature operations
_WEIGHT[[op.OP_CHECKSIG, op.OP_CHECKSIGVERIFY]] = 1
_WEIGHT[[op.OP_CHECKMULTISIG, op.OP_CHECKMULTISIGVERIFY]] = MULTISIG_WEIGHT
_IS_MULTISIG = _WEIGHT == MULTISIG_WEIGHT
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _binary(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, null mask) of a binary array."""
    if pa.types.is_large_binary(a.type):
        a = a.cast(pa.binary())
    _, ends, data = a.buffers()
    off = np.frombuffer(ends, np.int32)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = a.is_null().to_numpy(zero_copy_only=False)
    return raw[off[0]:off[-1]], off - off[0], null


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), in order."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


def _offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=out[1:])
    return out


def _to_binary(data: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None,
               kind: pa.DataType | None = None) -> pa.Array:
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(kind or pa.binary(), len(lengths), [
        mask, pa.py_buffer(_offsets(lengths)), pa.py_buffer(np.ascontiguousarray(data))])


def _chunk_at(ahead: np.ndarray, at: np.ndarray, end: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, bytes before the data, and bytes of data of the chunk that begins at
    each place; ``ahead`` has five bytes more than the scripts, ``end`` is where
    each place's script ends."""
    code = ahead[at]
    head, size = _HEAD[code], _DIRECT[code]
    for mark, width in ((op.OP_PUSHDATA1, 1), (op.OP_PUSHDATA2, 2), (op.OP_PUSHDATA4, 4)):
        i = np.flatnonzero(code == mark)
        for k in range(width if len(i) else 0):
            size[i] += ahead[at[i] + 1 + k].astype(np.int64) << (8 * k)
    i = np.flatnonzero(code == op.OP_RETURN)
    size[i] = end[i] - at[i] - 1
    return code, head, size


def _by_doubling(ahead: np.ndarray, first: np.ndarray, end: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks of the byte ranges [first, end), and of damaged ones.
    For every byte the next chunk's place if one began there; then the places
    reached from the first bytes, round k following 2^k steps."""
    length = end - first
    base = np.cumsum(length) - length
    place, n = _ranges(first, length), int(length.sum())
    stop = np.repeat(end, length)
    _, head, size = _chunk_at(ahead, place, stop)
    after = place + head + size
    jump = np.append(np.where(after < stop, np.arange(n) + head + size, n), n)
    mark = np.zeros(n + 1, bool)
    mark[base] = True
    seen = -1
    while (reached := np.flatnonzero(mark[:n])).size != seen:
        seen = reached.size
        mark[jump[reached]] = True
        jump = jump[jump]
    bad = after[reached] > stop[reached]
    return place[reached[~bad]], place[reached[bad]]


class Scan:
    """Chunks of all scripts of one array, in order: ``start`` (in ``data``),
    ``code``, ``head`` and ``size`` (bytes before the data, and of it);
    ``cut[i]:cut[i + 1]`` are those of script i, ``ok[i]`` whether it parses to
    its end (its chunks are the parsed prefix otherwise)."""

    def __init__(self, scripts: pa.Array):
        self.data, self.off, self.null = _binary(scripts)
        self.ok = np.ones(len(self.off) - 1, bool)
        parts, wrong = self._walk()
        start, code, head, size = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(start, kind="stable")
        self.start, self.code, self.head, self.size = start[order], code[order], head[order], size[order]
        self.cut = np.searchsorted(self.start, self.off)
        self.wrong = np.concatenate(wrong)               # where the damaged chunks begin
        self.ok[np.searchsorted(self.off, self.wrong, side="right") - 1] = False

    def _walk(self) -> tuple[list, list]:
        """Chunks as (start, code, head, size), and starts of damaged ones. The
        first ``STEPS`` chunks of all scripts are found a step at a time, all
        scripts together; what longer scripts have left, by pointer doubling."""
        off, ahead = self.off, np.concatenate([self.data, np.zeros(5, np.uint8)])
        none = np.zeros(0, np.int64)
        parts, wrong = [(none, none.astype(np.uint8), none, none)], [none]
        some = np.flatnonzero(np.diff(off) > 0)
        at, end = off[some], off[some + 1]
        for _ in range(STEPS):
            if not len(at):
                return parts, wrong
            code, head, size = _chunk_at(ahead, at, end)
            after = at + head + size
            good = after <= end
            if not good.all():
                wrong.append(at[~good])
                at, end, code, head, size, after = (x[good] for x in (at, end, code, head, size, after))
            parts.append((at, code, head, size))
            on = after < end
            at, end = after[on], end[on]
        if len(at):
            starts, bad = _by_doubling(ahead, at, end)
            wrong.append(bad)
            stop = np.repeat(end, np.diff(np.searchsorted(starts, np.append(at, len(ahead)))))
            parts.append((starts, *_chunk_at(ahead, starts, stop)))
        return parts, wrong

    def __len__(self) -> int:
        return len(self.ok)

    @property
    def whole(self) -> np.ndarray:
        """Scripts that are not null and parse."""
        return self.ok & ~self.null

    def per_script(self, values: np.ndarray) -> np.ndarray:
        """Sums of one number per chunk over each script."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.cut[1:]] - total[self.cut[:-1]]

    def code_at(self, k: int) -> np.ndarray:
        """Code of each script's chunk ``k`` (from its end if negative), -1 if none."""
        at = self.cut[:-1] + k if k >= 0 else self.cut[1:] + k
        there = (at >= self.cut[:-1]) & (at < self.cut[1:])
        out = np.full(len(self), -1, np.int64)
        out[there] = self.code[at[there]]
        return out

    def payload(self, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, lengths) of the data of all chunks, none for those to leave out."""
        # nearly all bytes are data: take out the heads and what was not parsed
        keep = np.ones(len(self.data), bool)
        keep[self.start] = False
        for k in (1, 2, 3, 4):
            keep[self.start[self.head > k] + k] = False
        if len(self.wrong):
            end = self.off[np.searchsorted(self.off, self.wrong, side="right")]
            keep[_ranges(self.wrong, end - self.wrong)] = False
        size = self.size
        if leave is not None:
            i = np.flatnonzero(leave)
            keep[_ranges(self.start[i] + self.head[i], size[i])] = False
            size = np.where(leave, 0, size)
        return self.data[keep], size

    def payload_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, lengths) of the data of some chunks."""
        size = self.size[chosen]
        return self.data[_ranges(self.start[chosen] + self.head[chosen], size)], size


def slices(scripts: pa.Array) -> Iterator[Scan]:
    """The scripts of an array in slices of bounded bytes."""
    if not len(scripts):
        return
    off = np.frombuffer(scripts.buffers()[1], np.int64 if pa.types.is_large_binary(scripts.type)
                        else np.int32)[scripts.offset:scripts.offset + len(scripts) + 1]
    at = 0
    while at < len(scripts):
        stop = max(at + 1, int(np.searchsorted(off, int(off[at]) + SLICE, side="right")) - 1)
        yield Scan(scripts.slice(at, stop - at))
        at = stop


def by_slices(scripts: pa.Array, kind: pa.DataType, build: Callable[[Scan], pa.Array]) -> pa.Array:
    """``build`` over slices of bounded bytes, as one array of ``kind``."""
    out = [build(s) for s in slices(scripts)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


# --- columns -----------------------------------------------------------------

def chunks(s: Scan) -> pa.Array:
    """``struct<ok, chunks: list<struct<opcode, data, start>>>``; null for null."""
    data, size = s.payload()
    inner = pa.StructArray.from_arrays(
        [pa.array(s.code.astype(np.int32)), _to_binary(data, size, _HAS_DATA[s.code]),
         pa.array((s.start - np.repeat(s.off[:-1], np.diff(s.cut))).astype(np.int32))],
        names=["opcode", "data", "start"])
    mask = pa.array(s.null)
    return pa.StructArray.from_arrays(
        [pa.array(s.ok, mask=s.null), pa.ListArray.from_arrays(
            pa.array(s.cut.astype(np.int32)), inner, mask=mask)], names=["ok", "chunks"], mask=mask)


def _structure_of(codes: bytes) -> str:
    runs = [(op.opcode_name(code), sum(1 for _ in run)) for code, run in groupby(codes)]
    return " ".join([f"{name}[{n}]" for name, n in runs[:-1]] + [name for name, _ in runs[-1:]])


def structure(s: Scan) -> pa.Array:
    """Runs of equal opcodes; each distinct sequence is spelt once."""
    ops = _IS_OP[s.code]
    lengths = np.diff(np.searchsorted(s.start[ops], s.off))
    seen = _to_binary(s.code[ops], lengths).dictionary_encode()
    names = [_structure_of(c) for c in seen.dictionary.to_pylist()]
    places = np.where(s.whole, seen.indices.to_numpy(), len(names))
    return pa.array([*names, "ERROR"], pa.string()).take(pa.array(places))


_ASM = pa.array([op.opcode_name(c) if c > op.OP_PUSHDATA4 else op.push_name(c) + "[" for c in range(256)])
_CLOSE = pa.array(["]", ""])


def disassembly(s: Scan) -> pa.Array:
    """Names and ``PUSHDATA(n)[hex]``, blank between; null for null and damaged."""
    is_op = _IS_OP[s.code]
    data, size = s.payload(is_op)
    text = pc.binary_join_element_wise(
        _ASM.take(pa.array(s.code)), _to_binary(_HEX[data].ravel(), 2 * size, None, pa.string()),
        _CLOSE.take(pa.array(is_op.astype(np.int8))), "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(s.cut.astype(np.int32)), text), " ")
    return pc.if_else(pa.array(s.whole), joined, pa.scalar(None, pa.string()))


def _operations(s: Scan, accurate: bool) -> np.ndarray:
    """Signature operations of each script's parsed chunks."""
    weight = _WEIGHT[s.code].copy()
    if accurate:
        ops = np.flatnonzero(_IS_OP[s.code])
        script = np.repeat(np.arange(len(s)), np.diff(s.cut))[ops]
        before = np.zeros(len(ops), np.int64)
        if len(ops):
            same = script[1:] == script[:-1]
            before[1:] = np.where(same, _KEYS[s.code[ops[:-1]]], 0)
        known = _IS_MULTISIG[s.code[ops]] & (before > 0)
        weight[ops[known]] = before[known]
    return s.per_script(weight)


def sigops(s: Scan) -> pa.Array:
    return pa.array(_operations(s, False).astype(np.int32), mask=s.null)


def p2sh_sigops(s: Scan) -> pa.Array:
    """Accurate operations of the script that each script pushes last; 0 without
    a push, null where that is no script."""
    pushes = np.flatnonzero(~_IS_OP[s.code])
    cut = np.searchsorted(s.start[pushes], s.off)
    some = cut[1:] > cut[:-1]
    data, size = s.payload_of(pushes[cut[1:][some] - 1])
    redeem = Scan(_to_binary(data, size))
    out, null = np.zeros(len(s), np.int64), s.null.copy()
    out[some] = _operations(redeem, True)
    null[np.flatnonzero(some)[~redeem.ok]] = True
    return pa.array(out, mask=null)


FLAGS = pa.struct([("is_multisig", pa.bool_()), ("is_cltv", pa.bool_()), ("is_op_return", pa.bool_())])
CLTV_SHAPE = {0: op.OP_IF, 2: op.OP_CHECKSIGVERIFY, 3: op.OP_ELSE, 5: op.OP_CHECKLOCKTIMEVERIFY,
              6: op.OP_DROP, 7: op.OP_ENDIF, 9: op.OP_CHECKSIG}


def flags(s: Scan) -> pa.Array:
    """Multisig, lock-time channel and RETURN tests; false for null and damaged."""
    n = np.diff(s.cut)
    first, last, second_last = s.code_at(0), s.code_at(-1), s.code_at(-2)
    keys = np.where(second_last >= 0, _KEYS[second_last], 0)
    n_ops = s.per_script(_IS_OP[s.code])
    # four opcodes at their places; all between is data
    ends = (first >= op.OP_1) & (first <= op.OP_16)
    multi = (s.whole & (n >= 4) & ends & (keys >= 1) & (n == keys + 3) & (n_ops == 3)
             & ((last == op.OP_CHECKMULTISIG) | (last == op.OP_CHECKMULTISIGVERIFY)))
    cltv = s.whole & (n == 10)
    for place, code in CLTV_SHAPE.items():
        cltv &= s.code_at(place) == code
    return pa.StructArray.from_arrays([pa.array(multi), pa.array(cltv), pa.array(
        s.whole & (first == op.OP_RETURN))], fields=list(FLAGS))


def nonminimal(s: Scan) -> pa.Array:
    """Pushes that have a shorter encoding, per script; null for null and damaged."""
    size, code = s.size, s.code.astype(np.int64)
    one = np.zeros(len(code), np.int64)
    single = np.flatnonzero(size == 1)
    one[single] = s.data[s.start[single] + s.head[single]]
    best = np.where(size == 0, op.OP_0, np.where(size < op.OP_PUSHDATA1, size, np.where(
        size < 256, op.OP_PUSHDATA1, np.where(size < 65536, op.OP_PUSHDATA2, op.OP_PUSHDATA4))))
    best = np.where((size == 1) & (one >= 1) & (one <= 16), one + op.OP_1 - 1, best)
    best = np.where((size == 1) & (one == 0x81), op.OP_1NEGATE, best)
    bad = (code <= op.OP_PUSHDATA4) & (code != best)
    return pa.array(s.per_script(bad).astype(np.int64), mask=~s.whole)


def opcode_counts(s: Scan) -> np.ndarray:
    """How often each code from 0 to 255 is an opcode of a script that parses."""
    keep = np.repeat(s.whole, np.diff(s.cut)) & _IS_OP[s.code]
    return np.bincount(s.code[keep], minlength=256)


CHUNK_ROWS = pa.list_(pa.struct([("pos", pa.int32()), ("opcode", pa.int32()), ("name", pa.string()),
                                 ("data_hex", pa.string()), ("start", pa.int32())]))
_NAMES = pa.array([op.opcode_name(c) if c > op.OP_PUSHDATA4 else op.push_name(c) for c in range(256)])


def chunk_rows(s: Scan) -> pa.Array:
    """``list<struct<pos, opcode, name, data_hex, start>>`` of scripts that parse,
    null for others: what is shown of each chunk, spelt out."""
    keep = np.repeat(s.whole, np.diff(s.cut))
    counts = np.where(s.whole, np.diff(s.cut), 0)
    cut = np.concatenate([[0], np.cumsum(counts)])
    code = s.code[keep]
    data, size = s.payload(~keep)
    size = size[keep]
    inner = pa.StructArray.from_arrays(
        [pa.array((np.arange(len(code)) - np.repeat(cut[:-1], counts)).astype(np.int32)),
         pa.array(code.astype(np.int32)), _NAMES.take(pa.array(code)),
         _to_binary(_HEX[data].ravel(), 2 * size, _HAS_DATA[code], pa.string()),
         pa.array((s.start[keep] - np.repeat(s.off[:-1], counts)).astype(np.int32))],
        fields=list(CHUNK_ROWS.value_type))
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), inner, mask=pa.array(~s.whole))


_PUBKEYS = pa.list_(pa.string())


def pubkeys(s: Scan) -> pa.Array:
    """The key of a script of two chunks, ``<sig> <key>`` or ``<key> CHECKSIG``,
    as a list of at most one hex text."""
    two = np.flatnonzero(s.whole & (np.diff(s.cut) == 2))
    a, b = s.cut[:-1][two], s.cut[:-1][two] + 1
    first, second = (_HAS_DATA[s.code[x]] & (s.size[x] > 2) for x in (a, b))
    chosen = np.where(first & second, b, a)
    found = first & (second | (s.code[b] == op.OP_CHECKSIG))
    counts = np.zeros(len(s), np.int64)
    counts[two[found]] = 1
    data, size = s.payload_of(chosen[found])
    return pa.ListArray.from_arrays(pa.array(_offsets(counts)),
                                    _to_binary(_HEX[data].ravel(), 2 * size, None, pa.string()))


CLTV = pa.struct([("sender_hex", pa.string()), ("recipient_hex", pa.string()), ("expiry", pa.int64())])


def cltv(s: Scan) -> pa.Array:
    """Sender, recipient and expiry of lock-time channels, null for other
    scripts; the expiry is a little-endian number whose top bit is the sign,
    null beyond five bytes."""
    found = np.flatnonzero(flags(s).field("is_cltv").to_numpy(zero_copy_only=False))
    out: list[dict | None] = [None] * len(s)

    def data(i: int, k: int) -> bytes:
        at = s.cut[i] + k
        begin = s.start[at] + s.head[at]
        return s.data[begin:begin + s.size[at]].tobytes()

    for i in found:                                     # channels alone, not scripts
        raw = data(i, 4)
        value = int.from_bytes(raw[:-1] + bytes([raw[-1] & 0x7F]), "little") if raw else 0
        value = -value if raw and raw[-1] & 0x80 else value
        out[i] = {"sender_hex": data(i, 8).hex(), "recipient_hex": data(i, 1).hex(),
                  "expiry": value if len(raw) <= 5 else None}
    return pa.array(out, CLTV)
