"""Removal of repeated byte strings by hash-compared suffix sorting.

Texts are UTF-8 bytes. A byte goes if a string of ``LENGTH`` bytes that covers
it also starts earlier: in a document with a smaller key, or before in its own.

1. Equal texts are collapsed (map-side first): all but the first copy are
   covered whole. The distinct texts are written once, bucketed by digest, so
   that what is found comes back to them without moving them again.
2. Every window of LENGTH bytes is owned by its minimizer, the leftmost of its
   runs of ``GRAM`` bytes with the least hash. Equal windows own equal
   minimizers, so only texts around minimizers that occur twice or more can
   hold a repeat; a bitmap of those (at most ``MAX_BITS`` bits, else it lets
   more through, never less) keeps the others from being shuffled.
3. Segments around equal minimizers meet in a task. Prefix polynomial hashes
   over the task's bytes give the common extension of two suffixes by binary
   search, so a merge sort compares suffixes in a logarithmic number of steps.
   Neighbours in suffix order with a common extension of LENGTH or more are
   repeats; equality by hash is verified on the bytes. Equal segments are
   sorted first and one of each kind goes on, then the windows of the kinds;
   what has a hash of its own over all its bytes is not sorted.
4. A minimizer that occurs more than ``HOT`` times is not brought together:
   of its windows each text hands on the distinct ones (their bytes compared;
   further ones in the same text are repeats there and then), and those meet by
   their own 128-bit hash in a grouped minimum, which combines map-side. These
   alone are not compared byte by byte: the bytes of all windows of a crowded
   minimizer would be many times the texts they are in.

Edge cases: a null text has no bytes; texts under LENGTH bytes lose nothing; a
null key comes first; rows with equal key and text are copies of one another;
an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..session import checkpoint_dir
from .common import materialize, small_batches, text_or_empty

LENGTH = 100              # bytes of a repeated string
GRAM = 32                 # bytes of a minimizer
MAX_BITS = 1 << 29        # bits of the bitmap of repeated minimizers
HOT = 200_000             # occurrences beyond which a minimizer's windows meet by hash
CROWD_BITS = 1 << 27      # most bits of the table of minimizers that occur more often
TASK_SEGMENTS = 20_000    # segments that are sorted at once
TASK_ROWS = 2_000_000     # segments that a task reads, sorted by minimizer
PIECE = 1 << 20           # bytes that are hashed at a time
BLOCK_WINDOWS = 1 << 20   # windows that are sorted at a time

_MULT = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _roll(x: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """Polynomial hash of every run of ``size`` bytes."""
    one, out, done, mult = values[x], None, 0, np.array([_MULT])
    part, span = one, 1
    while True:                                        # binary decomposition of the size
        if size & span:
            if out is None:
                out, done = part, span
            else:
                n = len(x) - done - span + 1
                out, done = out[:n] * mult + part[done:done + n], done + span
        if span * 2 > size:
            return _mix(out)
        n = len(part) - span
        part, mult, span = part[:n] * mult + part[span:span + n], mult * mult, span * 2


def _roll_simple(x: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """As ``_roll`` for a size that is a power of two."""
    h, mult, span = values[x], np.array([_MULT]), 1
    while span < size:
        h, mult, span = h[:-span] * mult + h[span:], mult * mult, span * 2
    return _mix(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    cur, span = h, 1
    while span * 2 <= width:
        cur, span = np.minimum(cur[:-span], cur[span:]), span * 2
    rest = width - span
    return np.minimum(cur[:len(h) - width + 1], cur[rest:rest + len(h) - width + 1])


def anchors(x: np.ndarray, last: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Minimizers of a buffer of documents.

    ``last[i]`` is the end of the document that byte i lies in. Returns the
    hash, the place, and the first and last window start of each run of windows
    that share a minimizer."""
    width, n = length - gram + 1, len(x) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    h = _roll_simple(x, gram, _BYTE)
    least = _least(h, width)
    valid = np.arange(n) + length <= last[:n]
    new = np.r_[True, (least[1:] != least[:-1]) | (last[1:n] != last[:n - 1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(new)
    stop = np.r_[first[1:], n] - 1
    keep = valid[first]
    first, stop = first[keep], stop[keep]
    place = np.empty(len(first), np.int64)
    reach = np.arange(width)
    for i in range(0, len(first), 1 << 14):
        at = first[i:i + (1 << 14)]
        place[i:i + (1 << 14)] = at + (h[at[:, None] + reach] == least[at][:, None]).argmax(axis=1)
    out = [(least[first], place, first, np.minimum(stop, place))]
    # where the same bytes come again, a run goes on beyond its minimizer: each
    # further occurrence owns the windows after the one before
    on = place < stop
    first, stop, place = first[on], stop[on], place[on]
    many = stop + width - 1 - place
    run = np.repeat(np.arange(len(first)), many)
    p = place[run] + 1 + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    hit = h[p] == least[first][run]
    run, p = run[hit], p[hit]
    previous = np.r_[0, p[:-1]][:len(p)]
    begins = np.r_[True, run[1:] != run[:-1]][:len(p)]
    previous[begins] = place[run[begins]]
    own = previous < stop[run]
    run, p, previous = run[own], p[own], previous[own]
    out.append((least[first][run], p, previous + 1, np.minimum(stop[run], p)))
    return tuple(np.concatenate(c) for c in zip(*out))


def pieces(texts: list[bytes], length: int = LENGTH, size: int = PIECE):
    """Buffers of about ``size`` bytes: the bytes, the document's number and
    offset of each part, and where parts start. Long documents are cut with an
    overlap, so each window lies in one part."""
    held, total = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), size):
            part = t[s:s + size + length - 1]
            if len(part) < length:
                continue
            held.append((i, s, part))
            total += len(part)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _anchors_of(texts: list[bytes]):
    """Per buffer: its bytes, the document and offset of each anchor's part,
    and the anchors."""
    for held in pieces(texts):
        x = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        size = np.array([len(p) for _, _, p in held])
        end = np.cumsum(size)
        h, place, lo, hi = anchors(x, np.repeat(end, size))
        part = np.searchsorted(end, lo, side="right")
        doc = np.array([d for d, _, _ in held])[part]
        shift = np.array([s for _, s, _ in held])[part] - (end - size)[part]
        yield x, doc, shift, h, place, lo, hi


# --- suffix sorting within a task

class Suffixes:
    """Prefix polynomial hashes over a buffer, modulo 2**64."""

    def __init__(self, x: np.ndarray):
        self.x = x
        power = np.empty(len(x) + 1, np.uint64)
        power[0] = 1
        power[1:] = _MULT
        self.power = np.cumprod(power)                 # wraps; the multiplier is odd
        inverse = np.array([pow(int(_MULT), -1, 1 << 64)], np.uint64)
        back = np.empty(len(x) + 1, np.uint64)
        back[0] = 1
        back[1:] = inverse[0]
        self.back = np.cumprod(back)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE2[x] * self.power[:-1], out=self.sums[1:])

    def same(self, a, b, n):
        """Whether n bytes from a and from b have equal hashes."""
        return ((self.sums[a + n] - self.sums[a]) * self.back[a]
                == (self.sums[b + n] - self.sums[b]) * self.back[b])

    def twice(self, at, khash, offset, start, size) -> np.ndarray:
        """Those of the rows ``at``, in their order, whose minimizer, place and
        hash of all their bytes occur twice or more: only they can be equal."""
        a, n = start[at], size[at]
        whole = (self.sums[a + n] - self.sums[a]) * self.back[a]
        code = _mix(whole * _MULT ^ khash[at]) ^ (offset[at] * 1_000_003 + n).astype(np.uint64)
        order = np.argsort(code, kind="stable")
        c = code[order]
        pair = np.r_[False, c[1:] == c[:-1]] if len(c) else np.zeros(0, bool)
        pair[:-1] |= pair[1:].copy()
        out = np.zeros(len(at), bool)
        out[order[pair]] = True
        return at[out]

    def common(self, a, b, most):
        """Common extension of suffixes a and b, up to ``most`` bytes each."""
        whole = self.same(a, b, most)
        low, high = np.where(whole, most, 0), most.copy()
        at = np.flatnonzero(~whole)
        while len(at):                                 # the answer lies in [low, high)
            mid = (low[at] + high[at]) // 2
            ok = self.same(a[at], b[at], mid)
            low[at] = np.where(ok, mid, low[at])
            high[at] = np.where(ok, high[at], mid)
            at = at[high[at] - low[at] > 1]
        return low

    def before(self, a, la, b, lb):
        """-1, 0 or 1 as suffix a (la bytes long) sorts before, with or after b."""
        most = np.minimum(la, lb)
        n = self.common(a, b, most)
        ended = n == most
        i, j = np.where(ended, a, a + n), np.where(ended, b, b + n)
        byte = self.x[np.minimum(i, len(self.x) - 1)].astype(np.int16) - self.x[
            np.minimum(j, len(self.x) - 1)]
        return np.where(ended, np.sign(la - lb), np.sign(byte))

    def sort(self, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of the suffixes by group, then by bytes: a merge sort whose
        runs double, all groups at once. ``group`` has to be ascending."""
        n = len(start)
        order = np.arange(n)
        begin = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1] if n else np.zeros(0, int)
        count = np.diff(np.r_[begin, n])
        first, total = np.repeat(begin, count), np.repeat(count, count)
        width = 1
        while n and width < count.max():
            at = np.flatnonzero(total > width)         # places whose group has two runs or more
            base = first[at]
            within = at - base
            run = within // width
            mate = base + (run ^ 1) * width            # the run it is merged with
            stop = np.minimum(mate + width, base + total[at])
            live = mate < base + total[at]
            at, base, run, within = at[live], base[live], run[live], within[live]
            low, high = mate[live].copy(), stop[live].copy()
            from_mate = low.copy()
            right = (run & 1).astype(bool)
            mine = order[at]
            open_ = np.flatnonzero(low < high)
            while len(open_):                          # how many of the mate's run come before
                mid = (low[open_] + high[open_]) // 2
                other, me = order[mid], mine[open_]
                c = self.before(start[other], size[other], start[me], size[me])
                less = (c < 0) | ((c == 0) & right[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            pair = base + (run & ~1) * width
            target = pair + (within - run * width) + (low - from_mate)
            new = order.copy()
            new[target] = mine
            order, width = new, width * 2
        return order

    def equal_bytes(self, a, b, n) -> np.ndarray:
        """Whether n bytes from a and b are the same bytes."""
        out = np.ones(len(a), bool)
        longest = int(n.max()) if len(n) else 0
        reach = np.arange(longest)
        for i in range(0, len(a), 1 << 14):
            s = slice(i, i + (1 << 14))
            inside = reach[None, :] < n[s][:, None]
            p = np.minimum(a[s][:, None] + reach, len(self.x) - 1)
            q = np.minimum(b[s][:, None] + reach, len(self.x) - 1)
            out[s] = ((self.x[p] == self.x[q]) | ~inside).all(axis=1)
        return out

    def classes(self, group, start, size) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes and, along it, the number of the class of equal
        ones (same group, size and bytes)."""
        order = self.sort(group, start, size)
        a, b = order[:-1], order[1:]
        alike = (group[a] == group[b]) & (size[a] == size[b])
        at = np.flatnonzero(alike)
        if len(at):
            n = size[a[at]]
            same = self.common(start[a[at]], start[b[at]], n) == n
            at = at[same]
            alike[:] = False
            alike[at[self.equal_bytes(start[a[at]], start[b[at]], size[a[at]])]] = True
        return order, np.cumsum(np.r_[True, ~alike]) - 1 if len(order) else np.zeros(0, int)


def _first_in(number: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per row, the least rank in its class; classes are numbered from 0 along."""
    least = np.full(int(number[-1]) + 1 if len(number) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, number, rank)
    return least[number]


def repeats(khash: np.ndarray, offset: np.ndarray, rank: np.ndarray, segments: list[bytes],
            length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of segments around equal minimizers: (segment, from,
    to) byte ranges in the segments. ``offset`` is the minimizer's place in the
    segment, ``rank`` the segments' order of occurrence."""
    x = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments], np.int64)
    start = np.cumsum(size) - size
    s = Suffixes(x)
    # equal segments: all but the first of a kind are covered whole
    at = s.twice(np.lexsort((offset, khash)), khash, offset, start, size)
    alone = np.ones(len(size), bool)
    alone[at] = False
    k, o = khash[at], offset[at]
    group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(at) else at
    order, number = s.classes(group, start[at], size[at])
    rows = at[order]
    first = _first_in(number, rank[rows]) == rank[rows]
    copies, kinds = rows[~first], np.r_[np.flatnonzero(alone), rows[first]]
    found = [(copies, np.zeros(len(copies), np.int64), size[copies])]
    # windows of the kinds, by minimizer and by how far before it they start
    _, inverse, many = np.unique(khash[kinds], return_inverse=True, return_counts=True)
    kinds, inverse = kinds[many[inverse] > 1], inverse[many[inverse] > 1]
    for rows, least, most in _blocks(kinds, inverse, size[kinds] - length + 1, length):
        low = np.maximum(0, offset[rows] - most)       # windows starting in [low, high)
        high = np.minimum(size[rows] - length + 1, offset[rows] - least + 1)
        windows = np.maximum(0, high - low)
        row = np.repeat(rows, windows)
        p = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows - low, windows)
        before = offset[row] - p
        at = np.lexsort((before, khash[row]))
        row, p, before = row[at], p[at], before[at]
        at = s.twice(np.arange(len(row)), khash[row], before, start[row] + p,
                     np.full(len(row), length, np.int64))
        row, p, before = row[at], p[at], before[at]
        if len(row):
            k = khash[row]
            group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (before[1:] != before[:-1])])
            order, number = s.classes(group, start[row] + p, np.full(len(row), length, np.int64))
            row, p = row[order], p[order]
            later = _first_in(number, rank[row]) != rank[row]
            found.append((row[later], p[later], p[later] + length))
    return tuple(np.concatenate(c) for c in zip(*found))


def _blocks(kinds: np.ndarray, bucket: np.ndarray, windows: np.ndarray, length: int):
    """Rows of whole buckets with about ``BLOCK_WINDOWS`` windows, and the range
    of distances before the minimizer; a large bucket takes several ranges."""
    at = np.argsort(bucket, kind="stable")
    kinds, bucket, windows = kinds[at], bucket[at], windows[at]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(kinds) else []
    ends = np.r_[begin[1:], len(kinds)] if len(kinds) else []
    total = np.r_[0, np.cumsum(windows)]
    held = 0
    for i, (b, e) in enumerate(zip(begin, ends)):
        if total[e] - total[b] > BLOCK_WINDOWS:        # on its own, in ranges
            if held < b:
                yield kinds[held:b], 0, length
            step = max(1, BLOCK_WINDOWS // int(e - b))
            for d in range(0, length, step):
                yield kinds[b:e], d, d + step - 1
            held = e
        elif total[e] - total[held] > BLOCK_WINDOWS:
            yield kinds[held:b], 0, length
            held = b
    if held < len(kinds):
        yield kinds[held:], 0, length


def merge(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Overlapping or touching ranges of an owner made one."""
    at = np.lexsort((lo, owner))
    owner, lo, hi = owner[at], lo[at], hi[at]
    if not len(owner):
        return owner, lo, hi
    # running end within an owner: shift owners apart, then one running maximum
    span = int(hi.max()) + 2
    code = np.cumsum(np.r_[0, owner[1:] != owner[:-1]]) * span
    end = np.maximum.accumulate(hi + code) - code
    new = np.r_[True, (owner[1:] != owner[:-1]) | (lo[1:] > end[:-1])]
    start = np.flatnonzero(new)
    return owner[start], lo[start], np.maximum.reduceat(hi, start)


def _first_windows(x: np.ndarray, doc: np.ndarray, p: np.ndarray, w1: np.ndarray, w2: np.ndarray,
                   block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of each text's distinct windows, the first place of each, and of
    all others; windows of one hash count as equal if their bytes are."""
    order = np.lexsort((p, w2, w1, doc))
    new = np.ones(len(order), bool)
    new[1:] = ((doc[order][1:] != doc[order][:-1]) | (w1[order][1:] != w1[order][:-1])
               | (w2[order][1:] != w2[order][:-1]))
    like = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    rest = np.flatnonzero(~new)
    for at in range(0, len(rest), block):
        i = rest[at:at + block]
        span = np.arange(LENGTH)
        equal = (x[p[order[i]][:, None] + span] == x[p[like[i]][:, None] + span]).all(axis=1)
        new[i[~equal]] = True
    return order[new], order[~new]


# --- the distributed steps

def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(tkey, first, text): each distinct text with its smallest key, in a
    table bucketed by its 128-bit digest in the shared folder."""
    spark = docs.sparkSession
    t = text_or_empty(text)
    own = (docs.select(F.unhex(F.md5(t)).alias("tkey"), F.col(key).alias("first"), t.alias("text"))
           .groupBy("tkey").agg(F.min(F.struct(F.col("first").isNotNull().alias("some"), "first"))
                                .alias("f"), F.first("text").alias("text"))
           .select("tkey", F.col("f.first").alias("first"), "text"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (own.write.format("parquet").option("path", f"{checkpoint_dir(spark).rstrip('/')}/utxolens/{name}")
     .bucketBy(buckets, "tkey").saveAsTable(name))
    _TABLES.append((spark.sparkContext.applicationId, name))
    return spark.table(name)


#: catalog names of texts written in this process, until ``drop_tables``
_TABLES: list[tuple[str, str]] = []


def drop_tables(spark: SparkSession) -> None:
    """Take the names of written texts out of the catalog (bucketing needs a
    name), when what reads them has run; the files stay in the shared folder."""
    app = spark.sparkContext.applicationId
    for known, name in list(_TABLES):
        if known == app:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _TABLES.remove((known, name))


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(33)) * np.uint64(2654435761) & mask


def spans(texts: DataFrame, *, hot: int = HOT) -> DataFrame:
    """(tkey, s, e): byte ranges of the distinct texts that repeat earlier."""
    spark = texts.sparkSession
    order_type = dict(texts.dtypes)["first"]

    def count(batches: Iterator) -> Iterator:
        for b in batches:
            got = [h for _, _, _, h, *_ in _anchors_of(b.column(0).cast(pa.binary()).to_pylist())]
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    twice = materialize(spark, texts.select("text").mapInArrow(count, "h bigint, n bigint")
                        .groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "minimizers")
    size, total = twice.agg(F.count(F.lit(1)), F.sum("n")).first()
    total = total or 0
    bits = 1 << 16
    while bits < MAX_BITS and bits < 16 * size:
        bits *= 2
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    high = (F.shiftrightunsigned("h", 33) * F.lit(2654435761)).bitwiseAND(F.lit(bits - 1))
    # one row per 64-bit word of the bitmap
    words = (twice.select(F.explode(F.array(low, high)).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow())
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    # crowded minimizers in a bit table of bounded size: one that shares a bit
    # with them goes their way too, which is as exact, and so do all its equals
    many = twice.where(F.col("n") > hot)
    n_many, crowd_bits = many.count(), 1 << 12
    while crowd_bits < CROWD_BITS and crowd_bits < 64 * n_many:
        crowd_bits *= 2
    place = F.col("h").bitwiseAND(F.lit(crowd_bits - 1))
    words = (many.groupBy(F.shiftright(place, 6).alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & {crowd_bits - 1} & 63 as int))")).alias("set"))
             .toArrow())
    crowded = np.zeros(crowd_bits // 64, np.uint64)
    crowded[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((bitmap, crowded))

    def passing(batches: Iterator):
        """Anchors that may repeat, a buffer at a time."""
        bitmap, crowded = shared.value
        for b in batches:
            tkeys, firsts = b.column("tkey").to_pylist(), b.column("first")
            for x, doc, shift, h, place, lo, hi in _anchors_of(
                    b.column("text").cast(pa.binary()).to_pylist()):
                p, q = _bits(h, bits)
                at = np.flatnonzero(
                    (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))
                     & bitmap[(q >> np.uint64(6)).astype(np.int64)] >> (q & np.uint64(63))
                     & np.uint64(1)).astype(bool))
                c = h[at] & np.uint64(crowd_bits - 1)
                is_hot = (crowded[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))
                          & np.uint64(1)).astype(bool)
                yield (x, tkeys, firsts, doc, shift, h, place, lo, hi, at, is_hot)

    def cut(batches: Iterator) -> Iterator:
        for x, tkeys, firsts, doc, shift, h, place, lo, hi, at, is_hot in passing(batches):
            at = at[~is_hot]
            if len(at):
                raw = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), firsts.take(pa.array(doc[at])),
                     pa.array([tkeys[d] for d in doc[at]], pa.binary()), pa.array(lo[at] + shift[at]),
                     pa.array((place - lo)[at].astype(np.int32)),
                     pa.array([raw[s:e + LENGTH] for s, e in zip(lo[at], hi[at])], pa.binary())],
                    names=["h", "first", "tkey", "lo", "off", "seg"])

    def by_minimizer(batches: Iterator) -> Iterator[pa.Table]:
        """Rows sorted by minimizer, in runs of whole minimizers of bounded size
        (a run is ``TASK_SEGMENTS`` rows and at most one minimizer's more)."""
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b])
            held = own if held is None else pa.concat_tables([held, own])
            if len(held) >= TASK_SEGMENTS:
                h = held.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))             # the last one may go on
                if cut:
                    yield held.slice(0, cut)
                    held = held.slice(cut)
        if held is not None:
            yield held

    def solve(batches: Iterator) -> Iterator:
        for t in by_minimizer(batches):
            yield from solve_run(t)

    def solve_run(t: pa.Table) -> Iterator:
        h = t.column("h").to_numpy().view(np.uint64)
        # bitmap errors and sole occurrences end here
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        t = t.take(pa.array(np.flatnonzero(n[inverse] > 1)))
        if not len(t):
            return
        h, lo = t.column("h").to_numpy().view(np.uint64), t.column("lo").to_numpy()
        off, seg = t.column("off").to_numpy().astype(np.int64), t.column("seg").to_pylist()
        tkey = np.array(t.column("tkey").to_pylist(), dtype="S16")
        place = pa.compute.sort_indices(t.select(["first", "tkey", "lo"]), sort_keys=[
            ("first", "ascending"), ("tkey", "ascending"), ("lo", "ascending")],
            null_placement="at_start").to_numpy()
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        row, s, e = repeats(h, off, rank, seg)
        if len(row):
            _, owner = np.unique(tkey, return_inverse=True)
            one = np.zeros(int(owner.max()) + 1, np.int64)
            one[owner] = np.arange(len(owner))
            who, s, e = merge(owner[row], lo[row] + s, lo[row] + e)
            yield pa.RecordBatch.from_arrays(
                [t.column("tkey").combine_chunks().take(pa.array(one[who])), pa.array(s), pa.array(e)],
                names=["tkey", "s", "e"])

    import pyarrow.compute  # noqa: F401  (used in solve)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_ROWS) + 1)
    table = texts.select("tkey", "first", "text")
    found = (table.mapInArrow(cut, f"h bigint, first {order_type}, tkey binary, lo bigint, off int, seg binary")
             .repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(solve, "tkey binary, s bigint, e bigint"))
    if n_many:
        def windows(batches: Iterator) -> Iterator:
            """Distinct windows of each text (``e`` is null), and the ranges of
            their further occurrences in the same text, which are repeats as it is."""
            for x, tkeys, firsts, doc, shift, h, place, lo, hi, at, is_hot in passing(batches):
                at = at[is_hot]
                if not len(at):
                    continue
                n = hi[at] - lo[at] + 1
                one = np.repeat(at, n)
                p = lo[one] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                w1, w2 = _roll(x, LENGTH, _BYTE)[p], _roll(x, LENGTH, _BYTE2)[p]
                new, again = _first_windows(x, doc[one], p, w1, w2)
                own, s, e = merge(doc[one[again]], p[again] + shift[one[again]],
                                  p[again] + shift[one[again]] + LENGTH)
                none = pa.nulls(len(own), pa.int64())
                for d, columns in ((doc[one[new]], [
                        pa.array(w1[new].view(np.int64)), pa.array(w2[new].view(np.int64)),
                        pa.array(p[new] + shift[one[new]]), pa.nulls(len(new), pa.int64())]),
                        (own, [none, none, pa.array(s), pa.array(e)])):
                    yield pa.RecordBatch.from_arrays(
                        [*columns, firsts.take(pa.array(d)), pa.array([tkeys[k] for k in d], pa.binary())],
                        names=["w1", "w2", "s", "e", "first", "tkey"])

        every = table.mapInArrow(
            windows, f"w1 bigint, w2 bigint, s bigint, e bigint, first {order_type}, tkey binary")
        each = every.where("e is null").select("w1", "w2", "tkey", "s", F.struct(
            F.col("first").isNotNull().alias("some"), "first", "tkey", "s").alias("at"))
        # written, so that a very common window's rows can be split in the join
        least = materialize(spark, each.groupBy("w1", "w2").agg(
            F.min("at").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "windows")
        found = (found.union(each.join(least, ["w1", "w2"]).where("at > least").select(
            "tkey", "s", (F.col("s") + LENGTH).alias("e")))
            .union(every.where("e is not null").select("tkey", "s", "e")))
    return found


@arrow_udf(T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_spans", T.LongType())]))
def _cut(texts: pa.Array, found: pa.Array) -> pa.Array:
    kept, n = [], []
    for t, f in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist()):
        at, parts, count = 0, [], 0
        for x in sorted(f or (), key=lambda x: (x["s"], x["e"])):
            if x["s"] > at or not count:
                parts.append(t[at:x["s"]])
                count += 1
            at = max(at, x["e"])
        kept.append(b"".join([*parts, t[at:]]))
        n.append(count)
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(n, pa.int64())],
                                      names=["kept", "n_spans"])


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (tkey, first, text, kept, n_spans) with the bytes
    that are kept of a text's first copy, and the documents (key, tkey, n_bytes,
    is_first), one row per input row."""
    small_batches(docs.sparkSession, 256)
    texts = distinct_texts(docs, key, text)
    ranges = spans(texts, hot=hot).groupBy("tkey").agg(
        F.collect_list(F.struct("s", "e")).alias("spans"))      # at most the text's windows
    cut = texts.join(ranges, "tkey", "left").withColumn("cut", _cut(F.col("text"), F.col("spans")))
    cut = cut.select("tkey", "first", "text", "cut.kept", "cut.n_spans")
    t = text_or_empty(text)
    rows = (docs.select(F.col(key).alias("key"), F.unhex(F.md5(t)).alias("tkey"),
                        F.octet_length(t).cast("bigint").alias("n_bytes"))
            .groupBy("key", "tkey").agg(F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
            .select("key", "tkey", "n_bytes", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))
                    .alias("copy")))
    return cut, rows
