"""Phrase collocation mining with exact n-gram counters.

1. ``word_counts``: every word's occurrences per language (each task adds up
   its own first). Only words that stand ``least`` times can be part of a
   candidate; ``vocabulary`` gives those dense ids, most frequent first.
2. ``word_ids``: texts become sequences of ids; 0 stands for a piece's end and
   for any other word. Tasks know the ``HOT_WORDS`` first words of at most
   ``HOT_BYTES`` bytes (broadcast, so of bounded size); if the vocabulary has
   others, each text gets the ids of its own ones through a join.
3. ``count_ngrams``: tasks count in counting quotient filters (``quotient``),
   sent by shard of the quotient and merged there. Pairs first: a longer
   candidate's pairs must be frequent too, so a bit table of fixed size over
   the frequent pairs lets tasks leave out most longer n-grams. The table can
   only let too many pass, so counts of candidates stay exact at any size.
4. ``collocations``: scores by the lowest cut, candidates within a longer one
   dropped, and the first ones of each language.

Arithmetic on counts runs on decimals that hold any product.

Edge cases: a null language is ``und``; null, blank and delimiter-only texts
have no words; repeated rows count each; a text of any length is worked on in
bounded slices cut at piece ends (a piece itself is held whole); an empty table
gives an empty table; other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quotient
from .common import materialize

LEAST = 30                # occurrences of a candidate
LONGEST = 4               # words of the longest phrase
TOP = 2000                # phrases returned per language
INSIDE = 80               # a longer candidate this often (in hundredths) swallows a shorter one
FACTOR = 2_000_000        # scores are floor(FACTOR * a / (l + r))
HOT_WORDS = 200_000       # most words that are broadcast
HOT_BYTES = 64            # longest word that is broadcast
FLUSH_WORDS = 300_000     # distinct words a task adds up before it hands them on
SLICE = 2_000_000         # bytes of text worked on at once
PER_SHARD = 2_000_000     # words of the corpus per shard of the merge
PASS_BITS = 26            # the bit table of frequent pairs has 2^26 bits

# lower case for A-Z, one delimiter for all, one blank for both
_CLEAN = bytes.maketrans(
    bytes(range(65, 91)) + b",;:!?\n\v\f\r\t", bytes(range(97, 123)) + b"." * 9 + b" ")


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Tokens of texts, a ``.`` at the end of each piece, in bounded slices."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        t = t.translate(_CLEAN)
        at = 0
        while len(t) - at > SLICE:                # a long text: cut at a piece's end
            cut = t.rfind(b".", at, at + SLICE)
            cut = cut if cut >= 0 else t.find(b".", at + SLICE)
            if cut < 0:
                break
            yield t[at:cut + 1].replace(b".", b" . ").split()
            at = cut + 1
        held.append(t[at:] if at else t)
        size += len(held[-1])
        if size >= SLICE:
            yield b".".join([*held, b""]).replace(b".", b" . ").split()
            held, size = [], 0
    if held:
        yield b".".join([*held, b""]).replace(b".", b" . ").split()


def _by_lang(b: pa.RecordBatch) -> dict[str, list[int]]:
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(b.column("lang").to_pylist()):
        rows.setdefault(lang, []).append(i)
    return rows


def _texts(docs: DataFrame, text: str, lang: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), *more)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Tally] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                words.pop(b".", None)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(words), pa.string()),
                     "word": pa.array(list(words), pa.binary()).cast(pa.string()),
                     "n": pa.array(list(words.values()), pa.int64())})
            seen.clear()

        for b in batches:
            raw = b.column("text").cast(pa.binary())
            for lang, rows in _by_lang(b).items():
                for tokens in _slices([raw[i].as_py() for i in rows]):
                    seen.setdefault(lang, Tally()).update(tokens)
                    if sum(map(len, seen.values())) >= FLUSH_WORDS:
                        yield from out()
        yield from out()

    return (texts.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def vocabulary(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, lang, word, n): words that stand ``least`` times, numbered from 1,
    most frequent first. Sorted by range; each range's size gives the next
    one's first number."""
    spark = words.sparkSession
    sort = [F.desc("n"), "lang", "word"]
    ranged = (words.where(F.col("n") >= least).repartitionByRange(*sort).sortWithinPartitions(*sort)
              .select(F.spark_partition_id().alias("part"),
                      F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"),
                      "lang", "word", "n"))
    ranged = materialize(spark, ranged, "vocabulary")
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())
    starts, total = [], 1
    for part, n in sizes:                         # one row per range of the sort
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "part int, first bigint")
    return ranged.join(F.broadcast(first), "part").select(
        (F.col("first") + F.col("at")).alias("id"), "lang", "word", "n")


def _encoder(known: bytes):
    """Ids by language and word of the broadcast words."""
    ids: dict[str, dict[bytes, int]] = {}
    t = pa.ipc.open_stream(known).read_all()
    for lang, word, i in zip(t.column("lang").to_pylist(),
                             t.column("word").cast(pa.binary()).to_pylist(), t.column("id").to_pylist()):
        ids.setdefault(lang, {})[word] = i
    return ids


def word_ids(texts: DataFrame, words: DataFrame, hot: int = HOT_WORDS) -> DataFrame:
    """(ids array<bigint>): all texts as sequences of word ids. A row is a slice
    of the texts of one language and ends with 0; which texts share a row has
    no meaning, as phrases end with their piece."""
    spark = texts.sparkSession
    is_hot = (F.col("id") <= hot) & (F.octet_length("word") <= HOT_BYTES)
    top = words.where(is_hot).select("lang", "word", "id").toArrow()   # at most ``hot`` short words
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as w:
        w.write_table(top)
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    memo: dict[int, dict] = {}

    def ids_of() -> dict:
        if not memo:
            memo[0] = _encoder(known.value)
        return memo[0]

    rest = words.where(~is_hot)
    if rest.isEmpty():
        texts = texts.select("lang", "text", F.lit(None).cast("array<struct<word:binary,id:bigint>>")
                             .alias("own"))
    else:
        texts = materialize(spark, texts.select(F.monotonically_increasing_id().alias("row"), "lang", "text"),
                            "texts")

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = b.column("text").cast(pa.binary())
                langs = b.column("lang").to_pylist()
                for i, row in enumerate(b.column("row").to_pylist()):
                    own = ids_of().get(langs[i], {})
                    far: set[bytes] = set()
                    for tokens in _slices([raw[i].as_py()]):
                        far.update(t for t in set(tokens) if t not in own)
                    far.discard(b".")
                    if far:
                        yield pa.RecordBatch.from_pydict(
                            {"row": pa.array([row] * len(far), pa.int64()),
                             "lang": pa.array([langs[i]] * len(far), pa.string()),
                             "word": pa.array(list(far), pa.binary()).cast(pa.string())})

        # the distinct rare words of a text, at most as many as it has words
        found = (texts.mapInArrow(others, "row bigint, lang string, word string")
                 .join(rest.select("lang", "word", "id"), ["lang", "word"])
                 .groupBy("row").agg(F.collect_list(F.struct(
                     F.col("word").cast("binary").alias("word"), "id")).alias("own")))
        texts = texts.join(found, "row", "left").select("lang", "text", "own")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("text").cast(pa.binary())
            own = b.column("own").to_pylist()
            for lang, rows in _by_lang(b).items():
                ids = ids_of().get(lang, {})
                groups = [([raw[i].as_py() for i in rows if own[i] is None], ids)]
                for i in rows:
                    if own[i] is not None:
                        more = {bytes(x["word"]): x["id"] for x in own[i]}
                        groups.append(([raw[i].as_py()], _Either(ids, more)))
                for part, table in groups:
                    for tokens in _slices(part) if part else ():
                        get = table.get
                        seq = np.array([get(t, 0) for t in tokens] + [0], np.int64)
                        # a word between two stops is in no phrase
                        alone = (seq[1:-1] > 0) & (seq[:-2] == 0) & (seq[2:] == 0)
                        seq[1:-1][alone] = 0
                        keep = np.concatenate([[True], (seq[1:] > 0) | (seq[:-1] > 0)])
                        seq = seq[keep]
                        yield pa.RecordBatch.from_arrays(
                            [pa.ListArray.from_arrays(pa.array([0, len(seq)], pa.int32()), pa.array(seq))],
                            names=["ids"])

    return texts.mapInArrow(encode, "ids array<bigint>")


class _Either:
    def __init__(self, ids: dict, more: dict):
        self.ids, self.more = ids, more

    def get(self, word: bytes, default: int) -> int:
        return self.ids.get(word) or self.more.get(word, default)


def _pass_bit(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of a pair in the bit table."""
    x = (first.astype(np.uint64) << np.uint64(32)) ^ second.astype(np.uint64)
    return (quotient.mix(x) >> np.uint64(64 - PASS_BITS)).astype(np.int64)


def count_ngrams(ids: DataFrame, sizes: tuple[int, ...], bits: int, shard_bits: int, least: int,
                 passing: bytes | None = None) -> DataFrame:
    """(words array<bigint>, a): n-grams of the ``sizes`` that stand ``least``
    times, exact. With ``passing``, those holding a pair whose bit is not set
    are left out (none of them is a candidate)."""
    known = ids.sparkSession.sparkContext.broadcast(passing) if passing is not None else None
    schema = pa.schema([("n", pa.int32()), ("shard", pa.int64()), ("filter", pa.binary())])

    def cut(n: int) -> int:
        return min(shard_bits, quotient.Shape(n, bits).left)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {n: quotient.Counter(quotient.Shape(n, bits), cut(n)) for n in sizes}
        table = np.unpackbits(np.frombuffer(known.value, np.uint8), bitorder="little").view(bool) \
            if known is not None else None

        def rows(n: int, found) -> Iterator[pa.RecordBatch]:
            for shard, blob in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), pa.array([shard], pa.int64()), pa.array([blob], pa.binary())],
                    schema=schema)

        for b in batches:
            for one in b.column("ids"):
                seq = one.values.to_numpy()
                ok = (seq[:-1] > 0) & (seq[1:] > 0)
                if table is not None:
                    at = np.flatnonzero(ok)
                    ok[at] = table[_pass_bit(seq[at], seq[at + 1])]
                for n, counter in counters.items():
                    if len(seq) < n:
                        continue
                    whole = ok[:len(seq) - n + 1].copy()
                    for j in range(1, n - 1):
                        whole &= ok[j:len(seq) - n + 1 + j]
                    at = np.flatnonzero(whole)
                    yield from rows(n, counter.add([seq[at + j] for j in range(n)]))
        for n, counter in counters.items():
            yield from rows(n, counter.filters())

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, shard = key[0].as_py(), key[1].as_py()
        shape = quotient.Shape(n, bits)
        total, parts, held = None, [], 0
        for b in batches:
            for blob in b.column("filter").to_pylist():
                parts.append(quotient.from_filter(shape, blob, shard, cut(n)))
                held += len(parts[-1])
                if held >= 500_000:
                    total, parts, held = quotient.merge(shape, parts + ([total] if total else [])), [], 0
        c = quotient.merge(shape, parts + ([total] if total else []))
        often = c.count >= least
        columns = shape.unpack(c.left[often], c.right[often])
        flat = np.stack(columns, axis=1).ravel() if len(columns[0]) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat)),
             pa.array(c.count[often])], names=["words", "a"])

    return ids.mapInArrow(count, "n int, shard bigint, filter binary").groupBy("n", "shard").applyInArrow(
        merged, "words array<bigint>, a bigint")


def passing_pairs(pairs: DataFrame) -> bytes:
    """The bit table of frequent pairs: 2^PASS_BITS bits whatever their number."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("words").flatten().to_numpy().reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"bit": pa.array(_pass_bit(w[:, 0], w[:, 1]))})

    span = 32768                                  # bits of one Spark bitmap
    rows = (pairs.select("words").mapInArrow(places, "bit bigint")
            .groupBy((F.col("bit") / span).cast("bigint").alias("block"))
            .agg(F.bitmap_construct_agg(F.col("bit") % span).alias("bits")).collect())
    table = bytearray(2 ** PASS_BITS // 8)
    for r in rows:                                # at most 2^PASS_BITS / span rows of 4 KB
        table[r.block * span // 8:(r.block + 1) * span // 8] = r.bits
    return bytes(table)


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def scores(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(words, a, l, r, score): each candidate's lowest-scoring cut."""
    parts = grams.select(F.col("words").alias("part"), F.col("a").alias("f")).unionAll(
        words.select(F.array("id").alias("part"), F.col("n").alias("f")))
    n = F.size("words")
    cuts = grams.select("words", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    sides = cuts.select("words", "a", "k", F.posexplode(F.array(
        F.slice("words", F.lit(1), F.col("k")),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))).alias("side", "part"))
    both = sides.join(parts, "part").groupBy("words", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"),
        F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"cast((cast(a as decimal(19,0)) * cast({FACTOR} as decimal(7,0))) div "
                   "(cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    return (both.withColumn("score", score).groupBy("words", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
            .select("words", "a", "low.l", "low.r", "low.score"))


def swallowed(grams: DataFrame) -> DataFrame:
    """(words, longer): for each phrase within a candidate, the most frequent
    of the longer candidates that hold it."""
    n = F.size("words")
    places = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda s: F.slice("words", s, k))))
    return (grams.where(n >= 3).select(F.explode(places).alias("words"), "a")
            .groupBy("words").agg(F.max("a").alias("longer")))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", *, least: int = LEAST,
                 top: int = TOP, hot: int = HOT_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases."""
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    all_words = materialize(spark, word_counts(texts), "words")
    words = materialize(spark, vocabulary(all_words, least), "vocabulary_ids")
    size = words.agg(F.max("id")).first()[0] or 1
    total = all_words.agg(F.sum("n")).first()[0] or 1
    bits = int(size).bit_length()
    shard_bits = max(3, (total // PER_SHARD).bit_length())
    ids = materialize(spark, word_ids(texts, words, hot), "ids")
    pairs = materialize(spark, count_ngrams(ids, (2,), bits, shard_bits, least), "pairs")
    longer = count_ngrams(ids, tuple(range(3, LONGEST + 1)), bits, shard_bits, least, passing_pairs(pairs))
    grams = materialize(spark, pairs.unionAll(longer), "ngrams")

    kept = (scores(grams, words).join(swallowed(grams), "words", "left")
            .where(F.col("longer").isNull()
                   | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * INSIDE)).drop("longer"))
    placed = kept.join(words.select(F.col("id").alias("_first"), "lang"),
                       F.col("words")[0] == F.col("_first")).drop("_first")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = placed.withColumn("place", F.rank().over(order)).where(F.col("place") <= top)
    spelt = (near.select("*", F.posexplode("words").alias("at", "id"))
             .join(words.select("id", "word"), "id")
             .groupBy("lang", "words", "a", "l", "r", "score")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))),
                                           lambda x: x["word"]), " ").alias("phrase")))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = spelt.withColumn("rank", F.row_number().over(last).cast("bigint")).where(F.col("rank") <= top)
    totals = all_words.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
