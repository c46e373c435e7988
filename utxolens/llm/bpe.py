"""BPE encoding through a distinct-word table, and decoding through pieces.

``distinct_words`` splits every text into words and sums their counts (each
task adds up its own words first); ``word_table`` encodes each distinct word
once and is written to the shared folder. ``encode`` then splits the texts
again and puts each word's ids at its place. The table grows with the corpus,
so it is joined in two parts: the most frequent words (at most ``HOT_WORDS``
of at most ``HOT_CHARS`` characters, whatever their counts) are broadcast and
joined in the tasks; a word outside of them is rare and is encoded in the task
that meets it, once as long as its bounded memo lasts. This departs from the
method, by which each word is encoded once and ids go back by position: sending
the rare words' ids through a shuffle would move every text or every id once
more (README has the figures).

``decode`` looks each id up in the table of the vocabulary's pieces (fixed
size, made in the task from the vocabulary file) and decodes the bytes as the
library does; that table is a part of the tokenizer, so no shuffle is needed.
``digests`` does all of it in one pass of a task: ids, their digest, the decoded
text and its digest, so that a task has one Python worker.

Edge cases: a null text is empty and has no ids; a text holding an added
token's string gives that token; repeated rows are encoded each; an empty table
gives an empty table; other columns stay, one named like an added column goes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import arrow_rows, materialize, text_or_empty
from .pieces import Memo, byte_chars, splitter, tokenizer_path

HOT_WORDS = 300_000       # most words that are broadcast
HOT_CHARS = 32            # longest word that is broadcast
FLUSH_WORDS = 300_000     # distinct words a task adds up before it hands them on


def distinct_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n): every distinct word of the texts and how often it stands."""
    def count(batches: Iterator) -> Iterator:
        split, seen = splitter(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                names=["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split.pieces(t))
                if len(seen) >= FLUSH_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return (docs.select(text_or_empty(text).alias("t")).mapInArrow(count, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) with each distinct word encoded once."""
    def encode(batches: Iterator) -> Iterator:
        split = splitter(path)
        for b in batches:
            ids = [split.ids(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return materialize(words.sparkSession, words.select("word", "n").mapInArrow(
        encode, "word string, n bigint, ids array<int>"), "words")


def _rank(n: Column) -> Column:
    """A number that grows with a count and has few values: the count itself up
    to 100,000, beyond it its logarithm in steps of a hundredth of a percent."""
    return F.when(n <= 100_000, n).otherwise(
        F.lit(100_000) + F.floor((F.log(n.cast("double")) - float(np.log(100_000))) * 10_000)).cast("bigint")


def hot_words(table: DataFrame, most: int = HOT_WORDS, chars: int = HOT_CHARS) -> DataFrame:
    """The most frequent words of the table, never more than ``most``: words
    of like counts come together or not at all."""
    short = table.where(F.length("word") <= chars)
    # how many words stand how often: few rows, as counts repeat
    steps = short.groupBy(_rank(F.col("n")).alias("rank")).count().collect()
    least, total = None, 0
    for r in sorted(steps, key=lambda r: -r.rank):
        total += r["count"]
        if total > most:
            break
        least = r.rank
    return short.where(F.lit(False) if least is None else _rank(F.col("n")) >= least)


class _Known:
    """The hot words' table for the tasks; a Python worker unpacks it once."""

    _of: dict[int, dict[str, bytes]] = {}          # of this worker, by broadcast

    def __init__(self, words: DataFrame, path: str, hot: int):
        top = hot_words(words, hot).select("word", "ids").toArrow()      # at most ``hot`` rows
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, top.schema) as w:
            w.write_table(top)
        self.path = path
        self.shared = words.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        self.name = id(self.shared), path

    def memo(self) -> Memo:
        found = _Known._of.get(self.name)
        if found is None:
            _Known._of.clear()                     # a worker serves one table at a time
            t = pa.ipc.open_stream(self.shared.value).read_all().combine_chunks()
            start: dict[str, bytes] = {}
            if len(t):
                ids = t.column("ids").chunk(0)
                ends = ids.offsets.to_numpy().astype(np.int64) * 4
                raw = ids.values.to_numpy().astype("<i4", copy=False).tobytes()
                start = {w: raw[s:e] for w, s, e in zip(t.column("word").to_pylist(),
                                                        ends.tolist(), ends[1:].tolist())}
            _Known._of[self.name] = found = Memo(splitter(self.path), "<i4", start)
        return found


def _known_words(docs: DataFrame, path: str, text: str, hot: int) -> _Known:
    spark = docs.sparkSession
    with arrow_rows(spark):
        return _Known(word_table(distinct_words(docs, path, text), path), path, hot)


def encode(docs: DataFrame, path: str, *, text: str = "text", out: str = "ids",
           hot: int = HOT_WORDS) -> DataFrame:
    """Documents with their token ids (array<int>) as a further column."""
    known = _known_words(docs, path, text, hot)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = known.memo()
        for texts in batches:
            got = [m.encode(m.split.pieces(t.as_py())) for t in texts]
            ends = np.cumsum([0, *(len(g) // 4 for g in got)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(
                b"".join(got), "<i4")))

    return docs.withColumn(out, ids_of(text_or_empty(text)))


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str, keep: list[str], *, text: str = "text",
            hot: int = HOT_WORDS) -> DataFrame:
    """The columns ``keep`` of the documents and the struct ``digest``: how many
    ids a text has, their hex SHA-256 as little-endian unsigned 32-bit integers,
    and that of the text that they decode to. Small, so it is written, which
    keeps the batches of texts short without a change to the session."""
    known = _known_words(docs, path, text, hot)

    @arrow_udf(DIGESTS)
    def digest_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from hashlib import sha256

        m, get = known.memo(), _pieces(path).__getitem__
        for texts in batches:
            n, of_ids, of_text = [], [], []
            for t in texts:
                raw = m.encode(m.split.pieces(t.as_py()))
                ids = np.frombuffer(raw, "<i4")
                back = b"".join(map(get, ids.tolist())).decode("utf-8", "replace")
                n.append(len(ids))
                of_ids.append(sha256(raw).hexdigest())
                of_text.append(sha256(back.encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[f.name for f in DIGESTS])

    with arrow_rows(docs.sparkSession):
        return materialize(docs.sparkSession, docs.select(
            *[F.col(f"`{c}`") for c in keep], digest_of(text_or_empty(text)).alias("digest")), "digests")


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    """Bytes of each id's piece in a byte-level vocabulary."""
    to_byte = {c: b for b, c in enumerate(byte_chars())}
    tok = splitter(path).tok
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        piece = tok.id_to_token(i) or ""
        out.append(bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece)
                   else piece.encode())
    return out


def decode(ids: str, path: str) -> Column:
    """Text of a column of ids, special tokens included."""
    @arrow_udf(T.StringType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = _pieces(path).__getitem__
        for b in batches:
            flat, ends = b.values.to_numpy(), b.offsets.to_numpy()
            yield pa.array([b"".join(map(get, flat[s:e].tolist())).decode("utf-8", "replace")
                            for s, e in zip(ends, ends[1:])], pa.string())

    return text_of(F.coalesce(F.col(ids), F.array().cast("array<int>")))


def default_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")
