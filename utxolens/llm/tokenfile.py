"""Token ids in Arrow files of equal-length sequences.

Documents are dealt by range over (key, text hash, row number), so a file holds
a run of documents in key order and equal keys spread over files. Each task
encodes its documents one after the other into a stream of ids, cuts it into
sequences of ``length`` ids and writes them as record batches of two
fixed-size-list columns, ``ids`` (uint16 where the vocabulary fits, else int32)
and ``mask`` (one bit: set for an id, clear for the fill at the end of the
file). The file format has a footer, so a mapped file gives any sequence by
number without copying.

A file is written under a name of its own per attempt and moved into place
only when complete; the index rows that the successful attempt returns name
the files that count, so a repeated or lost task leaves nothing that is read.
Files go through ``pyarrow.fs`` to the shared folder of ``spark.checkpoint.dir``.

Edge cases: a null text has the end id only; a null key sorts first; repeated
rows are written each; a text of any length is encoded whole; an empty table
writes no file and an empty index; other columns take no part, whatever their
names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import materialize, small_batches, text_or_empty
from .pieces import Memo, splitter, tokenizer_path

LENGTH = 2048             # ids of a sequence
BATCH = 64                # sequences of a record batch
MEMO = 1_000_000            # words a task remembers the ids of


def id_type(size: int) -> str:
    """The narrowest kind of integer for a vocabulary of ``size`` ids."""
    return "<u2" if size <= 1 << 16 else "<i4"


def schema(length: int, dtype: str) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), length)),
                      pa.field("mask", pa.list_(pa.bool_(), length))])


def open_fs(uri: str):
    """File system and path of a shared folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences to one file."""

    def __init__(self, folder: str, name: str, dtype: str, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.folder = open_fs(folder)
        self.name, self.length, self.size = name, length, length * batch
        self.schema = schema(length, dtype)
        self.fs.create_dir(self.folder, recursive=True)
        self.part = f"{self.folder}/_{name}"
        self.sink = self.fs.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0                                      # ids held

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
            schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.size:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.size * self.size
            for i in range(0, whole, self.size):
                self._write(flat[i:i + self.size], self.size)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            fill = -len(flat) % self.length
            self._write(np.concatenate([flat, np.zeros(fill, flat.dtype)]), len(flat))
        self.out.close()
        self.sink.close()
        self.fs.move(self.part, f"{self.folder}/{self.name}")


class SequenceReader:
    """Random access to a file's ids; zero-copy views of a mapped local file."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        system, path = open_fs(folder)
        path = f"{path}/{name}"
        source = (pa.memory_map(path) if isinstance(system, fs.LocalFileSystem)
                  else system.open_input_file(path))
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches: dict[int, tuple[np.ndarray, pa.BooleanArray]] = {}
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.size = first * self.length                 # ids of every batch but the last

    def _batch(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if i not in self.batches:
            if len(self.batches) > 4:
                self.batches.clear()
            ids, mask = (c.flatten() for c in self.file.get_batch(i).columns)
            self.batches[i] = ids.to_numpy(zero_copy_only=True), mask
        return self.batches[i]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``."""
        b, at = divmod(i * self.length, self.size)
        ids, mask = self._batch(b)
        return ids[at:at + self.length], mask.slice(at, self.length)

    def ids(self, start: int, n: int) -> list[np.ndarray]:
        """Views of ``n`` ids from ``start``, one per record batch they lie in."""
        out = []
        while n > 0:
            b, at = divmod(start, self.size)
            ids, mask = self._batch(b)
            take = ids[at:at + n]
            if not len(take) or not mask[at + len(take) - 1].as_py():
                raise ValueError("ids beyond the end of the file")
            out.append(take)
            start, n = start + len(take), n - len(take)
        return out


def write(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text",
          end_id: int = 1, length: int = LENGTH, folder: str | None = None
          ) -> tuple[str, DataFrame]:
    """Writes the texts' ids, each followed by ``end_id``, in ascending key
    order. Returns the folder and the index: key, file, part (number of the
    file), at (first id in the file), n_tokens, start (ids of all documents
    before this one)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/utxolens/tokens-{uuid.uuid4().hex}"
    t = text_or_empty(text)
    dealt = (docs.select(F.col(key).alias("key"), t.alias("text"), F.xxhash64(t).alias("h"))
             .withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange("key", "h", "row").sortWithinPartitions("key", "h", "row")
             .select("key", "text"))
    kind = dict(dealt.dtypes)["key"]

    def put(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        split = splitter(path)
        dtype = id_type(max(end_id + 1, split.tok.get_vocab_size(with_added_tokens=True)))
        memo = Memo(split, dtype, most=MEMO)
        end = np.array([end_id], dtype)
        context = TaskContext.get()
        part, out, at = context.partitionId(), None, 0
        name = f"part-{part:05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
        for b in batches:
            lengths = []
            for text in b.column("text").to_pylist():
                words = split.words(text)
                ids = (np.array(split.whole(text), dtype) if words is None
                       else np.frombuffer(memo.encode(words), dtype))
                out = out or SequenceWriter(folder, name, dtype, length)
                out.add(ids)
                out.add(end)
                lengths.append(len(ids) + 1)
            if not lengths:
                continue
            n = np.array(lengths, np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([name] * len(n)), pa.array(np.full(len(n), part, np.int64)),
                 pa.array(first), pa.array(n)], names=["key", "file", "part", "at", "n_tokens"])
        if out:
            out.close()

    index = materialize(spark, dealt.mapInArrow(
        put, f"key {kind}, file string, part bigint, at bigint, n_tokens bigint"), "token_index")
    # one row per file; files are numbered in key order
    starts = (index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
              .withColumn("base", F.sum("n").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
                  - F.col("n")).select("part", "base"))
    return folder, index.join(F.broadcast(starts), "part").withColumn(
        "start", F.col("base") + F.col("at")).select(
        F.col("key").alias(key), "file", "part", "at", "n_tokens", "start")


def read_digests(index: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document of the index, its ids read back from the files: adds
    ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers. The
    index lies as the files do, so a task opens few files."""
    kind = dict(index.dtypes)[key]

    def check(batches: Iterator) -> Iterator:
        from zlib import crc32

        reader, name = None, None
        for b in batches:
            crcs = []
            for f, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
                if f != name:
                    reader, name = SequenceReader(folder, f), f
                crc = 0
                for view in reader.ids(at, n):
                    crc = crc32(view.astype("<u4").tobytes(), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc", "start", "n_tokens")), pa.array(crcs, pa.int64())],
                names=["doc", "start", "n_tokens", "ids_crc32"])

    return (index.select(F.col(key).alias("doc"), "file", "at", "n_tokens", "start")
            .mapInArrow(check, f"doc {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
            .withColumnRenamed("doc", key))


def default_path() -> str:
    return tokenizer_path("word_bpe_49k.json")
