"""``blockfile``: a Spark data source over raw block files, split by bytes.

    spark.dataSource.register(BlockFileSource)
    spark.read.format("blockfile").option("splitBytes", "67108864").load(path)

A partition is a set of byte ranges (file, start, end); small files share one.
A task reads its range in chunks, finds record markers, decodes what they head
and reads the last record past its range's end, so it holds a chunk and a block.
Small blocks that follow each other are decoded together (``blockrun``).

Which records count does not depend on the ranges. A record is *whole* if a
marker, a plausible size and a block that decodes (with ``verify``: and hashes
to its own roots) follow each other. A whole record counts unless it starts
inside another one that counts: markers within a block's scripts head nothing.
So a task has to know where the record ends that covers its first byte. It
looks back over as many bytes as the longest block may have, tries those
records alone that would reach over its start, and asks the same question for
the one that does; in undamaged files that is one block decoded twice.

Options: ``magic`` (hex), ``splitBytes``, ``maxBlock``, ``blocksPerBatch``,
``onDamage`` (``fail`` or ``skip``), ``verify`` (``true`` or ``false``),
``rows`` (``blocks`` or ``rejected``: pieces of byte ranges that hold no block).
Paths are local or any that Arrow's file systems open on all executors; for
others ``read_block_files(whole_files=True)`` reads whole files through Spark.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blockfile import (BLOCK_FILE_ROWS, MAINNET_MAGIC, MAX_BLOCK, SPLIT_BYTES, Block, DamagedBlock,
                        DamagedBlockFile, batches_of, parse_block)
from .blockrun import decode_run

CHUNK = 4 << 20           # bytes read at once
HEAD = 8                  # marker and size of a record
HEADER = 80               # least size of a block
SMALL = 16 << 10          # longest block that is decoded together with others
RUN = 1024                # most blocks that are decoded together
FEW = 16                  # fewer blocks are decoded one by one

NO_MARKER = "no record magic"
PIECES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("reason", pa.string()), ("damaged", pa.bool_()), ("filled", pa.bool_())])


# --- files -------------------------------------------------------------------

class FileInfo(NamedTuple):
    path: str
    length: int
    modified: int             # milliseconds


def _local(path: str) -> str | None:
    """The local path of a name, None for a remote one."""
    if path.startswith("file:"):
        return unquote("/" + path[5:].lstrip("/"))
    return None if "://" in path else path


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[FileInfo]:
    """Files at a path: a file, a directory (hidden files left out) or a glob."""
    own = _local(path)
    if own is not None:
        if os.path.isdir(own):
            names = [os.path.join(own, n) for n in os.listdir(own) if n[0] not in "._"]
        else:
            names = glob.glob(own) or [own]
        stats = [(n, os.stat(n)) for n in sorted(names) if not os.path.isdir(n)]
        return [FileInfo("file:" + os.path.abspath(n), s.st_size, s.st_mtime_ns // 1_000_000)
                for n, s in stats]
    from fnmatch import fnmatch

    from pyarrow import fs

    folder, name = path, None
    if any(c in path for c in "*?["):
        folder, name = path.rsplit("/", 1)
    system, at = _remote(folder)
    scheme = path.split("://")[0]
    infos = system.get_file_info(fs.FileSelector(at)) if name or system.get_file_info(at).type \
        == fs.FileType.Directory else [system.get_file_info(at)]
    return [FileInfo(f"{scheme}://{i.path.lstrip('/')}" if scheme != "hdfs" else f"{folder.rsplit(at, 1)[0]}{i.path}",
                     i.size, (i.mtime_ns or 0) // 1_000_000)
            for i in sorted(infos, key=lambda i: i.path)
            if i.type == fs.FileType.File and i.base_name[0] not in "._"
            and (name is None or fnmatch(i.base_name, name))]


class ByteFile:
    """Random access by chunks; one chunk is held."""

    def __init__(self, path: str, length: int):
        self.path, self.length = path, length
        own = _local(path)
        if own is not None:
            self.handle = open(own, "rb")
        else:
            system, at = _remote(path)
            self.handle = system.open_input_file(at)
        self.at, self.chunk = 0, b""

    def close(self) -> None:
        self.handle.close()

    def _hold(self, offset: int, n: int) -> int:
        """Have ``n`` bytes from ``offset`` in the chunk; where they begin in it."""
        s = offset - self.at
        if not (0 <= s and s + n <= len(self.chunk)):
            self.handle.seek(offset)
            self.at, self.chunk, s = offset, self.handle.read(max(n, CHUNK)), 0
        return s

    def read(self, offset: int, n: int) -> bytes:
        n = min(n, self.length - offset)
        if n <= 0:
            return b""
        s = self._hold(offset, n)
        return self.chunk[s:s + n]

    def find(self, marker: bytes, start: int, end: int) -> int | None:
        """First place of the marker in [start, end); it may reach past the end.
        Searched in the chunk itself, without a copy."""
        while start < min(end, self.length - len(marker) + 1):
            s = self._hold(start, len(marker))
            at = self.chunk.find(marker, s, end - self.at + len(marker) - 1)
            if at >= 0:
                return self.at + at
            start = max(start, self.at + len(self.chunk) - len(marker)) + 1
        return None

    def filled(self, start: int, end: int) -> bool:
        """Whether there is a byte other than 0 in [start, end)."""
        while start < end:
            part = self.read(start, min(CHUNK, end - start))
            if not part or part.strip(b"\x00"):
                return bool(part)
            start += len(part)
        return False


class HeldFile(ByteFile):
    """A file whose bytes are in memory."""

    def __init__(self, path: str, data: bytes):
        self.path, self.length, self.at, self.chunk = path, len(data), 0, data

    def close(self) -> None:
        self.chunk = b""


# --- records -----------------------------------------------------------------

class Piece(NamedTuple):
    """A byte range without a block; ``damaged`` if it starts at a marker."""

    offset: int
    length: int
    reason: str
    damaged: bool


class Scan:
    """Records of one file."""

    def __init__(self, file: ByteFile, magic: bytes, verify: bool, max_block: int, run: int = 0):
        self.file, self.magic, self.verify, self.max_block = file, magic, verify, max_block
        self.run = run            # most blocks that are decoded together (0: none)

    def extent(self, at: int) -> tuple[int, str | None]:
        """(size, reason why not) of the record whose marker stands at ``at``."""
        head = self.file.read(at, HEAD)
        if len(head) < HEAD:
            return 0, NO_MARKER
        size = int.from_bytes(head[4:], "little")
        if size < HEADER:
            return size, "record shorter than a header"
        if at + HEAD + size > self.file.length:
            return size, "record truncated"
        if size > self.max_block:
            return size, f"record longer than {self.max_block} bytes"
        return size, None

    def block(self, at: int) -> tuple[int, Block | str]:
        """(size, block or reason why not) of the record at a marker."""
        size, reason = self.extent(at)
        if reason is not None:
            return size, reason
        try:
            return size, parse_block(self.file.read(at + HEAD, size), self.verify)
        except DamagedBlock as e:
            return size, f"undecodable block: {e}"

    def covered_to(self, x: int) -> int:
        """End of the record that counts and covers byte ``x`` from before, or ``x``."""
        at = max(0, x - HEAD - self.max_block + 1)
        while (at := self.file.find(self.magic, at, x)) is not None:
            size, reason = self.extent(at)
            if (reason is None and at + HEAD + size > x and not isinstance(self.block(at)[1], str)
                    and self.covered_to(at) == at):
                return at + HEAD + size
            at += 1
        return x

    def together(self, at: int, end: int) -> Iterator[tuple[int, Block] | pa.RecordBatch]:
        """Small records that follow each other from ``at`` on, as far as they
        lie in the held chunk, count and start before ``end``; where they end."""
        f, most = self.file, min(self.max_block, SMALL)
        s = pos = at - f.at
        last, starts, sizes = min(end - f.at, len(f.chunk) - HEAD), [], []
        while 0 <= pos < last and len(sizes) < self.run and f.chunk.startswith(self.magic, pos):
            size = int.from_bytes(f.chunk[pos + 4:pos + HEAD], "little")
            if not HEADER <= size <= most or pos + HEAD + size > len(f.chunk):
                break
            starts.append(pos + HEAD - s)
            sizes.append(size)
            pos += HEAD + size
        if len(sizes) < FEW:
            return at
        buf, done = f.chunk[s:pos], 0
        ok, rows = decode_run(f.path, buf, starts, sizes, self.verify)
        for i in [*np.flatnonzero(~ok).tolist(), len(ok)]:
            plain = i - done
            if plain:
                yield rows.slice(0, plain)
                rows = rows.slice(plain)
            if i == len(ok):
                break
            try:
                yield sizes[i], parse_block(buf[starts[i]:starts[i] + sizes[i]], self.verify)
            except DamagedBlock:
                return at + starts[i] - HEAD
            done = i + 1
        return at + len(buf)

    def range(self, start: int, end: int) -> Iterator[tuple[int, Block] | pa.RecordBatch | Piece]:
        """(size, block) of the records that start in [start, end), or rows of
        many such, and pieces of the bytes there that belong to no record."""
        end = min(end, self.file.length)
        pos = self.covered_to(start) if start else 0
        while pos < end:
            at = self.file.find(self.magic, pos, end)
            if at is None or at > pos:
                yield Piece(pos, (end if at is None else at) - pos, NO_MARKER, False)
                if at is None:
                    return
            pos = yield from self.together(at, end)
            if pos > at:
                continue
            size, found = self.block(at)
            if isinstance(found, Block):
                yield size, found
                pos = at + HEAD + size
            else:
                after = self.file.find(self.magic, at + 1, end)
                pos = end if after is None else after
                yield Piece(at, pos - at, found, found != NO_MARKER)


# --- data source -------------------------------------------------------------

class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(0)
        self.ranges = ranges      # (path, start, end, length of the file)


def plan(files: list[FileInfo], split: int) -> list[Ranges]:
    """Ranges of at most ``split`` bytes; small ones share a partition."""
    out: list[Ranges] = []
    held, size = [], 0
    for f in files:
        for start in range(0, f.length, split):
            end = min(f.length, start + split)
            if held and size + end - start > split:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((f.path, start, end, f.length))
            size += end - start
    return out + ([Ranges(held)] if held else [])


class BlockFileReader(DataSourceReader):
    def __init__(self, named: dict):
        options = {k.lower(): v for k, v in named.items()}
        self.path = options.get("path")           # or several, one a line
        self.magic = bytes.fromhex(options.get("magic", MAINNET_MAGIC.hex()))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.max_block = int(options.get("maxblock", MAX_BLOCK))
        self.per_batch = int(options.get("blocksperbatch", 64))
        self.on_damage = options.get("ondamage", "fail")
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.rejected = options.get("rows", "blocks") == "rejected"
        if not self.path:
            raise ValueError("blockfile: a path is needed")
        if self.on_damage not in ("fail", "skip"):
            raise ValueError(f"blockfile: onDamage is fail or skip, not {self.on_damage!r}")

    def partitions(self) -> list[Ranges]:
        files = [f for p in self.path.split("\n") for f in list_files(p)]
        return plan(files, self.split) or [Ranges([])]

    def read(self, partition: Ranges, held: ByteFile | None = None) -> Iterator[pa.RecordBatch]:
        found = self._scan(partition, held)
        yield from self._pieces(found) if self.rejected else batches_of(self._blocks(found), self.per_batch)

    def _scan(self, partition: Ranges, held: ByteFile | None
              ) -> Iterator[tuple[ByteFile, tuple[int, Block] | pa.RecordBatch | Piece]]:
        for path, start, end, length in partition.ranges:
            file = held or ByteFile(path, length)
            try:
                for x in Scan(file, self.magic, self.verify, self.max_block, RUN).range(start, end):
                    yield file, x
            finally:
                file.close()

    def _blocks(self, found) -> Iterator[tuple[str, int, Block] | pa.RecordBatch]:
        for file, x in found:
            if isinstance(x, pa.RecordBatch):
                yield x
            elif not isinstance(x, Piece):
                yield file.path, *x
            elif self.on_damage == "fail" and file.filled(x.offset, x.offset + x.length):
                raise DamagedBlockFile(f"{file.path}: {x.length} bytes at {x.offset}: {x.reason}")

    def _pieces(self, found) -> Iterator[pa.RecordBatch]:
        for file, x in found:
            if isinstance(x, Piece):
                yield pa.RecordBatch.from_pylist(
                    [{"file": file.path, **x._asdict(),
                      "filled": file.filled(x.offset, x.offset + x.length)}], schema=PIECES)


def decode_contents(named: dict):
    """A ``mapInArrow`` function from (path, content) rows to the rows that the
    source gives with the options ``named``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockFileReader({"path": "-"} | named)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                data = content.as_py() or b""
                yield from own.read(Ranges([(path, 0, len(data), len(data))]), HeldFile(path, data))

    return run


def decode_paths(magic: bytes, blocks_per_batch: int):
    """A ``mapInArrow`` function from (path, length) rows to block rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockFileReader({"path": "-", "magic": magic.hex(), "blocksPerBatch": blocks_per_batch})
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                yield from own.read(Ranges([(path, 0, length, length)]))

    return run


class BlockFileSource(DataSource):
    """Blocks (or rejected pieces) of raw block files."""

    @classmethod
    def name(cls) -> str:
        return "blockfile"

    def schema(self):
        if self.options.get("rows", "blocks") == "rejected":
            return "file string, offset bigint, length bigint, reason string, damaged boolean, filled boolean"
        return BLOCK_FILE_ROWS

    def reader(self, schema) -> BlockFileReader:
        return BlockFileReader(dict(self.options))


def load(spark: SparkSession, path: str, whole_files: bool, **options) -> DataFrame:
    """The source's rows for ``path``. With ``whole_files`` Spark's own reader
    opens the files, one a task and at most 2 GiB each: for file systems that
    only Spark can open."""
    named = {k: v.hex() if isinstance(v, bytes) else str(v).lower() for k, v in options.items()}
    if whole_files:
        schema = BlockFileSource({"path": path} | named).schema()
        return (spark.read.format("binaryFile").load(path.split("\n")).select("path", "content")
                .mapInArrow(decode_contents(named), schema))
    spark.dataSource.register(BlockFileSource)
    return spark.read.format("blockfile").options(**named).load(path)
