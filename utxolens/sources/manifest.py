"""One decode of the block files for all jobs.

``DecodeStore`` keeps decoded blocks under a folder, one partition per source
file, and a manifest of what they were decoded from: path, length, modification
time, integrity option. ``blocks(path)`` lists the files, decodes those the
manifest does not know, and returns the stored blocks of exactly the files
listed. A file that has grown or changed is decoded anew; its former decode goes
once it is older than ``keep`` seconds, so a job that still reads it can end.

A decode writes to a run folder of its own and enters the manifest after it is
complete: what a failed job leaves behind is in no manifest and is never read.
Jobs that decode the same file at once both succeed; the later entry is read.
The manifest has a row per source file; the driver reads it whole, as it does
the listing.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .blockfile import BLOCK_FILE_ROWS, MAINNET_MAGIC, read_block_files
from .blockscan import FileInfo

ENTRY = ("path string, length bigint, modified bigint, magic string, verify boolean, run string, "
         "part string, decoded bigint")
KEEP = 24 * 3600


class Entry(NamedTuple):
    """A decoded file: what it was and where its blocks are."""

    path: str
    length: int
    modified: int
    magic: str
    verify: bool
    run: str
    part: str
    decoded: int              # seconds

    @property
    def key(self) -> tuple:
        return self.path, self.length, self.modified, self.magic, self.verify


class DecodeStore:
    def __init__(self, spark: SparkSession, root: str | None = None, keep: int = KEEP,
                 whole_files: bool = False):
        self.spark, self.keep, self.whole_files = spark, keep, whole_files
        self.root = (root or f"{checkpoint_dir(spark).rstrip('/')}/utxolens/decoded").rstrip("/")

    def _files(self, path: str) -> list[FileInfo]:
        """Files at a path, listed by Spark (their contents are not read)."""
        rows = (self.spark.read.format("binaryFile").load(path)
                .select("path", "length", F.unix_millis("modificationTime").alias("modified"))
                .orderBy("path").collect())
        return [FileInfo(*r) for r in rows]

    def entries(self) -> list[Entry]:
        """The manifest."""
        try:
            rows = self.spark.read.schema(ENTRY).json(f"{self.root}/manifest").collect()
        except AnalysisException:                 # no decode yet
            return []
        return [Entry(*r) for r in rows]

    def _folder(self, e: Entry) -> str:
        return f"{self.root}/blocks/run={e.run}/part={e.part}"

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _decode(self, files: list[FileInfo], magic: bytes, verify: bool) -> list[Entry]:
        """Decode some files into a run of their own and enter them."""
        run, now = uuid.uuid4().hex, int(time.time())
        made = [Entry(*f, magic.hex(), verify, run, f"{i:06d}", now) for i, f in enumerate(files)]
        parts = self.spark.createDataFrame([(e.path, e.part) for e in made], "file string, part string")
        blocks = read_block_files(self.spark, "\n".join(f.path for f in files), magic, verify=verify,
                                  whole_files=self.whole_files)
        (blocks.join(F.broadcast(parts), "file").select(*blocks.columns, "part")
         .write.partitionBy("part").parquet(f"{self.root}/blocks/run={run}"))
        (self.spark.createDataFrame(made, ENTRY).coalesce(1)
         .write.mode("append").json(f"{self.root}/manifest"))
        return made

    def blocks(self, path: str, magic: bytes = MAINNET_MAGIC, verify: bool = False) -> DataFrame:
        """``file, size, block_hash, t, transactions`` of the block files at ``path``."""
        files = self._files(path)
        known = {e.key: e for e in sorted(self.entries(), key=lambda e: e.decoded)}
        wanted = {f: (*f, magic.hex(), verify) for f in files}
        new = [f for f in files if wanted[f] not in known]
        if new:
            known |= {e.key: e for e in self._decode(new, magic, verify)}
        self._expire(files, known)
        folders = [self._folder(known[wanted[f]]) for f in files]
        folders = [p for p in folders if self._exists(p)]      # a file without blocks has none
        if not folders:
            return self.spark.createDataFrame([], BLOCK_FILE_ROWS)
        return self.spark.read.schema(BLOCK_FILE_ROWS).parquet(*folders)

    def _expire(self, files: list[FileInfo], known: dict[tuple, Entry]) -> None:
        """Remove decodes of listed files as they were before they changed."""
        now = {f.path: f for f in files}
        for e in known.values():
            f = now.get(e.path)
            if f is not None and (e.length, e.modified) != (f.length, f.modified) \
                    and time.time() - e.decoded >= self.keep:
                self._delete(self._folder(e))

    def forget(self, path: str) -> None:
        """Remove the decodes of the files at ``path``, whatever their age."""
        names = {f.path for f in self._files(path)}
        rest = []
        for e in self.entries():
            if e.path in names:
                self._delete(self._folder(e))
            else:
                rest.append(e)
        fresh = f"{self.root}/manifest"
        self._delete(fresh)
        if rest:
            self.spark.createDataFrame(rest, ENTRY).coalesce(1).write.json(fresh)
