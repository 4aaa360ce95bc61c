"""Rows kept as versions of Parquet parts; a pointer file names the parts of the current one.

Parquet files cannot be changed in place, so a change writes new parts and then a
pointer: a replacement names its own part only, an append those of before as well.
Readers of an older version are not disturbed.  Two writers that start from the same
version cannot both succeed: the second finds the pointer's name taken.  That, and the
lock, ask for a file system that refuses to create a file twice, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: What a file of an optimized table aims at.
FILE_BYTES = 256 << 20


class Conflict(RuntimeError):
    """Another writer stored a version in the meantime."""


class ParquetStore:
    """Versions of one table under a folder, with small notes (declarations, upgrades) beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self) -> list[str]:
        fs, folder = self._fs(self.path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _text(self, name: str) -> str:
        fs, path = self._fs(f"{self.path}/{name}")
        source = fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def _create(self, name: str, text: str) -> bool:
        """A new small file; false if there is one of that name."""
        fs, path = self._fs(f"{self.path}/{name}")
        try:
            out = fs.create(path, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def version(self) -> int:
        """The current version; 0 if there is none."""
        return max((int(n[8:]) for n in self._names() if n.startswith("current-")), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def parts(self, version: int | None = None) -> list[str]:
        """The folders that a version (the current one) consists of."""
        return json.loads(self._text(f"current-{version or self.version()}"))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in self.parts(version)])

    def _store(self, df: DataFrame, kept: list[str], was: int) -> int:
        part = f"part-{was + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        if not self._create(f"current-{was + 1}", json.dumps([*kept, part])):
            fs, path = self._fs(f"{self.path}/{part}")
            fs.delete(path, True)
            raise Conflict(f"{self.path}: version {was + 1} was stored by another writer")
        return was + 1

    def replace(self, df: DataFrame) -> int:
        """Write ``df`` as the next version."""
        return self._store(df, [], self.version())

    def append(self, df: DataFrame) -> int:
        """A next version with the rows of ``df`` as well; only these are written."""
        was = self.version()
        if not was:
            return self.replace(df)
        shape = self.read(was)
        return self._store(df.select(*[df[n].cast(t).alias(n) for n, t in shape.dtypes]), self.parts(was), was)

    def bytes(self) -> int:
        """What the files of the current version hold."""
        total = 0
        for p in self.parts():
            fs, path = self._fs(f"{self.path}/{p}")
            total += fs.getContentSummary(path).getLength()
        return total

    def optimize(self, file_bytes: int = FILE_BYTES) -> int:
        """The same rows in one part, in files of about ``file_bytes``; the number of files."""
        files = max(1, math.ceil(self.bytes() / file_bytes))
        rows = self.read()
        now = rows.rdd.getNumPartitions()
        self.replace(rows.coalesce(files) if files < now else rows.repartition(files))
        return files

    def vacuum(self) -> int:
        """Delete what no version but the current one needs; the number of parts that went."""
        version, kept, gone = self.version(), set(self.parts()), 0
        for name in self._names():
            old = name.startswith("part-") and name not in kept
            if old or (name.startswith("current-") and name != f"current-{version}"):
                fs, path = self._fs(f"{self.path}/{name}")
                fs.delete(path, True)
                gone += old
        return gone

    def drop(self) -> bool:
        fs, folder = self._fs(self.path)
        return bool(fs.delete(folder, True))

    def move(self, path: str) -> None:
        fs, old = self._fs(self.path)
        fs.rename(old, self._fs(path)[1])
        self.path = path.rstrip("/")

    def note(self, topic: str) -> Any:
        """The last value noted under a topic, or None."""
        numbers = [int(n.rpartition("-")[2]) for n in self._names() if n.startswith(f"note-{topic}-")]
        return json.loads(self._text(f"note-{topic}-{max(numbers)}")) if numbers else None

    def put_note(self, topic: str, value: Any) -> None:
        """Note a value; earlier ones of the topic go."""
        numbers = [int(n.rpartition("-")[2]) for n in self._names() if n.startswith(f"note-{topic}-")]
        if not self._create(f"note-{topic}-{max(numbers, default=0) + 1}", json.dumps(value, default=str)):
            raise Conflict(f"{self.path}: {topic} was noted by another writer")
        for n in numbers:
            fs, path = self._fs(f"{self.path}/note-{topic}-{n}")
            fs.delete(path, False)

    def lock(self, seconds: float) -> str | None:
        """Take the table's lock: its token, or None while another's is younger than ``seconds``.

        The lock is a file that only one process can create.  One that is too old is
        renamed away first, which again only one process can do.
        """
        fs, path = self._fs(f"{self.path}/lock")
        token = uuid.uuid4().hex
        if self._create("lock", token):
            return token
        try:
            age = self.spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(path).getModificationTime()
        except Exception:
            return None  # released in between; the next attempt may have it
        if age < seconds * 1000 or not fs.rename(path, self._fs(f"{self.path}/stale-{token}")[1]):
            return None
        fs.delete(self._fs(f"{self.path}/stale-{token}")[1], False)
        return token if self._create("lock", token) else None

    def unlock(self, token: str) -> bool:
        """Give the lock back; false if it is another's by now."""
        try:
            held = self._text("lock")
        except Exception:
            return False
        fs, path = self._fs(f"{self.path}/lock")
        return held == token and bool(fs.delete(path, False))
