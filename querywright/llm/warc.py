"""Operator 3, WARC: a deterministic sharded writer, and the reader for its archives.

Records are dealt into ranges of their key and written in key order, each as a gzip
member of its own; a shard rolls to a new file when the compressed size passes a
bound.  Headers and digests are made anew from the payload.  Of records with equal
payloads the one with the smallest key is a response and the others are revisits
that refer to it.

Nothing is visible before the end: tasks write under temporary names of their own,
say what they wrote in a manifest table, and a second job gives the files of that
manifest their final names.  A task that is run again, or twice at once, leaves
files that no manifest names; they go with the temporary folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm.common import KeyRanges, fresh_path, range_bytes, spread_join, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, temporary string, final string, records long, bytes long, sha256 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
NO_ID = (1 << 63) - 1


class Store:
    """Files of the shared folder, through the local file system or pyarrow's for other schemes."""

    def __init__(self, root: str):
        parsed = urlparse(root)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = parsed.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str):
        path = self.path(name)
        if self.local:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            return open(path, "wb")
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        return self.fs.open_output_stream(path)

    def read(self, name: str):
        return open(self.path(name), "rb") if self.local else self.fs.open_input_stream(self.path(name))

    def size(self, name: str) -> int | None:
        if self.local:
            return os.path.getsize(self.path(name)) if os.path.exists(self.path(name)) else None
        info = self.fs.get_file_info(self.path(name))
        return info.size if info.is_file else None

    def move(self, name: str, to: str, size: int) -> None:
        """Rename; done already is done, so that a repeated task does no harm."""
        if self.size(to) == size and self.size(name) is None:
            return
        if self.local:
            os.makedirs(os.path.dirname(self.path(to)), exist_ok=True)
            os.replace(self.path(name), self.path(to))
        else:
            self.fs.move(self.path(name), self.path(to))


def record_id(page_id: int, digest: str, copy: int) -> str:
    """The n-th record of a page with a payload; the same in any run."""
    return f"urn:page:{'null' if page_id == NO_ID else page_id}:{digest[:32]}" + (f":{copy}" if copy else "")


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def clean_uri(url: str) -> str:
    """Control characters and spaces percent-encoded: a header has one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int, copy: int, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record with its headers made anew."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(payload)).encode()]
    block = CRLF.join(http) + CRLF + CRLF + (b"" if refers_to else payload)
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest, copy)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean_uri(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


class Roller:
    """Files of one shard: a new one begins once the last has ``roll_bytes`` compressed bytes."""

    def __init__(self, store: Store, shard: int, roll_bytes: int, level: int):
        self.store, self.shard, self.roll_bytes, self.level = store, shard, roll_bytes, level
        self.part, self.out, self.done = 0, None, []
        self.folder = f"_temporary/{uuid.uuid4().hex}"

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{self.shard:05d}-{self.part:05d}"
            self.out, self.bytes, self.records, self.digest = self.store.write(self.name), 0, 0, hashlib.sha256()
        packed = gzip.compress(data, self.level, mtime=0)
        self.out.write(packed)
        self.digest.update(packed)
        self.bytes, self.records = self.bytes + len(packed), self.records + 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            final = f"part-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.done.append((self.shard, self.part, self.name, final, self.records, self.bytes, self.digest.hexdigest()))
            self.part, self.out = self.part + 1, None


def write_archives(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 100, roll_bytes: int = 256 << 20, shard_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages`` as archives under ``root`` and return the manifest of the files in place.

    ``shard_bytes`` is the payload a shard aims at (``range_bytes`` raises it for very
    large tables), ``roll_bytes`` the compressed size that rolls a file.  The same rows
    give the same files, byte for byte.

    Defined results: a null payload counts as empty; a null url gives no target
    header; a null key counts as larger than any other; payloads under
    ``least_revisit`` bytes are always responses; of rows equal in key and payload one
    is the response and the rest revisit it; rows of one key are spread over shards by
    their payloads' digests; payloads are written whole, however long; an empty table
    writes no file; other columns are not written.
    """
    spark = pages.sparkSession
    base = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), F.col(url).alias("u"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("b"))
    told = written(base.select("k", F.sha2("b", 256).alias("d"), F.octet_length("b").cast("long").alias("n")), "warc-digests")
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("m")).first()

    # Which rows revisit an earlier one: narrow rows only, a payload that very many share spread over tasks.
    shared = told.where(F.col("n") >= least_revisit).select("k", "d")
    first = shared.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    revisits = spread_join(shared, first, "d", "m", total["m"]).where("k > first").select("k", "d", "first").distinct()

    ranges = KeyRanges(told, "k", "n", int(max(1, total["n"] // range_bytes(total["n"], shard_bytes))))
    bucket = ranges.bucket(F.col("k"), F.conv(F.substring("d", 1, 8), 16, 10).cast("long"))

    # Payloads are shuffled once, each range to a task of its own; a revisit's note sorts just before its rows.
    rows = base.select("k", F.lit(1).alias("kind"), F.sha2("b", 256).alias("d"), F.lit(None).cast("long").alias("first"), "u", "b")
    notes = revisits.select("k", F.lit(0).alias("kind"), "d", "first", F.lit(None).cast("string").alias("u"), F.lit(None).cast("binary").alias("b"))
    dealt = rows.unionByName(notes).withColumn("r", bucket)
    dealt = dealt.repartitionById(len(ranges), "r").sortWithinPartitions("r", "k", "d", "kind", "u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, roller, at, note, copies = Store(root), None, None, None, 0
        for pdf in batches:
            for r, k, kind, d, first, u, b in zip(pdf["r"].tolist(), pdf["k"].tolist(), pdf["kind"].tolist(), pdf["d"].tolist(), pdf["first"].astype("Int64"), pdf["u"], pdf["b"], strict=True):
                if roller is None or roller.shard != r:
                    if roller is not None:
                        roller.close()
                        yield pd.DataFrame(roller.done, columns=names)
                    roller, at = Roller(store, r, roll_bytes, level), None
                if at != (k, d):
                    at, note, copies = (k, d), None, 0
                if not kind:
                    note = int(first)
                    continue
                b = bytes(b)
                again = copies and len(b) >= least_revisit
                refers = record_id(note, d, 0) if note is not None else record_id(k, d, 0) if again else None
                roller.add(record(k, copies, None if pd.isna(u) else u, b, d, refers, date))
                copies += 1
        if roller is not None:
            roller.close()
            yield pd.DataFrame(roller.done, columns=names)

    names = [x.split()[0] for x in MANIFEST.split(", ")]
    staged = written(dealt.mapInPandas(run, MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for pdf in batches:
            for a, b, n in zip(pdf["temporary"], pdf["final"], pdf["bytes"], strict=True):
                store.move(a, b, n)
            yield pdf

    placed = staged.repartition("shard", "part").mapInPandas(commit, MANIFEST)
    placed.drop("temporary").write.mode("overwrite").parquet(f"{root}/_manifest")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_temporary")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return spark.read.parquet(f"{root}/_manifest")


class Members(io.RawIOBase):
    """The uncompressed bytes of a file of gzip members, read in pieces of bounded size."""

    def __init__(self, raw, piece: int = 1 << 20):
        self.raw, self.piece, self.unzip, self.left = raw, piece, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.unzip.eof:
                rest = self.unzip.unused_data or self.raw.read(self.piece)
                if not rest:
                    return 0
                self.unzip, self.left = zlib.decompressobj(31), rest
            data = self.left or self.raw.read(self.piece)
            if not data:
                return 0
            out = self.unzip.decompress(data, len(into))
            self.left = self.unzip.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)


def headers(stream: io.BufferedReader) -> dict[str, str] | None:
    """Header lines up to a blank one, the first line under an empty name; None at the end."""
    line = stream.readline()
    if not line:
        return None
    out = {"": line.decode("utf-8", "replace").strip()}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(raw) -> Iterator[tuple]:
    """(page_id, payload bytes, digest, type, refers_to, url, payload) of each record; digests are checked."""
    stream = io.BufferedReader(Members(raw), 1 << 16)
    while (head := headers(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest differs: {head['warc-record-id']}")
        http, _, payload = block.partition(CRLF + CRLF)
        kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
            raise ValueError(f"payload digest differs: {head['warc-record-id']}")
        refers = head.get("warc-refers-to")
        yield page_of(head["warc-record-id"]), size, said, kind, page_of(refers) if refers else None, head.get("warc-target-uri"), payload if kind == "response" else None


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that the manifest under ``root`` names, a task for each few files."""
    manifest = spark.read.parquet(f"{root}/_manifest")
    files = manifest.count()
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for pdf in batches:
            for name in pdf["final"]:
                held, size = [], 0
                with store.read(name) as raw:
                    for row in read_records(raw):
                        held.append(row if payloads else (*row[:-1], None))
                        size += len(row[-1] or b"") if payloads else 100
                        if size > 4 << 20:
                            yield frame(held)
                            held, size = [], 0
                if held:
                    yield frame(held)

    def frame(held):
        pdf = pd.DataFrame(held, columns=names)
        return pdf.assign(**{c: pd.array(pdf[c].tolist(), dtype="Int64") for c in ("page_id", "refers_to")})

    listed = manifest.select("final").repartitionByRange(max(1, files), "final") if files else manifest.select("final")
    return listed.mapInPandas(run, READ)


def round_trip(pages: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per record, without url and payload."""
    root = root or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, root, **options)
    return read_archives(pages.sparkSession, root, payloads=False).drop("url", "payload")
