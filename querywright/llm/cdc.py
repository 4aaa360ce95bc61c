"""Operator 5, document fingerprints: content-defined chunking.

A rolling gear hash over the UTF-8 bytes decides where a text may be cut, with a
stricter mask before the wished length and a laxer one after it (normalised
chunking), so boundaries move with the content and an insertion changes the
chunks around it only.  A fingerprint is the set of chunk digests with the
chunks' lengths; the likeness of two is the length of the chunks they share over
that of the smaller set (containment).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywright.llm.common import KeyRanges, drop_written, range_bytes, written

LEAST, WISHED, MOST = 8, 32, 128
#: Bits of the gear hash that must be zero: two more than the wished length asks for, and two less.
STRICT = np.uint32(((1 << 7) - 1) << 25)
LAX = np.uint32(((1 << 3) - 1) << 25)
#: One random 32-bit word for each byte value, from a rule: the first bytes of its SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)
DIGITS = 16
ENTRY = DIGITS + 3


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one its length."""
    n = len(data)
    if not n:
        return []
    h = gear_hashes(data)
    lax = np.flatnonzero((h & LAX) == 0)
    strict = ((h[lax] & STRICT) == 0).tolist()
    ends, start = [], 0
    for at, hard in zip((lax + 1).tolist(), strict, strict=True):
        while at - start > MOST:
            start += MOST
            ends.append(start)
        size = at - start
        if size >= LEAST and (hard or size >= WISHED):
            ends.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Digest -> length of each distinct chunk of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    digest, out, start = xxhash.xxh3_64_intdigest, {}, 0
    for end in cut_points(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def encode(chunks: dict[int, int]) -> str:
    """Sorted entries of a 16-digit digest and a 3-digit length, in hexadecimal; empty for an empty text."""
    return "".join([f"{d:016x}{n:03x}" for d, n in sorted(chunks.items())])


def decode(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[i : i + DIGITS], 16): int(fingerprint[i + DIGITS : i + ENTRY], 16) for i in range(0, len(fingerprint), ENTRY)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared chunk length over the smaller set's length; 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum([n for d, n in a.items() if d in b])
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)

ARROW = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def fingerprint_with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", bytes_per_range: int = 4 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness to each other and to the next text's.

    Rows go by descending key; the row after the last is the first.  They are dealt
    into key ranges, each read in order by one task, and the first row of each range
    goes along to the end of the range before.  Texts are shuffled once.
    ``bytes_per_range`` is the text a range aims at (``range_bytes`` raises it for very
    large tables).

    Defined results: null texts count as empty; a null key sorts last (after the
    smallest key) and rows of equal key by their text's hash, then text, each with the
    following row as its next, so repeated rows have each other; texts are read whole,
    however long; an empty table gives an empty result; a single row is its own next;
    other columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("o", F.coalesce("k", F.lit(-(1 << 63))))
    # The upper half of the signed hash, from 0 on: it ascends with the hash.
    spot = F.shiftright(F.col("h"), 32) + (1 << 31)
    # One narrow row for each text says how the texts are dealt; the texts are read twice, shuffled once.
    named = base.withColumn("h", F.xxhash64("t"))
    narrow = written(named.select("o", "h", (F.octet_length("t") + 16).cast("long").alias("n")), "cdc-sizes")
    size = narrow.agg(F.sum("n").alias("n")).first()["n"] or 0
    ranges = KeyRanges(narrow, "o", "n", int(max(1, size // range_bytes(size, bytes_per_range))))
    bucket = ranges.bucket(F.col("o"), spot)

    # The row that follows a range's last one: the first (largest) of the next lower range that has rows.
    heads = narrow.groupBy(bucket.alias("r")).agg(F.max(F.struct("o", "h")).alias("top")).orderBy(F.desc("r")).collect()
    drop_written(spark, narrow)
    if not heads:
        return spark.createDataFrame([], OUT)
    # One row for each range; its first row goes to the range above as well, to end it.
    plan = spark.createDataFrame([(h["r"], h["top"]["o"], h["top"]["h"], heads[i - 1]["r"]) for i, h in enumerate(heads)], "r int, top long, top_h long, goes_to int")
    ranged = named.withColumn("r", bucket).join(F.broadcast(plan), "r")
    own = F.struct(F.col("r"), F.lit(0).alias("tail"))
    also = F.struct(F.col("goes_to").alias("r"), F.lit(1).alias("tail"))
    places = F.when((F.col("o") == F.col("top")) & (F.col("h") == F.col("top_h")), F.array(own, also)).otherwise(F.array(own))
    rows = ranged.select(F.explode(places).alias("p"), "k", "o", "h", "t").select("p.r", "p.tail", "k", "o", "h", "t")
    # Each range to a task of its own.  Rows equal to a first one end the range above once.
    dealt = rows.repartitionById(len(ranges), "r").sortWithinPartitions("r", "tail", F.desc("o"), F.desc("h"), F.desc("t")).drop("o", "h")

    def run(batches):
        # One row at a time out of each Arrow batch: texts never stand in memory twice over.
        held = None
        out: list[tuple] = []
        for batch in batches:
            at = {name: batch.column(name) for name in ("r", "tail", "k", "t")}
            for i in range(batch.num_rows):
                r, tail, k, t = (at[name][i].as_py() for name in ("r", "tail", "k", "t"))
                chunks = chunk_set(t)
                if held is not None and held[0] == r:
                    out.append(finish(held, t, chunks))
                held = None if tail else (r, k, t, chunks)
                if len(out) >= 200:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    def finish(held, t, chunks):
        _, k, own, mine = held
        changed = edited(own, t)
        theirs = chunk_set(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return k, len(own), digest, encode(mine), encode(theirs), containment(mine, theirs), containment(mine, chunks)

    def frame(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW, strict=True)], names=OUT.fieldNames())

    return dealt.mapInArrow(run, OUT)
