"""Operator 8, n-gram Jaccard join: MinHash banding, then exact checks on full n-gram sets.

1. Every text gives the set of its word n-grams, hashed to 64 bits.  Documents of
   equal sets are one class, a node of the graphs below; copies are never paired.
2. Each class has ``bands`` keys of ``rows`` MinHash values.  The two numbers come
   from the wished recall at the threshold.  Keys are shuffled, and each document is
   linked to the smallest node of its key: a star, so a key that very many share makes
   no pairs.  Joins on keys that many rows share are spread (``spread_join``).
3. Components of these stars are candidate groups.  A group is cut into blocks of
   bounded size, and each pair of blocks is checked by one task: exact intersections
   of the full sets, all pairs of the two blocks.  Links are counted, not listed.
4. Components of the links found are the result's groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywright.llm.common import drop_written, spread_join, written
from querywright.llm.components import components

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
_ODD = np.array([int.from_bytes(xxhash.xxh64_digest(f"place {i}"), "big") | 1 for i in range(64)], np.uint64)


def choose_bands(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``most_rows`` rows that miss at most 1 - recall at the threshold.

    More rows let fewer unlike pairs through; the bands needed grow as threshold**-rows.
    """
    hit = threshold**most_rows
    return math.ceil(math.log(1 - recall) / math.log(1 - hit)), most_rows


class WordHashes(dict):
    """Word -> 64-bit hash, forgetting all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def ngram_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-case word n-grams of a whole text.

    A text of fewer than n words, but some, has one n-gram: all its words.  A text
    without words has none.
    """
    words = WORDS(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _ODD[i]
    total ^= total >> np.uint64(31)
    return np.unique(total)


class Signer:
    """Band keys of an n-gram set; the permutations are h -> a*h + b mod 2^32 with odd a."""

    def __init__(self, bands: int, rows: int, seed: int = 8):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)

    def keys(self, grams: np.ndarray) -> list[int]:
        low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(low), 512):
            least = np.minimum(least, (self.a[:, None] * low[None, lo : lo + 512] + self.b[:, None]).min(axis=1))
        digest = xxhash.xxh3_64_intdigest
        table = np.ascontiguousarray(least.reshape(self.bands, self.rows))
        # Signed, as Spark's long is; the band number keeps equal values of different bands apart.
        return [digest(table[i].tobytes(), i) - (1 << 63) for i in range(self.bands)]


def described(docs: DataFrame, key: str, text: str, bands: int, rows: int, n: int) -> DataFrame:
    """(id, th, set_hash, n_grams, keys): one narrow row per document; th is a hash of the text."""

    def run(batches):
        signer = Signer(bands, rows)
        last: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for k, th, t in streamed(batch, "id", "th", "t"):
                # Copies often stand near each other; a few results are kept by text.
                got = last.get(t)
                if got is None:
                    grams = ngram_set(t, n)
                    name = xxhash.xxh3_128_hexdigest(grams.tobytes() if len(grams) else t.encode("utf-8", "surrogatepass"), len(grams))
                    got = (name, len(grams), signer.keys(grams) if len(grams) else [])
                    if len(last) > 256:
                        last.clear()
                    last[t] = got
                out.append((k, th, *got))
                if len(out) >= 1000:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "th", "set_hash", "n_grams", "keys"])

    return known_texts(docs, key, text).mapInArrow(run, "id long, th long, set_hash string, n_grams int, keys array<long>")


def streamed(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of an Arrow batch, one at a time, so that its texts don't stand in memory twice."""
    columns = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def known_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, th): key (may be null), text (null as empty) and text hash; (id, th) names a row."""
    told = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return told.withColumn("th", F.xxhash64("t"))


class Forest:
    """Union-find over 0..n-1, the smaller root winning."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction, columns: int = 4096) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (indices into ``sets``) reach the threshold: a boolean matrix."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    column = np.full(len(grams), -1, np.int64)
    column[shared] = np.arange(len(shared))
    at = column[at]
    who, at = who[at >= 0], at[at >= 0]
    by = np.argsort(at, kind="stable")
    who, at = who[by], at[by]
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), columns):
        a, b = np.searchsorted(at, [lo, lo + columns])
        dense = np.zeros((len(sets), min(columns, len(shared) - lo)), np.float32)
        dense[who[a:b], at[a:b] - lo] = 1
        both += dense[left] @ dense[right].T
    size = np.array([len(s) for s in sets], np.float64)
    # |A & B| / |A | B| >= p/q  <=>  |A & B| (p + q) >= p (|A| + |B|), in whole numbers.
    p, q = threshold.numerator, threshold.denominator
    return both * float(p + q) >= p * (size[left][:, None] + size[right][None, :]) - 1e-6


def check_blocks(rows: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(node, links, root, nb) for each node of each block pair: links found there, and the smallest node linked through it.

    Rows come sorted by (grp, lo, hi); one block pair is held at a time, two blocks
    at most.
    """

    def run(batches):
        at, held = None, []
        names = ("grp", "lo", "hi", "nb", "block", "node", "copies", "t")
        for batch in batches:
            out = []
            for grp, lo, hi, nb, block, node, copies, t in streamed(batch, *names):
                if (grp, lo, hi, nb) != at:
                    if held:
                        out += settle(at, held)
                    at, held = (grp, lo, hi, nb), []
                held.append((block, node, copies, ngram_set(t, n)))
            if out:
                yield told(out)
        if held and (out := settle(at, held)):
            yield told(out)

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["node", "links", "root", "nb"])

    def settle(at, held):
        block, ids, copies = np.array([x[0] for x in held]), [x[1] for x in held], np.array([x[2] for x in held], np.int64)
        same = at[1] == at[2]
        left = np.arange(len(held)) if same else np.flatnonzero(block == at[1])
        right = left if same else np.flatnonzero(block == at[2])
        if not len(left) or not len(right):
            return []
        hit = linked([x[3] for x in held], left, right, threshold)
        if same:
            np.fill_diagonal(hit, False)
        links = np.zeros(len(held), np.int64)
        links[left] += hit @ copies[right]
        if not same:
            links[right] += hit.T @ copies[left]
        forest = Forest(len(held))
        for i, row in zip(left.tolist(), hit, strict=True):
            # One union for each new neighbour; those already joined cost a lookup.
            for j in right[row].tolist():
                forest.join(i, j)
        return [(ids[i], int(links[i]), ids[forest.root(i)], at[3]) for i in range(len(held)) if links[i]]

    return rows.mapInArrow(run, "node long, links long, root long, nb long")


def grouped(docs: DataFrame, key: str, text: str, n: int, threshold: float, recall: float, block: int) -> DataFrame:
    """(id, th, rep_id, links, class_id, win_id, win_th) of each row, written.

    The last two name the row that stands for its group: the smallest id, then text hash.
    """
    bands, rows = choose_bands(threshold, recall)
    limit = Fraction(threshold).limit_denominator(1000)
    told = written(described(docs, key, text, bands, rows, n), "jaccard-sets")
    # A class is all rows of one n-gram set.  Its node number is made once, as the table is written,
    # and is no part of any result.  Ids sort before a missing one.
    row = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    classes = told.groupBy("set_hash").agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("copies"), F.max_by("keys", F.col("n_grams")).alias("keys"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "set_hash", F.col("r.id").alias("id"), F.col("r.th").alias("th"), "copies", "keys"), "jaccard-classes")

    count = classes.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()

    keys = classes.select("node", F.explode("keys").alias("k"))
    shared = written(keys.groupBy("k").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"), "jaccard-shared")
    met = shared.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()["n"]
    stars = spread_join(keys, shared, "k", "m", met).where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = components(stars)
    sizes = written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "jaccard-sizes")
    member = spread_join(groups, sizes, "root", "m", groups.count()).join(classes.select("node", "id", "th", "copies"), "node")
    blocks = F.ceil(F.col("m") / block).cast("int")
    member = member.select("node", "id", "th", F.col("root").alias("grp"), "copies", blocks.alias("nb"), F.pmod("th", blocks.cast("long")).cast("int").alias("block"))

    found = known_texts(docs, key, text)
    same_row = found["id"].eqNullSafe(member["id"]) & (found["th"] == member["th"])
    # A row that is there many times is one before its text is copied.
    wanted = found.join(member, same_row).select(*member.drop("id", "th").columns, "t").dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    pairs = wanted.select("*", other).select("grp", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "nb", "block", "node", "copies", "t")
    # The block pairs of a group are numbered and dealt round the tasks, so that no task gets many of them.
    number = F.expr("CAST(lo AS LONG) * nb - CAST(lo AS LONG) * (lo - 1) div 2 + hi - lo")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("grp") % tasks + number, F.lit(tasks)).cast("int"))
    pairs = pairs.repartitionById(tasks, "task").drop("task").sortWithinPartitions("grp", "lo", "hi", "node")
    found_links = written(check_blocks(pairs, n, limit), "jaccard-links")

    links = found_links.groupBy("node").agg(F.sum("links").alias("links"))
    # A group of one block is settled by its one check; of the others the parts are put together.
    parts = found_links.where((F.col("nb") > 1) & (F.col("node") != F.col("root")))
    joined = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = joined.unionByName(found_links.where("nb = 1").select("node", "root"))
    known = classes.select("node", "set_hash", "id", "th", "copies").join(links, "node", "left").join(joined, "node", "left")
    known = written(known.withColumn("root", F.coalesce("root", "node")), "jaccard-linked")
    best = known.groupBy("root").agg(F.min(row).alias("w"), F.count(F.lit(1)).alias("m")).select("root", F.col("w.id").alias("win_id"), F.col("w.th").alias("win_th"), "m")
    best = written(best, "jaccard-best")
    final = spread_join(known, best, "root", "m", count["classes"])
    final = written(final.select("set_hash", F.col("id").alias("rep_id"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "win_id", "win_th"), "jaccard-final")
    result = written(spread_join(told.select("id", "th", "set_hash"), final, "set_hash", "copies", count["rows"]).drop("set_hash", "copies"), "jaccard-rows")
    drop_written(docs.sparkSession, told, classes, shared, sizes, found_links, known, best, final)
    return result


def similarity_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 256) -> DataFrame:
    """One row per document: key, ``class_id`` (long), ``rep_id`` (long), ``n_links`` (long).

    ``class_id`` is the smallest id in the component of documents linked by a Jaccard
    similarity of at least ``threshold`` between their word n-gram sets; ``rep_id`` the
    smallest id of the documents with the very same set; ``n_links`` the number of
    other documents it is linked to, copies included.

    Defined results: documents are told apart by key and text, so texts that share an
    id, or have none, each have a class and links of their own; in a class without any
    id both ids are null; texts without words (null counts as empty) are linked to equal
    texts only; repeated rows count as copies; an empty table gives an empty result;
    other columns are left out.
    """
    rows = grouped(docs, key, text, n, threshold, recall, block)
    return rows.select(F.col("id").alias(key), F.col("win_id").alias("class_id"), "rep_id", F.col("links").alias("n_links"))


def keep_first_of_group(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 256) -> DataFrame:
    """One row of ``docs`` for each group of near or exact copies: that with the smallest id, then text hash.

    Rows are told apart by key and text: another text under the same id is judged by
    itself, and a text without an id goes only if its group has another row that
    stays.  Of rows equal in both, one stays.
    """
    rows = grouped(docs, key, text, n, threshold, recall, block)
    stays = F.col("id").eqNullSafe(F.col("win_id")) & (F.col("th") == F.col("win_th"))
    gone = rows.where(~stays).select(F.col("id").alias("_qw_id"), F.col("th").alias("_qw_th")).distinct()
    often = rows.where(stays).groupBy(F.col("id").alias("_qw_id"), F.col("th").alias("_qw_th")).agg(F.count(F.lit(1)).alias("_qw_n")).where("_qw_n > 1").drop("_qw_n")
    named = docs.withColumn("_qw_k", F.col(key).cast("long")).withColumn("_qw_t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))

    def same(other: DataFrame) -> Column:
        return named["_qw_k"].eqNullSafe(other["_qw_id"]) & (named["_qw_t"] == other["_qw_th"])

    kept = named.join(gone, same(gone), "left_anti")
    often = written(often, "jaccard-repeated")
    if often.isEmpty():
        return kept.select(*docs.columns)
    # Which of some rows that differ in other columns only is settled by those columns' hash.
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = kept.join(often, same(often), "left_semi").groupBy("_qw_k", "_qw_t").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias("_qw_row")).select("_qw_row.*")
    return kept.join(often, same(often), "left_anti").select(*docs.columns).unionByName(one)


def jaccard(a: str, b: str, n: int = 5) -> float:
    """The similarity of two texts, for tests and spot checks."""
    x, y = ngram_set(a, n), ngram_set(b, n)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


