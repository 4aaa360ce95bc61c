"""Shared pieces: the shared folder, written intermediate tables, seeded order, two-level ranks."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_FALLBACK: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_all_cores(table: DataFrame) -> DataFrame:
    """A stored table in fewer splits than the session has cores, dealt to all of them; any other as it is.

    A small file has one row group, so one task would do all the work on its texts.
    Large tables have splits enough and are never moved.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and all runs
    in one process (``local`` masters, as in tests) a temporary folder stands in for it;
    elsewhere a missing setting is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="querywright-shared-")
    return _LOCAL_FALLBACK[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets; removed when the driver ends."""
    path = f"{shared_dir(spark)}/querywright/{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a session already stopped is let be."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of shared files, never
    the stages before.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._qw_path = path
    return back


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for table in tables:
        drop_path(spark, table._qw_path)


def seeded(seed: int, *cols: Column) -> Column:
    """A seeded pseudo-random hex string per row; equal in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def hash_bucket(order: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 (a power of two up to 2^28) from the leading hex digits of ``seeded``.

    Buckets ascend with the string order of the hash, so (bucket, hash) sorts like
    the hash alone.
    """
    top = F.conv(F.substring(order, 1, 7), 16, 10).cast("long")
    return F.shiftright(top, 28 - (buckets.bit_length() - 1)).cast("int")


def bucket_count(rows: int, per_bucket: int = 20_000, least: int = 1024) -> int:
    """A power of two that keeps the buckets of ``rows`` rows near ``per_bucket``.

    2^28 is as far as ``hash_bucket`` goes: 5 * 10^12 rows at 20,000 each.
    """
    want = min(1 << 28, max(least, -(-rows // per_bucket)))
    return 1 << (want - 1).bit_length()


def range_bytes(total: int, least: int = 4 << 20) -> int:
    """How many bytes a key range aims at: ``least``, growing as the root of the whole beyond 100 GB.

    So both the number of ranges (800,000 at 100 TB) and what one task reads (130 MB
    there) stay moderate, and neither has a cap.
    """
    return max(least, math.isqrt(160 * max(total, 0)))


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, most_hot: int = 5_000, least: int = 1_000) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key) on ``key``, no key's rows meeting in one task.

    ``weight`` names a column of ``table`` that says how many of the ``total`` rows have
    the key.  Keys of more than max(``least``, total / ``most_hot``) rows are hot; as the
    weights sum to ``total`` at most, there are no more than ``most_hot`` of them, and
    only they are broadcast.  The others are joined by a shuffle in which no key has more
    rows than that.  Rows whose key is not in ``table`` (or null) are left out.
    """
    bound = max(least, -(-total // most_hot))
    hot = F.broadcast(table.where(F.col(weight) > bound))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(weight) <= bound), key)
    return rows.join(hot, key).unionByName(rest)


def stratum_key(col: Column) -> Column:
    """A join key for a nullable column: null gets a key of its own."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def running_totals(cells: DataFrame, group: list[str], bucket: str, values: dict[str, str]) -> DataFrame:
    """Exclusive running sums of each value column over the buckets of each group.

    ``cells`` holds one row per (group, bucket), so however many rows a group has,
    the window sees at most the fixed number of buckets.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*group, bucket, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(out) for v, out in values.items()])


def range_splits(df: DataFrame, key: str, parts: int, weight: str | None = None, sample: int = 50_000) -> np.ndarray:
    """At most ``parts - 1`` ascending split points of a long key, from a hash sample.

    The sample (about ``sample`` keys, or 8 for each part where that is more) only
    places the cuts between tasks; every row is kept whatever they are.  The same
    table gives the same cuts in any run.
    """
    cols = [F.col(key), (F.col(weight) if weight else F.lit(1)).alias("w")]
    rows = df.count()
    if parts <= 1 or not rows:
        return np.empty(0, np.int64)
    every = max(1, rows // max(sample, 8 * parts))
    picked = df.select(*cols).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0))
    # One row for each key, however often it is repeated.
    table = picked.groupBy(key).agg(F.sum("w").alias("w")).toPandas().sort_values(key)
    keys, mass = table[key].to_numpy(np.int64), table["w"].to_numpy(np.float64).cumsum()
    if not len(keys):
        return np.empty(0, np.int64)
    at = np.searchsorted(mass, mass[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def range_bucket(key: Column, splits: np.ndarray) -> Column:
    """The range of a nullable long key: how many splits are not above it; 0 for null.

    A binary search in halving steps over a literal array, so rows stay in the JVM.
    """
    n = len(splits)
    if not n:
        return F.lit(0)
    points = F.lit(np.asarray(splits, np.int64))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at: Column, s: Column) -> Column:
        return F.when((at + s <= n) & (F.get(points, at + s - 1) <= key), at + s).otherwise(at)

    return F.coalesce(F.aggregate(steps, F.lit(0), step), F.lit(0))


class KeyRanges:
    """Ranges of (key, spot) of about equal weight, in ascending order.

    ``key`` is a long column without nulls, ``spot`` a number from 0 to 2^32 - 1 that
    orders the rows of one key.  Cuts come from ``range_splits``; a key that outweighs a
    range has ranges of its own, cut evenly by spot, so rows of one key don't meet in
    one task unless their spots are equal too.  No more than ``parts`` keys can be so
    heavy.
    """

    def __init__(self, df: DataFrame, key: str, weight: str, parts: int):
        sums = df.groupBy(key).agg(F.sum(weight).alias("w"))
        total = sums.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()["w"]
        share = max(1, total // max(parts, 1))
        heavy = {r[key]: -(-r["w"] // share) for r in sums.where(F.col("w") > share).collect()} if parts > 1 else {}
        cuts = set(range_splits(df, key, parts, weight).tolist())
        self.points = np.array(sorted(cuts | set(heavy) | {k + 1 for k in heavy if k < (1 << 63) - 1}), np.int64)
        self.pieces = np.ones(len(self.points) + 1, np.int64)
        for k, n in heavy.items():
            self.pieces[np.searchsorted(self.points, k, "right")] = n
        self.first = np.concatenate([[0], np.cumsum(self.pieces)[:-1]])

    def __len__(self) -> int:
        return int(self.pieces.sum())

    def bucket(self, key: Column, spot: Column) -> Column:
        at = range_bucket(key, self.points)
        return (F.get(F.lit(self.first), at) + F.shiftright(spot * F.get(F.lit(self.pieces), at), 32)).cast("int")
