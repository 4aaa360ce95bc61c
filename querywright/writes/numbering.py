"""Gapless numbers for the rows of a DataFrame without sorting them all in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_BUCKETS = 1024


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with 1, 2, 3, .. in a column: rows are ranked inside hash buckets, buckets by their counts.

    There are 64 buckets for each shuffle partition, which large clusters have more of.
    The counts are one row per bucket, so the only window over everything sees no more
    rows than that.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(LEAST_BUCKETS, 64 * partitions))).alias("_qw_bucket")
    counts = df.select(bucket).groupBy("_qw_bucket").agg(F.count(F.lit(1)).alias("_qw_m"))
    before = Window.orderBy("_qw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_qw_bucket", F.coalesce(F.sum("_qw_m").over(before), F.lit(0)).alias("_qw_start"))
    inside = Window.partitionBy("_qw_bucket").orderBy(*keys)
    ranked = df.withColumn("_qw_bucket", bucket).withColumn("_qw_rank", F.row_number().over(inside))
    return ranked.join(starts, "_qw_bucket").withColumn(name, F.col("_qw_start") + F.col("_qw_rank")).drop("_qw_bucket", "_qw_rank", "_qw_start")
