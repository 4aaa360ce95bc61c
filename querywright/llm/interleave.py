"""Operator 10, sharding: proportional stratified interleaving.

Rows of each source are put in a seeded order and ranked; the rank over the
source's row count is a row's place on the unit interval.  Sorting all rows by
that place interleaves the sources in proportion everywhere, so cutting the
order into equal runs gives every shard the mixture of the whole, and shard
sizes that differ by one row at most.

No source meets in one task: ranks come from counts per (source, hash bucket)
plus a rank inside the bucket, and the global place from closed-form counts per
interval bucket (or counted ones) plus a rank inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querywright.llm.common import bucket_count, hash_bucket, running_totals, seeded, stratum_key

_TMP = ("_qw_key", "_qw_order", "_qw_cell", "_qw_before", "_qw_n", "_qw_rank", "_qw_place", "_qw_slice", "_qw_start", "_qw_at")


def interleave(df: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 10, tie: tuple[str, ...] = (), most_closed: int = 20_000_000) -> DataFrame:
    """``df`` with ``shard`` (int, 0..n_shards-1) and ``slot`` (long, gapless from 0 in each shard).

    Defined results: a null stratum is a stratum of its own; rows of equal key are
    ordered by the ``tie`` columns, and rows equal in those too get neighbouring
    ranks in either order (they are the same row); an empty table gives an empty
    result; fewer rows than shards leave some shards empty; columns of ``df`` named
    ``shard`` or ``slot`` are replaced, all others kept.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    strata = df.groupBy(stratum_key(F.col(stratum)).alias("_qw_key")).agg(F.count(F.lit(1)).alias("_qw_n"))
    total = strata.agg(F.coalesce(F.sum("_qw_n"), F.lit(0)).alias("n")).first()["n"]
    cells = bucket_count(total)
    rows = df.select(*keep).withColumn("_qw_key", stratum_key(F.col(stratum))).withColumn("_qw_order", seeded(seed, F.col(key), *map(F.col, tie)))
    rows = rows.withColumn("_qw_cell", hash_bucket(F.col("_qw_order"), cells))

    narrow = df.select(stratum_key(F.col(stratum)).alias("_qw_key"), hash_bucket(seeded(seed, F.col(key), *map(F.col, tie)), cells).alias("_qw_cell"))
    counts = narrow.groupBy("_qw_key", "_qw_cell").agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(counts, ["_qw_key"], "_qw_cell", {"n": "_qw_before"})
    before = before.join(counts.groupBy("_qw_key").agg(F.sum("n").alias("_qw_n")), "_qw_key")

    inside = Window.partitionBy("_qw_key", "_qw_cell").orderBy("_qw_order", F.col(key), *tie)
    ranked = rows.withColumn("_qw_rank", F.row_number().over(inside)).join(before, ["_qw_key", "_qw_cell"])
    ranked = ranked.withColumn("_qw_rank", F.col("_qw_rank") + F.col("_qw_before"))

    # (2r - 1) / 2n is the middle of rank r's share of the unit interval.
    odd = 2 * F.col("_qw_rank") - 1
    ranked = ranked.withColumn("_qw_place", odd / (2 * F.col("_qw_n"))).withColumn("_qw_slice", F.expr(f"(2 * _qw_rank - 1) * {cells}L div (2 * _qw_n)"))

    starts = slice_starts(strata, ranked, cells, most_closed)

    local = Window.partitionBy("_qw_slice").orderBy("_qw_place", "_qw_key")
    placed = ranked.withColumn("_qw_at", F.row_number().over(local)).join(starts, "_qw_slice")
    placed = placed.withColumn("_qw_at", F.col("_qw_at") - 1 + F.col("_qw_start"))
    shard = F.expr(f"_qw_at * {n_shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_qw_at") - first).cast("long")).select(*keep, "shard", "slot")


def slice_starts(strata: DataFrame, ranked: DataFrame, cells: int, most_closed: int) -> DataFrame:
    """(_qw_slice, _qw_start): how many rows lie before each slice of the unit interval.

    Strata of equal size fill the slices alike, so the numbers follow from the sizes
    alone: of a stratum with n rows, the ranks r with (2r - 1) * cells < 2jn lie before
    slice j.  Where distinct sizes times slices pass ``most_closed``, the rows of each
    slice are counted instead; both ways give the same numbers.
    """
    sizes = strata.groupBy("_qw_n").agg(F.count(F.lit(1)).alias("m"))
    if sizes.count() * cells > most_closed:
        held = ranked.groupBy("_qw_slice").agg(F.count(F.lit(1)).alias("n")).withColumn("_qw_all", F.lit(0))
        return running_totals(held, ["_qw_all"], "_qw_slice", {"n": "_qw_start"}).drop("_qw_all")
    slices = sizes.select("_qw_n", "m", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_qw_slice"))
    part = F.expr(f"CASE WHEN _qw_slice = 0 THEN 0 ELSE (((2L * _qw_slice * _qw_n - 1) div {cells}L) + 1) div 2 END")
    return slices.groupBy(F.col("_qw_slice").cast("long").alias("_qw_slice")).agg(F.sum(part * F.col("m")).alias("_qw_start"))
