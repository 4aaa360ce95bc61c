"""Operator 9, benchmark decontamination by spaced seeds; DataFrame functions only.

A seed mask looks at some of the tokens of a window and ignores the others, so a
window still matches where an ignored token was replaced.  The hashes of all
masked windows of the test items are joined with those of the documents; around
each hit the document is laid over the item without gaps, and the best run of
``window`` aligned tokens is counted.  A document is reported for an item if
that run has at most ``window - least`` replaced tokens (for an item shorter
than the window: the same share of its tokens).

The items' windows are broadcast while their number is under a bound that is
checked; then documents are not shuffled: their windows are made and probed inside
one stage.  Beyond the bound windows are joined by a shuffle.  Both ways give the
same rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywright.llm.common import spread_join, written

#: Offsets of the tokens that each mask looks at, from 0 on.  Whichever two tokens of a
#: run of 13 are replaced, or whichever one of an item of 10 to 12, some mask misses them.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 3, 4, 5))
#: Items of fewer tokens are sought by the longest run that their replaced tokens must leave whole.
SHORT_ITEM = 10
TOKEN = r"[\p{L}\p{M}\p{N}]+"
#: Windows of the test items up to which they are broadcast: about 60 bytes each.
MOST_BROADCAST = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; none for a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def window_starts(hashes: Column, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """Every position that some mask can stand at; none in a text shorter than they all reach."""
    reach = min(m[-1] for m in masks)
    return F.when(F.size(hashes) > reach, F.sequence(F.lit(0), F.size(hashes) - reach - 1)).otherwise(F.array().cast("array<int>"))


def masked_hash(hashes: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    """The hash of the tokens that a mask looks at from a position on, and of the mask's number; null where it reaches too far."""
    return F.when(F.size(hashes) > at + mask[-1], F.xxhash64(*[F.get(hashes, at + o) for o in mask], F.lit(number)))


def masks_for(lengths: list[int], window: int, least: int) -> tuple[tuple[int, ...], ...]:
    """``MASKS``, and a mask of adjacent tokens for each kind of short item that there is."""
    runs = set()
    for n in lengths:
        w = min(n, window)
        spare = w - -(-w * least // window)
        runs.add(-(-(w - spare) // (spare + 1)))
    return (*MASKS, *[tuple(range(k)) for k in sorted(runs)])


def seeds(frame: DataFrame, hashes: str, keep: list[str], masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """``keep`` columns, ``pos`` (int) and ``h`` (long), a row for each window and mask."""
    at = frame.select(*dict.fromkeys([*keep, hashes]), F.explode(window_starts(F.col(hashes), masks)).alias("pos"))
    every = [F.struct("pos", masked_hash(F.col(hashes), F.col("pos"), m, i).alias("h")) for i, m in enumerate(masks)]
    return at.select(*keep, F.explode(F.array(*every)).alias("w")).select(*keep, "w.pos", "w.h").where("h is not null")


def best_runs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, item_text: str, window: int, least: int, most_broadcast: int, salts: int) -> DataFrame:
    """(_d, _t, _i, r) of every alignment within the tolerance; _t is the text's hash, r a struct that ascends with merit."""
    tests = items.select(F.col(item_key).alias("_i"), token_hashes(F.col(item_text)).alias("_ih")).where(F.size("_ih") > 0).distinct()
    # Items that share a key but differ in text are told apart by a number of their own.
    tests = tests.withColumn("_u", F.xxhash64("_i", "_ih"))
    told = tests.agg(F.coalesce(F.sum(F.size("_ih")), F.lit(0)).alias("n"), F.collect_set(F.when(F.size("_ih") < SHORT_ITEM, F.size("_ih"))).alias("short")).first()
    masks = masks_for(told["short"], window, least)
    small = told["n"] * len(masks) <= most_broadcast
    # Long items use the masks that all have; short ones only those made for them.
    sized = tests.withColumn("_n", F.size("_ih"))
    sought = seeds(sized.where(F.col("_n") >= SHORT_ITEM), "_ih", ["_u", "_n"])
    for k in range(len(MASKS), len(masks)):
        mine = [n for n in told["short"] if masks_for([n], window, least)[-1] == masks[k]]
        at = sized.where(F.col("_n").isin(mine)).select("_u", "_n", "_ih", F.explode(window_starts(F.col("_ih"), (masks[k],))).alias("pos"))
        sought = sought.unionByName(at.select("_u", "_n", "pos", masked_hash(F.col("_ih"), F.col("pos"), masks[k], k).alias("h")))

    # Documents are told apart by key and text, however often either is repeated.
    hashed = docs.select(F.col(doc_key).alias("_d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"), token_hashes(F.col(text)).alias("_dh"))
    one_hit = ["_d", "_t", "_u", "shift"]
    if small:
        # Equal windows of one item at other places are kept: each place has its own alignment.
        probes = sought.groupBy("h").agg(F.collect_list(F.struct("_u", "_n", "pos")).alias("sites"))
        # One row per window; its hashes are taken after the explode, where generated code reads
        # the document's array in place.  Any mask may hit, and only hits are kept.
        rows = hashed.select("_d", "_t", "_dh", F.explode(window_starts(F.col("_dh"), masks)).alias("dpos"))
        for i, m in enumerate(masks):
            rows = rows.withColumn(f"_h{i}", masked_hash(F.col("_dh"), F.col("dpos"), m, i))
        for i in range(len(masks)):
            rows = rows.join(F.broadcast(probes.select(F.col("h").alias(f"_h{i}"), F.col("sites").alias(f"_s{i}"))), f"_h{i}", "left")
        found = [F.col(f"_s{i}") for i in range(len(masks))]
        met = rows.where(functools.reduce(lambda a, b: a | b, [s.isNotNull() for s in found]))
        met = met.select("_d", "_t", "_dh", "dpos", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("s"))
        hits = met.select("_d", "_t", "s._u", "s._n", (F.col("dpos") - F.col("s.pos")).alias("shift"), "_dh")
        # Of the document only what lies under the item goes along, once for each item and place.
        hits = under(hits, window).dropDuplicates(one_hit)
        hits = hits.join(F.broadcast(tests), "_u")
    else:
        # Windows are joined by key without their texts; a window that very many documents hold is
        # spread over salts.  Texts are looked up for the documents hit.
        rows = seeds(hashed, "_dh", ["_d", "_t"], masks).withColumnRenamed("pos", "dpos")
        rows = rows.withColumn("z", F.pmod(F.xxhash64("_d", "_t", "dpos"), F.lit(salts)).cast("int"))
        met = rows.join(sought.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["h", "z"])
        met = met.select("_d", "_t", "_u", "_n", (F.col("dpos") - F.col("pos")).alias("shift")).distinct()
        met = written(met, "leak-hits")
        named = hashed.withColumnsRenamed({"_d": "_d2", "_t": "_t2"})

        def same(other: DataFrame) -> Column:
            return other["_d"].eqNullSafe(named["_d2"]) & (other["_t"] == named["_t2"])

        held = met.select("_d", "_t").distinct()
        named = named.join(held, same(held), "left_semi").dropDuplicates(["_d2", "_t2"])
        hits = under(met.join(named, same(met)).select(*met.columns, "_dh"), window)
        weights = met.groupBy("_u").agg(F.count(F.lit(1)).alias("m"))
        hits = spread_join(hits, tests.join(weights, "_u"), "_u", "m", met.count()).drop("m")

    # Lay the item over the document: item token first + j stands over the j-th one of the part.
    same_token = F.zip_with("part", F.slice("_ih", F.col("first") + 1, F.size("part")), lambda a, b: F.when(a == b, 1).otherwise(0))
    hits = hits.select("_d", "_t", "_i", "first", "shift", same_token.alias("same"), F.least(F.lit(window), F.col("_n")).alias("w"))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("w") + 1),
        lambda i: F.struct(F.aggregate(F.slice("same", i, F.col("w")), F.lit(0), lambda s, x: s + x).alias("m"), (-i).alias("i")),
    )
    best = hits.select("_d", "_t", "_i", "first", "shift", "w", F.array_max(runs).alias("b"))
    passed = best.where(F.col("b.m") * window >= F.col("w") * least)
    row = F.struct(F.col("b.m").alias("m"), (-(F.col("shift") + F.col("first") - F.col("b.i") - 1)).alias("nd"), (-(F.col("first") - F.col("b.i") - 1)).alias("ni"), F.col("w"))
    return passed.select("_d", "_t", "_i", row.alias("r"))


def under(hits: DataFrame, window: int) -> DataFrame:
    """``hits`` with ``first`` (int) and ``part`` for ``_dh``: the document's tokens under the item, if enough for a run."""
    first, n = F.greatest(F.lit(0), -F.col("shift")), F.least(F.col("_n"), F.size("_dh") - F.col("shift"))
    enough = hits.withColumn("first", first).where(n - F.col("first") >= F.least(F.lit(window), F.col("_n")))
    return enough.withColumn("part", F.slice("_dh", F.col("shift") + F.col("first") + 1, n - F.col("first"))).drop("_dh")


def overlaps(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", window: int = 13, least: int = 11, most_broadcast: int = MOST_BROADCAST, salts: int = 16) -> DataFrame:
    """(doc_key, item_key, matched int, compared int, doc_pos int, item_pos int): each document's best run with each item.

    ``matched`` of ``compared`` aligned tokens agree; the positions are those of the
    run's first token.

    Defined results: null texts and those without tokens match nothing, nor does a
    document with fewer tokens than ``compared``; texts are read whole, however long;
    repeated rows of a document or an item are reported once, and texts that share a key
    by their best run; null keys are kept as keys; runs that tie are settled by the
    smallest positions; an empty table on either side gives an empty result; other
    columns are left out.
    """
    found = best_runs(docs, items, doc_key, item_key, text, item_text, window, least, most_broadcast, salts)
    top = found.groupBy("_d", "_i").agg(F.max("r").alias("r"))
    return top.select(
        F.col("_d").alias(doc_key),
        F.col("_i").alias(item_key),
        F.col("r.m").cast("int").alias("matched"),
        F.col("r.w").cast("int").alias("compared"),
        (-F.col("r.nd")).cast("int").alias("doc_pos"),
        (-F.col("r.ni")).cast("int").alias("item_pos"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", window: int = 13, least: int = 11, most_broadcast: int = MOST_BROADCAST, salts: int = 16) -> DataFrame:
    """``docs`` without the rows whose text holds a run of an item, as ``overlaps`` finds them.

    Rows are told apart by key and text: another text under the same key stays, and a
    text without a key goes if it holds a run.
    """
    bad = best_runs(docs, items, doc_key, item_key, text, item_text, window, least, most_broadcast, salts).select(F.col("_d").alias("_qw_k"), F.col("_t").alias("_qw_t")).distinct()
    named = docs.withColumn("_qw_th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return named.join(bad, named[doc_key].eqNullSafe(bad["_qw_k"]) & (named["_qw_th"] == bad["_qw_t"]), "left_anti").select(*docs.columns)
