"""Operator 4, mixing sources to target weights by min-cost flow.

Documents may belong to several sources at once.  They are aggregated by
membership pattern; a flow network carries token capacity from patterns to
source quotas, the c-th copy of a token costing more than the (c-1)-th, so the
cheapest flow repeats as little as the quotas allow.  The flow of each pattern
is then filled with documents in a seeded order.

The network has a node per pattern and per source, not per document; documents
are only ever aggregated, and their seeded running sums come from sums per
(pattern, hash bucket) plus a sum inside the one bucket where a document lies.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywright.llm.common import bucket_count, hash_bucket, running_totals, seeded, spread_join, written

#: What a word is: a run of bytes outside the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources with a target up to which they are listed in the plan.
MOST_NAMED = 1_000


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def capped_targets(sizes: list[tuple[str, int]], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes, each at most ``cap`` times its size.

    The excess of capped sources is shared again by weight until none is above; a
    ``share`` beyond ``cap`` leaves all at their caps.
    """
    left, open_ = share * sum(n for _, n in sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= cap * sizes[i][1]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(cap * sizes[i][1])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


class FlowNetwork:
    """Successive shortest paths with potentials; all costs are at least 0."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def edge(self, a: int, b: int, room: float, cost: float) -> int:
        self.out[a].append(len(self.head))
        self.out[b].append(len(self.head) + 1)
        self.head += [b, a]
        self.room += [room, 0.0]
        self.cost += [cost, -cost]
        return len(self.head) - 2

    def flow_on(self, edge: int) -> float:
        return self.room[edge ^ 1]

    def run(self, source: int, sink: int, slack: float = 1e-6) -> float:
        """The cheapest greatest flow.  Each round finds the distances and fills all shortest paths at once."""
        n, sent = len(self.out), 0.0
        lift = [0.0] * n
        while True:
            far = [float("inf")] * n
            far[source], heap = 0.0, [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e] > slack and d + (step := self.cost[e] + lift[a] - lift[self.head[e]]) < far[self.head[e]] - 1e-12:
                        far[self.head[e]] = d + step
                        heapq.heappush(heap, (d + step, self.head[e]))
            if far[sink] == float("inf"):
                return sent
            lift = [x + min(d, far[sink]) for x, d in zip(lift, far, strict=True)]
            while (more := self.fill(source, sink, lift, slack)) > 0:
                sent += more

    def fill(self, source: int, sink: int, lift: list[float], slack: float) -> float:
        """A blocking flow over the edges on shortest paths, by levels from the source."""

        def on_path(a: int, e: int) -> bool:
            return self.room[e] > slack and abs(self.cost[e] + lift[a] - lift[self.head[e]]) < 1e-9

        level, queue = {source: 0}, [source]
        for a in queue:
            for e in self.out[a]:
                if self.head[e] not in level and on_path(a, e):
                    level[self.head[e]] = level[a] + 1
                    queue.append(self.head[e])
        if sink not in level:
            return 0.0
        at, path, sent = {a: 0 for a in level}, [], 0.0
        while True:
            a = self.head[path[-1]] if path else source
            if a == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                sent += push
                path = path[: next(i for i, e in enumerate(path) if self.room[e] <= slack)]
                continue
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                if level.get(self.head[e], -1) == level[a] + 1 and on_path(a, e):
                    path.append(e)
                    break
                at[a] += 1
            else:
                if not path:
                    return sent
                at[self.head[path.pop() ^ 1]] += 1


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, float], copies: int = 2) -> dict[tuple[tuple[str, ...], str], float]:
    """Tokens that each pattern gives each source: the cheapest flow that fills the quotas.

    The c-th copy of a token costs c squared, which is convex, so no token is
    repeated while another of the same source is unused.
    """
    names, keys = sorted(quotas), sorted(patterns)
    source, sink = 0, 1 + len(keys) + len(names)
    net, at = FlowNetwork(sink + 1), {s: 1 + len(keys) + i for i, s in enumerate(names)}
    links = {}
    for i, p in enumerate(keys):
        for c in range(copies):
            net.edge(source, 1 + i, float(patterns[p]), float((c + 1) ** 2))
        for s in p:
            if s in at:
                links[p, s] = net.edge(1 + i, at[s], float("inf"), 0.0)
    for s in names:
        net.edge(at[s], sink, quotas[s], 0.0)
    net.run(source, sink)
    return {k: net.flow_on(e) for k, e in links.items()}


def mix(docs: DataFrame, flows: dict[tuple[str, ...], float], pattern: str, size: str, key: str = "doc_id", seed: int = 4, tie: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``copies`` (int) and ``taken`` (long): documents in seeded order until a pattern's flow is met.

    ``pattern`` names an array column of sorted sources.  A flow F over a pattern of
    S tokens takes every document floor(F / S) times and, once more, those that fit
    into the rest of F in the seeded order; the gap that these leave is filled by
    the document whose size comes nearest to it.  The order is that of a hash of the key
    and the ``tie`` columns, which tell documents of one key (or of none) apart.
    Columns named ``copies`` or ``taken`` are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("copies", "taken")]
    rows = docs.count()
    cells = bucket_count(rows)
    key_of = F.concat_ws("\x1f", F.transform(F.col(pattern), lambda s: F.concat(F.lit("v"), s)))
    order = seeded(seed, F.col(key), *map(F.col, tie))
    base = docs.select(*keep, key_of.alias("_qw_p"), order.alias("_qw_o")).withColumn("_qw_c", hash_bucket(F.col("_qw_o"), cells))
    sums = base.groupBy("_qw_p", "_qw_c").agg(F.sum(size).alias("n"))
    before = running_totals(sums, ["_qw_p"], "_qw_c", {"n": "_qw_before"})
    plan = spark.createDataFrame([("\x1f".join("v" + s for s in p), float(f)) for p, f in flows.items()], "_qw_p string, _qw_f double")
    totals = sums.groupBy("_qw_p").agg(F.sum("n").alias("_qw_s"))
    before = before.join(totals.join(plan, "_qw_p"), "_qw_p")
    inside = Window.partitionBy("_qw_p", "_qw_c").orderBy("_qw_o", F.col(key), size, *tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_qw_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(before, ["_qw_p", "_qw_c"], "left")
    whole = F.when(F.col("_qw_s") > 0, F.floor(F.col("_qw_f") / F.col("_qw_s") + 1e-9)).otherwise(F.lit(0))
    placed = placed.withColumn("_qw_whole", F.coalesce(whole, F.lit(0))).withColumn("_qw_rest", F.coalesce(F.col("_qw_f") - F.col("_qw_whole") * F.col("_qw_s"), F.lit(0.0)))
    # A document's end in the order is its own, since taken ones have a size; it names the document below.
    placed = written(placed.withColumn("_qw_end", F.col("_qw_before") + F.col("_qw_in") + F.col(size)).drop("_qw_c", "_qw_o", "_qw_in", "_qw_before", "_qw_f"), "mix-order")

    fits = (F.col(size) > 0) & (F.col("_qw_end") <= F.col("_qw_rest") + 1e-6)
    # One row for each pattern; documents meet it by joins that are spread over tasks.
    gap = F.max("_qw_rest") - F.coalesce(F.max(F.when(fits, F.col("_qw_end"))), F.lit(0))
    gaps = written(placed.groupBy("_qw_p").agg(gap.alias("_qw_gap"), F.count(F.lit(1)).alias("_qw_m")), "mix-gaps")
    off = F.abs(F.col(size) - F.col("_qw_gap"))
    last = spread_join(placed.where(~fits & (F.col(size) > 0)).select("_qw_p", size, "_qw_end"), gaps, "_qw_p", "_qw_m", rows).where(off < F.col("_qw_gap"))
    last = last.groupBy("_qw_p").agg(F.min(F.struct(off.alias("off"), F.col("_qw_end").alias("end"))).alias("l")).select("_qw_p", F.col("l.end").alias("_qw_last"))
    told = written(gaps.join(last, "_qw_p", "left").select("_qw_p", "_qw_m", "_qw_last"), "mix-last")
    once_more = F.when(fits | F.coalesce(F.col("_qw_end") == F.col("_qw_last"), F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col(size) > 0, F.col("_qw_whole") + once_more).otherwise(0).cast("int")
    chosen = spread_join(placed, told, "_qw_p", "_qw_m", rows).withColumn("copies", copies)
    return chosen.withColumn("taken", (F.col("copies") * F.coalesce(F.col(size), F.lit(0))).cast("long")).select(*keep, "copies", "taken")


def mix_by_membership(docs: DataFrame, members: str, size: str, targets: dict[str, float], most_copies: int = 2, key: str = "doc_id", seed: int = 4, most_patterns: int = 1_000_000, tie: tuple[str, ...] = ()) -> DataFrame:
    """Mix documents that may belong to several sources: ``docs`` with ``copies`` and ``taken``.

    ``members`` names an array column of sources, ``size`` a column of token counts,
    ``targets`` gives each source its quota.  Documents of one membership pattern are
    alike to the flow, whose network has a node for each pattern of sources with a
    target.  The patterns' sums are collected, the documents are not; more than
    ``most_patterns`` of them are refused rather than brought to the driver.

    Defined results: a null or empty membership, null members and sources without a
    target take no part, so such documents have 0 copies; a source whose documents do
    not reach its quota at ``most_copies`` copies falls short of it.
    """
    named = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(members), F.array().cast("array<string>")))))
    # Sources without a target have no say in the flow, so they make no patterns of their own.
    asked = F.array_intersect(named, F.array(*map(F.lit, sorted(targets)))) if len(targets) <= MOST_NAMED else named
    held = docs.withColumn("_qw_pattern", asked)
    sizes = held.groupBy("_qw_pattern").agg(F.sum(size).alias("n")).limit(most_patterns + 1).collect()
    if len(sizes) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    flows = route({tuple(r["_qw_pattern"]): r["n"] or 0 for r in sizes}, targets, most_copies)
    total: dict[tuple[str, ...], float] = {tuple(r["_qw_pattern"]): 0.0 for r in sizes}
    for (p, _), f in flows.items():
        total[p] += f
    return mix(held, total, "_qw_pattern", size, key, seed, tie).drop("_qw_pattern")


def mix_single_sources(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", share: float = 1.5, cap: float = 2.0, cycle: tuple[int, ...] = (3, 1, 2), seed: int = 4, most_sources: int = 1_000_000) -> DataFrame:
    """Mix documents that belong to one source each, weights going round ``cycle`` over the sorted sources.

    Returns key, source, size, source_size, target, copies, taken, and ``_qw_th``, the
    text's digest.  Sources sort by code point, null last.  Null and blank texts have size 0
    and are never taken; sources without words get target 0.  Rows with a null key are
    mixed as others are; repeated rows are rows of their own; texts are counted whole; an
    empty table gives an empty result; other columns are left out.
    """
    # UTF-8 bytes sort as code points do; a null source gets a mark of its own.
    mark = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    own = text_digest(F.col(text)).alias("_qw_th")
    sized = written(docs.select(F.col(key), F.col(source), word_count(F.col(text)).alias("size"), mark.alias("_qw_mark"), own), "mix-sizes")
    # Targets need all sources at once: one row for each.
    per_source = sized.groupBy("_qw_mark").agg(F.sum("size").alias("n")).limit(most_sources + 1).collect()
    if len(per_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = sorted(((r["_qw_mark"], r["n"]) for r in per_source), key=lambda x: x[0])
    weights = [float(cycle[i % len(cycle)]) for i in range(len(sizes))]
    targets = capped_targets(sizes, weights, share, cap)
    quotas = {m: t for (m, _), t in zip(sizes, targets, strict=True)}
    mixed = mix_by_membership(sized.withColumn("_qw_of", F.array("_qw_mark")), "_qw_of", "size", quotas, max(1, int(cap)), key, seed, tie=("_qw_th",))
    spark = docs.sparkSession
    info = spark.createDataFrame([(m, n, t) for (m, n), t in zip(sizes, targets, strict=True)], "_qw_mark string, source_size long, target double")
    return mixed.join(F.broadcast(info) if len(sizes) <= MOST_NAMED else info, "_qw_mark", "left").select(key, source, "size", "source_size", "target", "copies", "taken", "_qw_th")


def repeat_taken(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; rows of equal key and text go together.

    Null and blank texts are never taken.
    """
    taken = mix_single_sources(docs, source, text, key, **options)
    counts = taken.where("copies > 0").groupBy(F.col(key).alias("_qw_k"), F.col("_qw_th").alias("_qw_t")).agg(F.max("copies").alias("_qw_copies"))
    named = docs.withColumn("_qw_h", text_digest(F.col(text)))
    met = named.join(counts, named[key].eqNullSafe(counts["_qw_k"]) & (named["_qw_h"] == counts["_qw_t"]))
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_qw_copies"))).alias("_qw_copy")).select(*docs.columns)
