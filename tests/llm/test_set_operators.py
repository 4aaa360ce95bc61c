"""WARC round trips, mixing, near duplicates, decontamination and sharding against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querywright.llm import interleave, jaccard, mixing, spaced, warc
from querywright.llm.common import KeyRanges, spread_join
from querywright.llm.components import components

LONG = "lorem ipsum " * 20_000


def pages(spark):
    big = "<p>" + "x" * 300 + "</p>"
    rows = [(5, "http://a", big), (3, "http://b c\r\nX: y", big), (9, None, big), (4, "u", "small"), (2, "u", "small"), (1, "u", None), (7, "u", ""), (8, "u", "é" * 50), (6, "u", "é" * 50), (10, "u", LONG)]
    rows += [(20 + i, f"http://p/{i}", f"<p>{i}</p>" * (i * 7)) for i in range(60)]
    rows += [(3, "http://b", big), (None, "u", "no key" * 30)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_archives_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    root = f"file://{tmp_path}/one"
    manifest = warc.write_archives(df, root, roll_bytes=700, shard_bytes=4000)
    assert manifest.count() > 6 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert not (tmp_path / "one" / "_temporary").exists()
    got = warc.read_archives(spark, root).collect()
    assert len(got) == len(rows)
    first = {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", key)
    seen = Counter()
    for r in got:
        kind = r["record_type"]
        source = [h or "" for k, _, h in rows if k == r["page_id"] and hashlib.sha256((h or "").encode()).hexdigest() == r["payload_digest"]]
        assert source and r["payload_bytes"] == len(source[0].encode())
        seen[r["page_id"], kind] += 1
        if kind == "response":
            assert bytes(r["payload"]) == source[0].encode() and r["refers_to"] is None
        else:
            assert len(source[0].encode()) >= 100 and r["refers_to"] == first[source[0]]
    assert seen[3, "response"] == 1 and seen[3, "revisit"] == 1 and seen[5, "revisit"] == 1 and seen[9, "revisit"] == 1
    assert seen[8, "revisit"] == 1 and seen[6, "response"] == 1 and seen[2, "response"] == seen[4, "response"] == 1
    again = f"file://{tmp_path}/two"
    warc.write_archives(df.repartition(3), again, roll_bytes=700, shard_bytes=4000)
    files = {p.name: p.read_bytes() for p in Path(tmp_path, "one").glob("*.warc.gz")}
    assert files == {p.name: p.read_bytes() for p in Path(tmp_path, "two").glob("*.warc.gz")}
    listed = {r["final"]: r["sha256"] for r in manifest.collect()}
    assert listed == {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}


def test_archives_of_a_key_that_most_rows_share(spark, tmp_path):
    rows = [(7 if i % 2 else None, "u", f"<p>{i // 4}</p>" * 40) for i in range(120)] + [(1, "u", "<p>1</p>" * 40), (9, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = f"file://{tmp_path}/hot"
    manifest = warc.write_archives(df, root, shard_bytes=2000)
    assert manifest.select("shard").distinct().count() > 8
    got = warc.read_archives(spark, root).collect()
    seen = Counter((r["page_id"], r["payload_digest"]) for r in got)
    assert seen == Counter((k, hashlib.sha256((h or "").encode()).hexdigest()) for k, _, h in rows)
    first = {}
    for k, _, h in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        first.setdefault(hashlib.sha256((h or "").encode()).hexdigest(), k)
    for r in got:
        assert r["record_type"] == "response" or r["refers_to"] == first[r["payload_digest"]]
    assert Counter(r["payload_digest"] for r in got if r["record_type"] == "response") == Counter(list(first))


def test_key_ranges_cut_heavy_keys(spark):
    rows = [(5, i * 7919 * 1000003 % (1 << 32), 10) for i in range(300)] + [(k, 0, 10) for k in range(-50, 50) if k != 5]
    df = spark.createDataFrame(rows, "k long, s long, n long")
    ranges = KeyRanges(df, "k", "n", 20)
    got = df.withColumn("r", ranges.bucket(F.col("k"), F.col("s"))).collect()
    held = Counter(r["r"] for r in got)
    assert set(held) <= set(range(len(ranges))) and max(held.values()) <= 60
    by = sorted((r["k"], r["s"], r["r"]) for r in got)
    assert [x[2] for x in by] == sorted(x[2] for x in by)


def test_archives_of_an_empty_table(spark, tmp_path):
    _, df = pages(spark)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_repeated_commit_does_no_harm(tmp_path):
    store = warc.Store(f"file://{tmp_path}")
    with store.write("_temporary/a") as f:
        f.write(b"abc")
    store.move("_temporary/a", "final", 3)
    store.move("_temporary/a", "final", 3)
    assert (tmp_path / "final").read_bytes() == b"abc"


def test_damaged_archives_are_refused(spark, tmp_path):
    _, df = pages(spark)
    root = f"file://{tmp_path}/bad"
    warc.write_archives(df.where("page_id = 8"), root)
    import gzip

    path = next(Path(tmp_path, "bad").glob("*.warc.gz"))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace("é".encode(), "è".encode(), 1)))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, root).collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_are_capped_and_reshared(sizes):
    named = [(f"s{i:02d}", n) for i, n in enumerate(sizes)]
    weights = [float((3, 1, 2)[i % 3]) for i in range(len(sizes))]
    got = mixing.capped_targets(named, weights, 1.5, 2.0)
    assert all(t <= 2 * n + 1e-6 for t, (_, n) in zip(got, named, strict=True))
    assert sum(got) == pytest.approx(1.5 * sum(sizes), abs=1e-6)
    units = [t / w for t, w, (_, n) in zip(got, weights, named, strict=True) if t < 2 * n - 1e-6]
    assert not units or max(units) - min(units) < 1e-6 * max(1, max(units))


def test_overlapping_sources_share_documents_at_least_cost():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    flow = mixing.route(patterns, {"a": 100.0, "b": 110.0})
    assert flow[("a",), "a"] == pytest.approx(100) and flow[("a", "b"), "b"] == pytest.approx(100) and flow[("b",), "b"] == pytest.approx(10)
    twice = mixing.route({("a",): 100}, {"a": 150.0})
    assert twice[("a",), "a"] == pytest.approx(150)
    assert mixing.route({("a",): 100}, {"a": 900.0})[("a",), "a"] == pytest.approx(200)


def least_cost(patterns, quotas, copies=2):
    """(tokens sent, cost) of the best whole-number flow, by trying all of them."""
    best = (0, 0)
    links = [(p, s) for p in patterns for s in p if s in quotas]
    tops = [range(min(copies * patterns[p], quotas[s]) + 1) for p, s in links]
    for sent in itertools.product(*tops):
        used, got = Counter(), Counter()
        for (p, s), n in zip(links, sent, strict=True):
            used[p] += n
            got[s] += n
        if all(n <= copies * patterns[p] for p, n in used.items()) and all(n <= quotas[s] for s, n in got.items()):
            cost = sum(min(max(n - c * patterns[p], 0), patterns[p]) * (c + 1) ** 2 for p, n in used.items() for c in range(copies))
            best = max(best, (sum(sent), -cost))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=3), st.lists(st.integers(0, 6), min_size=2, max_size=2))
def test_flow_costs_as_little_as_any(sizes, quotas):
    patterns = dict(zip([("a",), ("a", "b"), ("b",)], sizes, strict=True))
    flow = mixing.route(patterns, {"a": float(quotas[0]), "b": float(quotas[1])})
    used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in patterns}
    cost = sum(min(max(n - c * patterns[p], 0), patterns[p]) * (c + 1) ** 2 for p, n in used.items() for c in range(2))
    assert (sum(used.values()), -cost) == pytest.approx(least_cost(patterns, dict(zip("ab", quotas, strict=True))))


def test_flow_of_many_patterns():
    rng = random.Random(6)
    names = [f"s{i}" for i in range(12)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 4)))): rng.randint(1, 50) for _ in range(3000)}
    total = sum(patterns.values())
    flow = mixing.route(patterns, {s: total / 12 for s in names})
    assert sum(flow.values()) == pytest.approx(total, rel=0.01)
    with_lots = {s: total for s in names}
    assert sum(mixing.route(patterns, with_lots).values()) == pytest.approx(2 * total)


def test_too_many_patterns_are_refused(spark):
    df = spark.createDataFrame([(i, [f"s{i}"], 1) for i in range(5)], "doc_id long, members array<string>, n long")
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix_by_membership(df, "members", "n", {f"s{i}": 1.0 for i in range(5)}, most_patterns=3)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, [["a"], ["a", "b"], ["b"], ["b", "a", "a"], None, [None], ["c"]][i % 7], 10) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, n long")
    got = mixing.mix_by_membership(df, "members", "n", {"a": 1500.0, "b": 2600.0}).collect()
    taken = Counter()
    for r in got:
        taken[tuple(sorted({m for m in r["members"] or [] if m}))] += r["taken"]
        assert r["copies"] <= 2
    assert sum(taken.values()) == pytest.approx(4100, abs=20)
    assert taken[("c",)] == taken[()] == 0
    # Nothing need be repeated: 4,000 tokens are there once, so 100 of them twice.
    assert sum(r["copies"] == 2 for r in got) * 10 == pytest.approx(100, abs=20)


def mixed_docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), rng.choice(["hot"] * 5 + ["x", "ä", None])) for i in range(900)]
    rows += [(2000, None, "x"), (2001, " \t\n", "x"), (2002, "a\x0bb c", "null words only"), (5, rows[5][1], rows[5][2]), (None, "no key here", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1.5))


def test_mix_meets_its_targets_and_reruns_agree(spark):
    rows, df = mixed_docs(spark)
    got = mixing.mix_single_sources(df).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted(groups, key=lambda s: (s is None, (s or "").encode()))
    sizes = [(s or "", sum(r["size"] for r in groups[s])) for s in order]
    targets = mixing.capped_targets(sizes, [float((3, 1, 2)[i % 3]) for i in range(len(order))], 1.5, 2.0)
    for s, (_, n), t in zip(order, sizes, targets, strict=True):
        assert {r["source_size"] for r in groups[s]} == {n} and groups[s][0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in groups[s]) - t) <= (3 if len(groups[s]) > 30 else 60)
    again = mixing.mix_single_sources(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    repeated = mixing.repeat_taken(df)
    assert repeated.columns == df.columns and repeated.count() == sum(r["copies"] for r in got)
    assert mixing.mix_single_sources(df.limit(0)).count() == 0


def near_docs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=80) for _ in range(30)]
    rows, k = [], 0
    for b in base:
        for _ in range(rng.randint(1, 9)):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(80)] = rng.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    rows += [(1000 + i, rows[3][1].upper()) for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "two words"), (2004, "Two, words!"), (2005, LONG), (2006, LONG + "tail"), (2007, LONG), (7, rows[7][1])]
    return rows


def brute_groups(rows, threshold=0.8):
    """(id, class id, links) of each row by comparing all pairs of rows; ids sort before none, then texts by hash."""
    sets = []
    for _, t in rows:
        w = jaccard.WORDS((t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([("raw", t or "")]))
    forest, links = jaccard.Forest(len(rows)), Counter()
    place = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for a in range(len(place)):
        for b in range(a + 1, len(place)):
            i, j = place[a], place[b]
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                forest.join(a, b)
    return Counter((rows[i][0], rows[place[forest.root(a)]][0], links[i]) for a, i in enumerate(place))


@pytest.mark.parametrize("block", [512, 3])
def test_groups_and_links_equal_brute_force(spark, block):
    rows = near_docs(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similarity_groups(df, block=block).collect())
    assert got == brute_groups(rows)
    kept = jaccard.keep_first_of_group(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in got}) and kept.columns == df.columns


def test_texts_that_share_an_id_or_have_none(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(rng.choices([f"w{i}" for i in range(900)], k=60)) for _ in range(5))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (None, c), (None, c + " more"), (None, a), (9, d), (9, d), (9, e), (9, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("note", F.lit(1))
    got = jaccard.similarity_groups(df).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_groups(rows)
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_first_of_group(df).collect())
    lone = [x for x in kept if x[0] is None]
    assert kept - Counter(lone) == Counter([(1, a), (5, b), (9, d), (9, e), (9, None)])
    assert len(lone) == kept[lone[0]] == 1 and lone[0][1] in (c, c + " more")


@pytest.mark.parametrize("least", [0, 10_000])
def test_spread_joins_equal_plain_ones(spark, least):
    rows = spark.createDataFrame([(i, None if i % 50 == 49 else i % 7 if i % 3 else 0) for i in range(400)], "x long, k long")
    table = rows.where("k < 6").groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    got = spread_join(rows, table, "k", "m", 400, most_hot=3, least=least)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(table, "k").select(*got.columns).collect()))


def test_groups_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.similarity_groups(spark.createDataFrame([], schema)).count() == 0
    assert jaccard.keep_first_of_group(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], schema)
    assert sorted((tuple(r) for r in jaccard.similarity_groups(df).collect()), key=str) == [(1, 1, 1, 2), (None, 1, 1, 2), (None, 1, 1, 2)]
    assert [r["doc_id"] for r in jaccard.keep_first_of_group(df).collect()] == [1]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_bands_find_pairs_of_measured_similarity(similarity):
    # Sets that share just enough: a candidate pair needs one equal band key.
    rng = np.random.default_rng(5)
    signer, found, size = jaccard.Signer(*jaccard.choose_bands(0.8, 0.9995)), 0, 90
    both = math.ceil(2 * size * similarity / (1 + similarity))
    for _ in range(400):
        grams = rng.integers(0, 1 << 63, 2 * size - both, np.uint64)
        a, b = np.sort(grams[:size]), np.sort(grams[size - both :])
        found += bool(set(signer.keys(a)) & set(signer.keys(b)))
    assert found >= 398


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("path", [[*range(1, 500), 0], random.Random(3).sample(range(500), 500)], ids=["smallest last", "shuffled"])
def test_components_of_wide_paths(spark, path):
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(x, 0) for x in path}


def brute_overlaps(docs, items, window=13, least=11):
    """Every item laid over every document at every place; no seeds."""
    import regex

    split = regex.compile(spaced.TOKEN).findall
    out = {}
    for d, t in docs:
        a = split((t or "").lower())
        for i, u in items:
            b = split((u or "").lower())
            w = min(window, len(b))
            best = 0
            for shift in range(w - len(b), len(a) - w + 1):
                same = [a[x] == b[x - shift] for x in range(max(0, shift), min(len(a), shift + len(b)))]
                best = max([best, *(sum(same[k : k + w]) for k in range(len(same) - w + 1))])
            if best * window >= w * least and best:
                out[d, i] = max(out.get((d, i), (0, 0)), (best, w))
    return out


def leak_tables():
    rng = random.Random(9)
    words = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([12, 25, 40, 60, 15, 5])]
    docs = []
    for d in range(60):
        t = rng.choices(words, k=80)
        if d % 3 == 0:
            part = items[d % 5][1].split()
            for _ in range(d % 4):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(40)
            t[at : at + len(part)] = part
        docs.append((d, " ".join(t)))
    docs += [(100, None), (101, ""), (102, items[1][1].upper()), (103, LONG + items[2][1]), (104, items[1][1]), (104, items[1][1]), (None, items[3][1])]
    return docs, items + [(7, None), (8, ""), (1, items[1][1])]


@pytest.mark.parametrize("bound", [spaced.MOST_BROADCAST, 0])
def test_overlaps_equal_brute_force(spark, bound):
    docs, items = leak_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = spaced.overlaps(d, b, most_broadcast=bound).collect()
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["compared"]) for r in got} == brute_overlaps([x for x in docs if x[0] != 103], items) | {(103, 2): (13, 13)}
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert all("Python" not in line for line in spaced.overlaps(d, b)._jdf.queryExecution().toString().splitlines())
    kept = spaced.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {x for x, _ in docs} - {r["doc_id"] for r in got}


@pytest.mark.parametrize("bound", [spaced.MOST_BROADCAST, 0])
def test_overlaps_reach_the_whole_tolerance(spark, bound):
    docs, items = [], []
    for n in range(1, 14):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        spare = next(x for x in reversed(range(n)) if (n - x) * 13 >= n * 11)
        for bad in itertools.combinations(range(n), spare):
            docs.append((f"{n}:{bad}", n, n - spare, " ".join(["a", *("r" if k in bad else t for k, t in enumerate(item)), "b"])))
    d = spark.createDataFrame([(x, t) for x, _, _, t in docs], "doc_id string, text string")
    got = spaced.overlaps(d, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=bound).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in got} == {(x, n, m) for x, n, m, _ in docs}


@pytest.mark.parametrize("bound", [spaced.MOST_BROADCAST, 0])
def test_leaks_of_rows_that_share_a_key_or_have_none(spark, bound):
    item = " ".join(f"i{k}" for k in range(20))
    docs = [(1, "a clean text"), (1, "x " + item), (1, item[:30]), (None, "y " + item), (None, "another clean text"), (2, item), (2, item), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (1, "z " + item[:60]), (None, item)], "item_id long, text string")
    got = spaced.overlaps(d, b, most_broadcast=bound).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in got} == {(x, y, 13) for x in (1, 2, None) for y in (1, None)} and len(got) == 6
    kept = spaced.drop_contaminated(d, b, most_broadcast=bound)
    assert Counter(map(tuple, kept.collect())) == Counter([docs[0], docs[2], docs[4], docs[7]])


def test_overlaps_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert spaced.overlaps(d, b).count() == 0 and spaced.overlaps(d.limit(0), spark.createDataFrame([(1, "a " * 30)], b.schema)).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_match_the_mixture(spark, shards):
    rng = random.Random(10)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), "x" * (i % 9)) for i in range(1500)]
    rows += [(3, rows[3][1], rows[3][2])] * 3 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit("clash")).withColumn("n", F.lit(1))
    out = interleave.interleave(df, shards, tie=("text",))
    got = out.collect()
    assert len(got) == len(rows) and sorted(out.columns) == sorted(["doc_id", "source", "text", "n", "shard", "slot"])
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(shards))
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    total = Counter(r["source"] for r in got)
    for v in by.values():
        here = Counter(r["source"] for r in v)
        assert all(abs(here[s] - n * len(v) / len(got)) <= 2.5 for s, n in total.items())
    again = interleave.interleave(df.repartition(3), shards, tie=("text",)).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)


@pytest.mark.parametrize("most_closed", [20_000_000, 0])
def test_shards_equal_a_plain_sort(spark, most_closed):
    rng = random.Random(13)
    rows = [(i, rng.choice(["hot"] * 4 + ["b", "c", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    ranked = defaultdict(list)
    for i, s in rows:
        ranked[s].append((hashlib.md5(f"10:{i}".encode()).hexdigest(), i))
    at = []
    for s, held in ranked.items():
        at += [(Fraction(2 * r + 1, 2 * len(held)), "n" if s is None else "v" + s, i) for r, (_, i) in enumerate(sorted(held))]
    want, slots = {}, Counter()
    for place, (_, _, i) in enumerate(sorted(at)):
        shard = place * 9 // len(at)
        want[i] = (shard, slots[shard])
        slots[shard] += 1
    got = interleave.interleave(df, 9, most_closed=most_closed).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want


def test_shards_of_few_rows(spark):
    schema = "doc_id long, source string, text string"
    assert interleave.interleave(spark.createDataFrame([], schema), 40).count() == 0
    few = interleave.interleave(spark.createDataFrame([(1, "a", "x"), (2, "b", None)], schema), 40).collect()
    assert sorted(r["slot"] for r in few) == [0, 0] and len({r["shard"] for r in few}) == 2
    with pytest.raises(ValueError):
        interleave.interleave(spark.createDataFrame([], schema), 0)
