"""The corpus pipeline, stage by stage, over a table with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querywright.llm import jaccard, langid
from querywright.llm.common import written
from querywright.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    english = "the of and to in is that it was for on with as are this be have from or one had by word but not what all were we when".split()
    item = " ".join(f"{rng.choice(english)}q{i}" for i in range(40))
    rows = []
    for i in range(300):
        words = [f"{rng.choice(english)}{chr(97 + rng.randrange(26))}" if k % 2 else rng.choice(english) for k in range(60)]
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "b", None]), 0))
    rows[10] = (10, rows[9][1], "en", "a", 0)
    rows[12] = (12, rows[11][1] + " more", "en", "a", 0)
    rows[20] = (20, rows[20][1] + " " + item, "en", "b", 0)
    rows += [(900, None, None, "a", None), (901, "", "en", "a", 0), (902, "12 34", "de", None, 0), (903, "the of and " * 20_000, None, "b", 0), (9, rows[9][1], "en", rows[9][3], 0)]
    # A text without an id, one that is a copy, one that holds the item; and another text under an id that is taken.
    rows += [(None, rows[50][1][::-1], "en", "a", 0), (None, rows[13][1], "en", "b", 0), (None, rows[60][1][::-1] + " " + item, "en", "b", 0), (14, rows[70][1][::-1] + " the of", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_in_order(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "shards":
            assert docs.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in d.collect()} for n, (_, d) in seen.items()}
    assert ids["language"] == set(range(300)) | {903, None}
    assert ids["near_duplicates"] == ids["language"] - {10, 12}
    held = [r["doc_id"] for r in seen["near_duplicates"][1].collect()]
    assert held.count(9) == 1 and held.count(14) == 2 and held.count(None) == 2
    assert ids["benchmark_leaks"] == ids["near_duplicates"] - {20}
    assert ids["source_mix"] <= ids["benchmark_leaks"]
    assert seen["shards"][1].count() == seen["source_mix"][1].count() and {"shard", "slot"} < set(seen["shards"][1].columns)
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "shard", "slot"]
    assert Counter(map(tuple, whole.select(*key).collect())) == Counter(map(tuple, seen["shards"][1].select(*key).collect()))


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    names = ["size", "copies", "shard", "slot", "class_id", "p", "id", "t", "k", "n", "h", "score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    for c in names:
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        assert out.count() > 0
        if name != "shards":
            assert out.columns == docs.columns


def brute_language(rows, model):
    """Rows of a text whose likeliest language is sure enough, one text at a time."""
    kept = []
    for r in rows:
        (name,), (score,) = model.predict([r[1]])
        if name != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            kept.append(r)
    return kept


def brute_near(rows):
    """One row of each component of pairs at 0.8, all pairs compared: the smallest id, none last."""
    sets = []
    for r in rows:
        w = jaccard.WORDS(r[1].lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    forest = jaccard.Forest(len(rows))
    for a, i in enumerate(order):
        for b in range(a):
            j = order[b]
            if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j]):
                forest.join(a, b)
    return [rows[i] for a, i in enumerate(order) if forest.root(a) == a]


def brute_leaks(rows, items):
    """Rows without a run of 13 tokens of an item with at most two of them replaced, every place tried."""
    kept = []
    for r in rows:
        a = jaccard.WORDS(r[1].lower())
        found = False
        for item in items:
            b = jaccard.WORDS((item or "").lower())
            places = ((x, y) for y in range(len(b) - 12) for x in range(len(a) - 12))
            # Of three tokens in a row one at least agrees, as two at most are replaced.
            found = found or any(sum(map(str.__eq__, a[x : x + 13], b[y : y + 13])) >= 11 for x, y in places if a[x + 6] == b[y + 6] or a[x + 7] == b[y + 7] or a[x + 8] == b[y + 8])
        if not found:
            kept.append(r)
    return kept


def brute_mix(rows):
    """Each row as often as its source's quota takes it, in the seeded order."""
    size = {r: len([w for w in re.split(r"[\x20\x09-\x0D]+", r[1]) if w]) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(size[r] for r in by[s]) for s in names]
    left, targets, open_ = 1.5 * sum(totals), {}, list(range(len(names)))
    weight = [(3, 1, 2)[i % 3] for i in range(len(names))]
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * unit >= 2 * totals[i]]
        for i in full or open_:
            targets[names[i]] = 2 * totals[i] if full else weight[i] * unit
        left -= sum(2 * totals[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    out = []
    for s, total in zip(names, totals, strict=True):
        whole = int(targets[s] / total + 1e-9)
        rest, end, ends = targets[s] - whole * total, 0, []
        for r in sorted(by[s], key=lambda r: hashlib.md5(f"4:{'null' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()):
            end += size[r]
            ends.append((r, end))
        fits = [(r, e) for r, e in ends if e <= rest + 1e-6]
        gap = rest - max((e for _, e in fits), default=0)
        near = min(((abs(size[r] - gap), e) for r, e in ends[len(fits) :] if abs(size[r] - gap) < gap), default=(0, None))[1]
        for r, e in ends:
            out += [r] * (whole + (e <= rest + 1e-6 or e == near))
    return out


def brute_shards(rows, n):
    """(id, text, shard, slot): rows sorted by the middle of their rank's share, then cut."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((hashlib.md5(f"10:{'null' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest(), r))
    at = [(Fraction(2 * k + 1, 2 * len(held)), "n" if s is None else "v" + s, r[0], r[1]) for s, held in by.items() for k, (_, r) in enumerate(sorted(held, key=lambda x: x[0]))]
    out, slots = Counter(), Counter()
    for place, (_, _, i, t) in enumerate(sorted(at, key=lambda x: x[:2])):
        shard = place * n // len(at)
        out[i, t, shard, slots[shard]] += 1
        slots[shard] += 1
    return out


def test_pipeline_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id <> 903")
    rows = [tuple(r) for r in docs.collect()]
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), tokenizer_path("piece_bpe_32k.model"))
    want, got = rows, docs
    steps = {
        "language": lambda x: brute_language(x, model),
        "near_duplicates": brute_near,
        "benchmark_leaks": lambda x: brute_leaks(x, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]),
        "source_mix": brute_mix,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = steps[name](want), written(stage(spark, got, folder), name)
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], r[1]) for r in want), name
    last = corpus_pipeline.STAGES[-1][1](spark, got, folder)
    assert Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in last.collect()) == brute_shards(want, 40)
