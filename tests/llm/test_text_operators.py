"""Token counts, main text, language, toxicity and fingerprints against brute force and known answers."""

import hashlib
import math
import os
import random
import re
from collections import Counter
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querywright.llm import bpe_count, cdc, html_blocks, langid, ordinal
from querywright.llm.queries import tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")
LONG = "ab " * 60_000


@pytest.fixture(scope="module")
def counter():
    with open(BPE, "rb") as f:
        return bpe_count.MergeCounter(f.read(), limit=50)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t'sé1²²日😀<|>_ 　\x85"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_token_counts_equal_the_library(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_texts(spark, counter, library):
    texts = [None, "", "a", "a" * 5000, LONG, "x<|endoftext|>y", "<|endoftext|><|endoftext|> ", "naïve   café\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in df.withColumn("n_tokens", bpe_count.token_count(spark, F.col("text"), BPE)).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert len(counter) <= 50
    empty = df.limit(0).withColumn("n", bpe_count.token_count(spark, F.col("text"), BPE))
    assert empty.count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) { x("</p>"); }</script></head>
<body class="page-template"><div id="cookie-banner">We use cookies and the like of it</div><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">The</a></li></ul></nav>%s<aside>More of the same that is here</aside>
<section class="comments"><p>This is a comment that is on the page and it is not of the article.</p></section>
<form><label>Name</label><input></form><footer>&copy; the owner of it all</footer></body></html>"""
BODY = "<h2>A &amp; B</h2><p>It was the best of times, it was the worst\n of times, and that is what it was for all of us in the end.<p><b>Short one.<br>Next<p>And this is the last of the paragraphs that we have in it, for it is done.</p>"


def test_main_text_of_a_marked_article():
    text = html_blocks.main_text(PAGE % f"<article>{BODY}<div class='share-buttons'>Share it</div></article>")
    assert text.split("\n") == ["A & B", "It was the best of times, it was the worst of times, and that is what it was for all of us in the end.", "Short one. Next", "And this is the last of the paragraphs that we have in it, for it is done."]


def test_main_text_without_marks():
    links = "<div>" + "".join(f"<a href='/{i}'>The link of it {i}</a> " for i in range(9)) + "</div>"
    text = html_blocks.main_text(PAGE % f"<div>{links}{BODY}{links}</div>")
    assert "best of times" in text and "Short one." in text and "last of the paragraphs" in text and "The link" not in text


def test_main_text_judges_marked_pages_too():
    # Want of stop words drops a paragraph of an unmarked page; a marked article keeps all but links and boilerplate.
    notice = "Acme Gizmo 3000 Turbo Platinum Edition, Blue, Red, Green, Yellow, Steel, Chrome, Nickel, Copper"
    links = "<p>" + "".join(f"<a href='/{i}'>Read the one of them {i}</a> " for i in range(9)) + "</p>"
    text = html_blocks.main_text(PAGE % f"<article>{BODY}<p>{notice}</p>{links}</article><div><p>{notice}</p></div>")
    assert "best of times" in text and "Short one." in text and text.count(notice) == 1 and "Read the one" not in text
    assert notice not in html_blocks.main_text(PAGE % f"<div>{BODY}<p>{notice}</p></div>")
    teasers = "<article><p>The one that is read</p></article><article><p>And the other of them</p></article>"
    assert "best of times" in html_blocks.main_text(PAGE % f"<div>{BODY}</div>{teasers}")


@pytest.mark.parametrize("words", ["Wczoraj wieczorem mieszkańcy miasta zobaczyli niezwykłe zjawisko", "Вчера вечером жители города увидели необычное явление", "昨天晚上城里的居民看到了一个不寻常的现象他们都很惊讶"])
def test_main_text_in_an_unlisted_language(words):
    paragraphs = [" ".join([words] * k) for k in (3, 9, 3)]
    links = "<div>" + "".join(f"<a href='/{i}'>{words}</a> " for i in range(5)) + "</div>"
    page = links + "".join(f"<p>{p}</p>" for p in paragraphs) + links
    assert html_blocks.main_text(PAGE % f"<div>{page}</div>").split("\n") == paragraphs


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "class='page no-header'", "class='post tag-news'", "id='search-result-body'", "class='comments-open'"])
@pytest.mark.parametrize("mark", ["article", "div"])
def test_main_text_in_a_wrapper_named_like_boilerplate(wrapper, mark):
    inner = f"<{mark}>{BODY}</{mark}><div class='sidebar'>It is the text at the side</div>"
    text = html_blocks.main_text(PAGE % f"<div {wrapper}>{inner}</div>")
    assert "best of times" in text and "last of the paragraphs" in text
    assert "at the side" not in text and "comment that" not in text and "cookies" not in text


def test_main_text_of_odd_pages(spark):
    pages = [None, "", "plain words and no markup", "<p>cut off <b>in the mid", "<script>only script", "<!-- <p>hidden</p> -->", "<p>a&nbsp;&lt;b&gt;&#233;&bogus;</p>", "<article></article>", "<" * 2000, "<p>" + "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r["page_id"]: r["t"] for r in df.select("page_id", html_blocks.extract_main_text(F.col("html")).alias("t")).collect()}
    assert got[0] == got[1] == got[4] == got[5] == got[7] == ""
    assert got[2] == pages[2] and got[3] == "cut off in the mid" and got[6] == "a <b>é&bogus;"
    assert got[9] == ("word " * 50_000).strip()


def test_second_pass_follows_the_nearest_neighbour():
    def label(*labels, places=None, heading=()):
        blocks = [html_blocks.Block("x", 0, k in heading, False, places[k] if places else 0, label=x) for k, x in enumerate(labels)]
        html_blocks.settle(blocks)
        return [b.label for b in blocks]

    g, b, o = html_blocks.GOOD, html_blocks.BAD, html_blocks.OPEN
    assert label(g, o, g) == [g, g, g] and label(b, o, b) == [b, b, b]
    assert label(g, o, o, b) == [g, g, b, b] and label(g, o, b) == [g, g, b]
    assert label(o, b) == [b, b] and label(o) == [g]
    assert label(b, o, o, g, places=[1, 2, 2, 2]) == [b, g, g, g] and label(g, o, b, heading=[1]) == [g, b, b]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p class=it's>It is kept.</p></article>", "It is kept."),
        ("<p title='a > b' class=x'y>One</p><p>Two</p>", "One\nTwo"),
        ("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be</p>", "Let x+1 be"),
        ("<!--><p>Kept</p><!--->and this<!-- not --!>too", "Kept\nand thistoo"),
        ("<p>a<span hidden>b</span><i style='display: none'>c</i></p><p data-id='ad' alt='nav'>d</p>", "a\nd"),
        ("<p>a = b < c</p><p a==\"x>y\">d</p>", "a = b < c\nd"),
    ],
)
def test_main_text_of_odd_markup(page, text):
    assert html_blocks.main_text(page) == text


def test_main_text_of_a_story_beside_a_marked_teaser():
    text = html_blocks.main_text(PAGE % f"<div>{BODY}</div><article><h3>Other</h3><p>One more that is read</p></article>")
    assert "best of times" in text and "last of the paragraphs" in text


def strip_marks(page):
    for mark in ("article", "main"):
        page = page.replace(f"<{mark}>", "<div>").replace(f"</{mark}>", "</div>")
    return re.sub(r' class="[^"]*"', "", page)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="needs the sample pages")
def test_rules_alone_find_most_sample_articles(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = sum(html_blocks.main_text(strip_marks(p)) == html_blocks.main_text(p) != "" for p in pages)
    assert same >= 0.9 * len(pages)


class SlowRules:
    """The same rules over a parsed tree, every neighbour looked at."""

    def __init__(self, page):
        self.blocks, self.pieces = [], []
        self.walk(ElementTree.fromstring(page), [])
        plain = [b for b in self.blocks if self.plain(b)]
        fair = [b for b in plain if len(b["text"]) >= 70]
        self.known = 2 * sum(len(b["text"]) for b in fair if self.stop(b) >= 0.15) >= sum(len(b["text"]) for b in fair)
        self.shade()
        plain = [b for b in self.blocks if self.plain(b)]
        inside = sum(len(b["text"]) for b in plain if b["inside"])
        self.marked = inside > 0 and 2 * inside >= sum(len(b["text"]) for b in plain)
        fair = [b for b in plain if len(b["text"]) >= 70]
        self.known = 2 * sum(len(b["text"]) for b in fair if self.stop(b) >= 0.15) >= sum(len(b["text"]) for b in fair)

    def walk(self, e, above):
        block, chain = e.tag in html_blocks.BLOCKS, [*above, e]
        if block:
            self.flush(above)
        self.pieces.append((e.text or "", any(x.tag == "a" for x in chain)))
        for child in e:
            self.walk(child, chain)
            self.pieces.append((child.tail or "", any(x.tag == "a" for x in chain)))
        if block:
            self.flush(chain)

    def flush(self, chain):
        text = " ".join("".join(t for t, _ in self.pieces).split())
        if text:
            held = [x for x in chain if x.tag in html_blocks.BLOCKS]
            own = held[-1]
            place = own if any(x is not own and x.tag in html_blocks.BLOCKS for x in own.iter()) else held[-2]
            self.blocks.append({
                "text": text, "linked": sum(len(t.strip()) for t, a in self.pieces if a), "heading": own.tag == "h2", "place": id(place),
                "inside": any(x.tag == "article" for x in chain), "around": any(x.tag in html_blocks.AROUND for x in chain),
                "shades": [x for x in chain if x.get("class") in ("ad", "comments") and (x.tag != "article" or x.get("class") == "comments")],
            })
        self.pieces = []

    def plain(self, b):
        return not b["around"] and b["linked"] <= html_blocks.MOST_LINKED * len(b["text"])

    def stop(self, b):
        words = b["text"].lower().split()
        return sum(w in html_blocks.STOP for w in words) / len(words)

    def first(self, b, marked):
        n = len(b["text"])
        if not self.plain(b):
            return "bad"
        if b["heading"]:
            return "open"
        out = marked and not b["inside"]
        if n < 70:
            return "bad" if out else "open"
        stop = self.stop(b)
        if out:
            return "open" if n > 200 and (not self.known or stop >= 0.28) else "bad"
        if not self.known or stop >= 0.15:
            return "good" if n > 200 or (marked and stop >= 0.28) else "open"
        return "bad" if stop < 0.05 and not marked else "open"

    def shade(self):
        size = lambda some: sum(len(b["text"]) for b in some)
        fair = [b for b in self.blocks if self.first(b, False) != "bad"]
        best = [b for b in fair if self.first(b, False) == "good"] or fair
        marked = [b for b in fair if b["inside"]]
        for e in {id(x): x for b in self.blocks for x in b["shades"]}.values():
            under = lambda some, e=e: size([b for b in some if any(x is e for x in b["shades"])])
            if e.get("class") == "comments":
                shown = any(under(some) == size(some) > 0 for some in (best, marked))
            else:
                shown = (2 * under(fair) > size(fair) and under(fair) > (200 if marked else 0)) or (2 * under(marked) > size(marked) and under(marked) > 0)
            if not shown:
                for b in self.blocks:
                    b["hide"] = b.get("hide", False) or any(x is e for x in b["shades"])
        for b in self.blocks:
            b["around"] = b["around"] or b.get("hide", False)

    def text(self):
        blocks = self.blocks
        label = [self.first(b, self.marked) for b in blocks]
        row = [x == "open" and not b["heading"] and len(b["text"]) >= 70 and (not self.known or self.stop(b) >= 0.15) for x, b in zip(label, blocks, strict=True)]
        for i in range(len(blocks)):
            for j in range(i + 1, len(blocks) + 1):
                if all(row[i:j]) and len({b["place"] for b in blocks[i:j]}) == 1 and sum(len(b["text"]) for b in blocks[i:j]) > 200:
                    label[i:j] = ["good"] * (j - i)
        if "good" not in label:
            rest = [k for k, x in enumerate(label) if x == "open"]
            for k in [k for k in rest if not blocks[k]["heading"] and len(blocks[k]["text"]) >= 70] or rest:
                label[k] = "good"
        out = []
        for k, b in enumerate(blocks):
            got = label[k]
            if got == "open":
                decided = [j for j, x in enumerate(label) if x != "open"]
                same = [j for j in decided if blocks[j]["place"] == b["place"]]
                after, same_after = min((j for j in decided if j > k), default=None), min((j for j in same if j > k), default=None)
                if b["heading"] and after is not None:
                    near = [same_after if same_after is not None and same_after <= after + html_blocks.APART else after]
                else:
                    some = same or decided
                    near = [j for j in some if abs(j - k) == min(abs(x - k) for x in some)]
                if len({label[j] for j in near}) > 1 and len({blocks[j]["inside"] for j in near}) > 1:
                    near = [j for j in near if blocks[j]["inside"] == b["inside"]]
                got = "bad" if near and {label[j] for j in near} == {"bad"} else "good"
            if got == "good":
                out.append(b["text"])
        return "\n".join(out)


def random_page(rng):
    def words():
        return " ".join(rng.choices(["the", "of", "and"] if rng.random() < 0.6 else ["zorp"], k=1)[0] if rng.random() < 0.5 else "x" * rng.randint(2, 9) for _ in range(rng.choice([2, 6, 18, 30, 60])))

    def element(depth):
        tag = rng.choice(["p", "p", "p", "div", "div", "article", "nav", "footer", "ul", "h2", "section", "a", "b"])
        label = rng.choice(["", "", "", "ad", "comments", "post"])
        inner = words() if depth > 3 or tag in ("p", "h2", "a", "b") else "".join(element(depth + 1) for _ in range(rng.randint(0, 5)))
        if tag == "ul":
            inner = "".join(f"<li>{'<a>' + words() + '</a>' if rng.random() < 0.5 else words()}</li>" for _ in range(3))
        mark = f' class="{label}"' if label and tag not in ("a", "b") else ""
        return f"<{tag}{mark}>{inner}</{tag}>" + (words() if rng.random() < 0.1 else "")

    return f"<html><body>{''.join(element(0) for _ in range(rng.randint(1, 7)))}</body></html>"


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 1 << 40))
def test_main_text_equals_the_slow_rules(seed):
    page = random_page(random.Random(seed))
    assert html_blocks.main_text(page) == SlowRules(page).text()


def test_main_text_query_keeps_repeated_rows_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE % BODY), (1, "u", PAGE % BODY), (None, None, None), (2, "v", "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    told = df.select("page_id", "url", html_blocks.extract_main_text(F.col("html")).alias("text"))
    got = [tuple(r) for r in told.collect()]
    assert len(got) == 4 and got[0] == got[1] and (None, None, "") in got and (2, "v", "x") in got
    assert df.limit(0).select(html_blocks.extract_main_text(F.col("html"))).count() == 0


def brute_probability(model, word, lang):
    """The sum over all segmentations, by recursion."""

    @lru_cache(None)
    def total(i):
        if i == len(word):
            return 1.0
        found = 0.0
        for j in range(i + 1, min(len(word), i + model.longest) + 1):
            row = model.index.get(word[i:j], int(j == i + 1))
            found += model.prob[row, lang] * total(j)
        return found

    return total(0)


@pytest.fixture(scope="module")
def model():
    words = ["the", "then", "there", "der", "die", "und", "strasse"]
    counts = np.array([[9, 0], [3, 0], [3, 0], [0, 5], [0, 5], [0, 5], [0, 2]], float)
    return langid.fit(words, counts, ["en", "de"], np.array([0.5, 0.5]), langid.load_pieces(tokenizer_path("piece_bpe_32k.model")))


@pytest.mark.parametrize("word", ["the", "there", "strasse", "zzz", "日本", "undthedie"])
def test_forward_sums_all_segmentations(model, word):
    marked = langid.MARK + word
    got = model.forward([marked])[0]
    for lang in (0, 1):
        assert got[lang] == pytest.approx(math.log(brute_probability(model, marked, lang)), rel=1e-9)


def segmentations(word, longest):
    if not word:
        yield ()
    for j in range(1, min(len(word), longest) + 1):
        for rest in segmentations(word[j:], longest):
            yield (word[:j], *rest)


@pytest.mark.parametrize("scaled_from", [40, 2])
def test_expected_counts_equal_all_segmentations(model, monkeypatch, scaled_from):
    monkeypatch.setattr(langid, "SCALED_FROM", scaled_from)
    words = [langid.MARK + w for w in ("the", "then", "die", "日本", "thee", "zz")]
    counts = np.array([[3, 1], [2, 0], [0, 4], [1, 1], [0, 2], [5, 0]], float)
    want = np.zeros_like(model.prob)
    for word, weight in zip(words, counts, strict=True):
        ways = []
        for cut in segmentations(word, model.longest):
            rows = [model.index.get(piece, int(len(piece) == 1)) for piece in cut]
            if all(rows):
                ways.append((rows, model.prob[rows].prod(axis=0)))
        total = sum(p for _, p in ways)
        for rows, p in ways:
            np.add.at(want, rows, p / total * weight)
    assert np.allclose(langid.expected_counts(model, words, counts), want)


def test_training_uses_words_of_any_length():
    pieces = langid.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    long = ["qq" * 300, "zz" * 300]
    model = langid.fit(["the", "die", *long], np.array([[1, 0], [0, 1], [1, 0], [0, 1]], float), ["en", "de"], np.array([0.5, 0.5]), pieces)
    names, scores = model.predict(["qqq", "zzz", "the", "die"])
    assert names == ["en", "de", "en", "de"] and min(scores) > 0.9


def test_posterior_equals_bayes_rule(model):
    text = "the zz die the 12"
    joint = model.prior * [math.prod(brute_probability(model, langid.MARK + w, k) for w in ("the", "zz", "die", "the")) for k in (0, 1)]
    names, scores = model.predict([text, text * 1, "", "die die"])
    assert scores[0] == pytest.approx(max(joint) / sum(joint)) and names[0] == ["en", "de"][int(np.argmax(joint))]
    assert (names[1], scores[1]) == (names[0], scores[0]) and (names[2], scores[2]) == ("und", 0.0) and names[3] == "de"


def test_forward_of_long_words_is_rescaled(model):
    word = langid.MARK + "the" * 400
    got = model.forward([word])[0]
    assert np.isfinite(got).all() and got[0] > got[1]
    short = langid.MARK + "the" * 12
    plain = model.forward([short])
    langid_scaled = langid.SCALED_FROM
    try:
        langid.SCALED_FROM = 2
        assert np.allclose(model.forward([short]), plain)
    finally:
        langid.SCALED_FROM = langid_scaled


def test_memory_of_words_is_bounded(model):
    small = langid.UnigramModel(model.pieces, model.langs, model.prob, model.prior, limit=20)
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(15)) for i in range(10)]
    assert np.allclose(small.log_likelihoods(texts), model.log_likelihoods(texts))
    assert len(small.seen) <= 20


def test_language_queries(spark):
    rng = random.Random(7)
    vocabulary = {"en": "the of and to in is that it was for on with as are this", "de": "der die das und ist nicht ein eine mit auf für von dem den"}
    rows = [(i, " ".join(rng.choices(vocabulary[x].split(), k=30)), x) for i in range(200) for x in [rng.choice(["en", "de"])]]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !? 4", "de"), (903, LONG, None), (904, "the the", None), (904, "the the", None), (None, "und die", "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.held_out(F.col("doc_id"))
    trained = langid.train(docs.where(~out), tokenizer_path("piece_bpe_32k.model"), sample_docs=50)
    got = docs.select("doc_id", "lang", out.alias("held_out"), langid.predict(spark, F.col("text"), trained).alias("p")).select("*", "p.*").collect()
    assert len(got) == 207
    told = {r["doc_id"]: r for r in got}
    assert all(r["lang"] == r["lang_pred"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert [told[i]["lang_pred"] for i in (900, 901, 902, 904)] == ["und", "und", "und", "en"]
    assert told[901]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (langid.crc_fold(r["doc_id"]) == 2) for r in got if r["doc_id"] is not None)
    assert langid.train(docs.limit(0), tokenizer_path("piece_bpe_32k.model")) is None
    assert docs.limit(2).select(langid.predict(spark, F.col("text"), None).alias("p")).first()["p"]["lang_pred"] == "und"


def test_samples_stay_bounded_whatever_is_repeated(spark, monkeypatch):
    """A third of the rows without a key, and a key with very many texts."""
    rows = [(None, "the of and to", "en")] * 400 + [(7, f"der die das wort{'abcdefghij'[i % 10]}", "de") for i in range(400)] + [(100 + i, "the of and" if i % 2 else "der die das", "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda words, counts, *rest: seen.append(counts.sum()))
    langid.train(docs, tokenizer_path("piece_bpe_32k.model"), sample_docs=20)
    assert seen[0] < 400
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, "", most_langs=1)
    labels = spark.createDataFrame([(7, 1, 1), (101, 1, 0), (102, 1, 0), (103, 1, 0)], "doc_id long, quality int, toxic int")
    sizes = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades, n, k: sizes.append(len(rows)) or (np.zeros(n), np.zeros(2)))
    ordinal.train(docs, ordinal.grades_from_labels(labels), least_docs=1, least_lift=0.0)
    assert sizes == [4]


def test_ordinal_thresholds_stay_in_order_and_share_weights():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 3))
        rows.append(np.array(sorted({int(rng.integers(3, 40)) for _ in range(6)} | set(range(g)))))
        grades.append(g)
    w, cuts = ordinal.fit(rows, np.array(grades), 40, 3, rounds=200)
    assert cuts[0] < cuts[1] and abs(w[3:]).max() < 0.2 * min(w[0], w[1])
    model = ordinal.OrdinalModel({}, cuts)
    up = model.exceed(np.array([w[list(r)].sum() for r in rows]))
    edges = np.column_stack([np.ones(len(up)), up, np.zeros(len(up))])
    assert ((edges[:, :-1] - edges[:, 1:]).argmax(axis=1) == grades).mean() > 0.9


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]
    grades = np.array([min(2, (0 in r) + (1 in r) * int(rng.random() < 0.8) + int(rng.random() < 0.1)) for r in rows])
    ridge = 1e-2
    w, cuts = ordinal.fit(rows, grades, 6, 3, rounds=1500, ridge=ridge, rate=0.3)
    least = ordinal.penalised_loss(w, cuts, rows, grades, ridge)
    # Likelihoods one by one, by the definition.
    slow = ridge / 2 * sum(x * x for x in w)
    for r, g in zip(rows, grades, strict=True):
        up = [1.0, *(1 / (1 + math.exp(-(sum(w[i] for i in r) - c))) for c in cuts), 0.0]
        slow -= math.log(up[g] - up[g + 1]) / len(rows)
    assert least == pytest.approx(slow)
    # No step in any direction gets lower, and slopes by differences vanish, but that no weight goes below 0.
    assert w.min() >= 0
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-3
        up, down = (ordinal.penalised_loss(w + s * step[:6], cuts + s * step[6:], rows, grades, ridge) for s in (1, -1))
        assert up > least - 1e-6
        assert (k < 6 and w[k] == 0) or (abs(up - down) / 2e-3 < 2e-3 and down > least - 1e-6)


def test_toxicity_on_unseen_rows(spark):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=40)
        bad = i % 5 == 0
        if bad:
            words[3], words[9] = rng.choice(["idiot", "moron"]), "foulend" + rng.choice("abcdef")
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, LONG), (1003, "IDIOT foulendx"), (1003, "IDIOT foulendx")], "doc_id long, text string").withColumn("grade", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 if i % 10 else 0, y) for i, _, y in rows if i < 400] + [(None, 1, 1), (5, None, None), (7, None, 0)], "doc_id long, quality int, toxic int")
    grades = ordinal.grades_from_labels(labels)
    assert {r["grade"] for r in grades.collect()} == {0, 1, 2}
    model = ordinal.train(docs.drop("grade"), grades)
    got = docs.drop("grade").select("doc_id", ordinal.severity(spark, F.col("text"), model).alias("s")).select("doc_id", "s.*").collect()
    told = {r["doc_id"]: r for r in got}
    assert len(got) == 605
    assert all((told[i]["p_toxic"] >= 0.5) == bool(y) for i, _, y in rows if i >= 400)
    assert told[1003]["p_toxic"] > 0.5 and told[1000]["p_toxic"] < 0.5 and told[1002]["p_toxic"] < 0.5
    assert all(0 <= r["expected_severity"] <= 2 and r["expected_severity"] >= r["p_toxic"] - 1e-9 for r in got)
    assert ordinal.train(docs.drop("grade"), grades.where("grade = 0")) is None
    assert ordinal.train(docs.drop("grade").limit(0), grades) is None and docs.limit(0).select(ordinal.severity(spark, F.col("text"), model)).count() == 0
    assert docs.drop("grade").limit(1).select(ordinal.severity(spark, F.col("text"), None).alias("s")).first()["s"]["p_toxic"] is None


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(cdc.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_gear_hash_and_chunks(data):
    assert cdc.gear_hashes(data).tolist() == slow_gear(data)
    ends = cdc.cut_points(data)
    sizes = np.diff([0, *ends])
    assert (not data and not ends) or ends[-1] == len(data)
    assert all(cdc.LEAST <= s <= cdc.MOST for s in sizes[:-1]) and all(0 < s <= cdc.MOST for s in sizes)


def slow_cuts(data):
    """Byte by byte: a cut at a laxer or stricter zero of the gear hash, or at the longest chunk."""
    ends, start, h = [], 0, 0
    for at, b in enumerate(data, start=1):
        h = ((h << 1) + int(cdc.GEAR[b])) & 0xFFFFFFFF
        size = at - start
        mask = int(cdc.STRICT) if size < cdc.WISHED else int(cdc.LAX)
        if size == cdc.MOST or (size >= cdc.LEAST and h & mask == 0):
            ends.append(at)
            start = at
    return ends + ([len(data)] if start < len(data) else [])


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text(alphabet="ab ", max_size=2000).map(str.encode)))
def test_cut_points_equal_a_slow_scan(data):
    assert cdc.cut_points(data) == slow_cuts(data)


def test_chunks_resist_shifts():
    text = " ".join(f"token{(i * 7919) % 1009}" for i in range(600))
    a, b = cdc.chunk_set(text), cdc.chunk_set("inserted words here " + text)
    assert cdc.containment(a, b) > 0.9
    assert cdc.decode(cdc.encode(a)) == a
    assert cdc.containment({}, {}) == 1.0 and cdc.containment(a, {}) == 0.0


@pytest.mark.parametrize("per_range", [200, 1 << 20])
def test_fingerprints_of_neighbours(spark, per_range):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choices("abc déф😀 ", k=rng.randint(0, 300)))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, LONG), (1003, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = {r["doc_id"]: r for r in cdc.fingerprint_with_neighbours(df, bytes_per_range=per_range).collect()}
    by_id = dict(rows)
    ids = sorted(by_id, reverse=True)
    assert sorted(got, reverse=True) == ids
    for at, i in enumerate(ids):
        own, after = by_id[i] or "", by_id[ids[(at + 1) % len(ids)]] or ""
        changed = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == cdc.encode(cdc.chunk_set(own)) and got[i]["edited_fingerprint"] == cdc.encode(cdc.chunk_set(changed))
        assert got[i]["near_edited"] == pytest.approx(cdc.containment(cdc.chunk_set(own), cdc.chunk_set(changed)))
        assert got[i]["near_next"] == pytest.approx(cdc.containment(cdc.chunk_set(own), cdc.chunk_set(after)))
    assert got[1003]["fingerprint"] == got[12]["fingerprint"]
    repeated = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z")], "doc_id long, text string")
    assert cdc.fingerprint_with_neighbours(repeated).count() == 3
    # A key of many rows is cut into ranges of its own, in the order of the texts' hashes.
    hot = [(7 if i % 3 else None, "".join(rng.choices("abcdefg hij", k=rng.randint(30, 90)))) for i in range(150)] + [(9, "last of all"), (2, "x")]
    hot_df = spark.createDataFrame(hot, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in hot_df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(hot, key=lambda x: (-(1 << 63) if x[0] is None else x[0], hashes[x[1]]), reverse=True)
    want = Counter((k, cdc.encode(cdc.chunk_set(t)), round(cdc.containment(cdc.chunk_set(t), cdc.chunk_set(order[(i + 1) % len(order)][1])), 9)) for i, (k, t) in enumerate(order))
    out = cdc.fingerprint_with_neighbours(hot_df, bytes_per_range=per_range)
    assert Counter((r["doc_id"], r["fingerprint"], round(r["near_next"], 9)) for r in out.collect()) == want
    assert cdc.fingerprint_with_neighbours(df.limit(0)).count() == 0
    assert cdc.fingerprint_with_neighbours(df.where("doc_id = 0")).first()["near_next"] == 1.0
