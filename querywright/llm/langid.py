"""Operator 7, language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum, over all ways to cut it into pieces, of
the product of the pieces' probabilities; a forward pass over character
positions adds them all up.  A text's score is the product over its words.

Training is expectation maximisation on a bounded sample of labelled documents
(``sample_docs`` for each language; whole texts, all their words).  Everything else
sees all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begins each word, as in the vocabulary.
MARK = "▁"
UNDETERMINED = "und"
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: From this length on, forward values are rescaled at each step.
SCALED_FROM = 40


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in lower case, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    pieces = {sp.id_to_piece(i).lower() for i in ids}
    return sorted(p for p in pieces if p)


#: Of the rolling hash: an odd multiplier, a value that stands for no hash, a table without pieces.
BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_PIECES = (np.array([NEVER]), np.zeros(1, np.int32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def piece_hashes(pieces: list[str]) -> np.ndarray:
    """The rolling hashes of pieces of one length."""
    codes = code_points("".join(pieces)).reshape(len(pieces), -1)
    h = np.zeros(len(pieces), np.uint64)
    for k in range(codes.shape[1]):
        h = h * BASE + codes[:, k]
    return h


@dataclass
class UnigramModel:
    """Piece probabilities: row 0 is no piece at all, row 1 any character outside the vocabulary."""

    pieces: list[str]
    langs: list[str]
    prob: np.ndarray
    prior: np.ndarray
    limit: int = 100_000
    seen: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.index = {p: i for i, p in enumerate(self.pieces, start=2)}
        self.longest = max(map(len, self.pieces), default=1)
        self.by_length = {}
        for size in range(1, self.longest + 1):
            rows = np.array([self.index[p] for p in self.pieces if len(p) == size], np.int32)
            if len(rows):
                hashes = piece_hashes([p for p in self.pieces if len(p) == size])
                order = np.argsort(hashes)
                # A last entry that nothing equals keeps searches inside.
                self.by_length[size] = (np.append(hashes[order], NEVER), np.append(rows[order], 0))
        self.known = np.empty((0, len(self.langs)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "index", "known", "longest", "by_length")} | {"seen": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def cuts(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, pieces at [i, j) of each word) for words of one length, by i; only where some word has a piece.

        Substrings are looked up by a rolling hash of their code points among the
        sorted hashes of the pieces of that length.
        """
        n = len(words[0])
        codes = code_points("".join(words)).reshape(len(words), n)
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for size in range(1, min(self.longest, n - i) + 1):
                h = h * BASE + codes[:, i + size - 1]
                hashes, rows = self.by_length.get(size, NO_PIECES)
                at = np.searchsorted(hashes, h)
                found = hashes[at] == h
                if size == 1:
                    yield i, i + 1, np.where(found, rows[at], 1)
                elif found.any():
                    yield i, i + size, np.where(found, rows[at], 0)

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for words of one length; languages in columns."""
        n, shape = len(words[0]), (len(words), len(self.langs))
        ahead = [np.ones(shape)] + [np.zeros(shape) for _ in range(self.longest)]
        log_scale, at = np.zeros((shape[0], 1)), 0
        for i, j, ids in self.cuts(words):
            while at < i:
                # All that ends at the next position is summed up; values before it are done with.
                ahead = [*ahead[1:], np.zeros(shape)]
                at += 1
                if n >= SCALED_FROM:
                    top = ahead[0].max(axis=1, keepdims=True)
                    log_scale += np.log(top)
                    ahead = [x / top for x in ahead]
            ahead[j - i] += ahead[0] * self.prob[ids]
        return np.log(ahead[n - at]) + log_scale

    def learn_words(self, words: set[str]) -> None:
        """Add to the memory what it lacks of ``words``: a row of ``known`` for each."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(MARK + w)
        rows = [self.known[: len(self.seen)]]
        for same in by_length.values():
            for lo in range(0, len(same), 5_000):
                part = same[lo : lo + 5_000]
                rows.append(self.forward(part))
                at = len(self.seen)
                self.seen.update(zip((w[1:] for w in part), range(at, at + len(part)), strict=True))
        self.known = np.concatenate(rows)

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """One row for each text, one column for each language; texts without letters give zeros."""
        out = np.zeros((len(texts), len(self.langs)))
        pending: list[tuple[int, Counter]] = []
        fresh: set[str] = set()

        def settle():
            self.learn_words(fresh)
            for k, counts in pending:
                rows = np.fromiter(map(self.seen.__getitem__, counts), np.int64, len(counts))
                out[k] = np.fromiter(counts.values(), np.float64, len(counts)) @ self.known[rows]
            pending.clear()
            fresh.clear()

        for k, text in enumerate(texts):
            counts = Counter(words_of(text))
            if not counts:
                continue
            pending.append((k, counts))
            fresh.update([w for w in counts if w not in self.seen])
            if len(fresh) > 20_000 or len(self.seen) + len(fresh) > self.limit:
                # Starting afresh drops words that pending texts rely on; they are learnt again.
                if len(self.seen) + len(fresh) > self.limit:
                    self.seen.clear()
                    fresh.update(w for _, c in pending for w in c)
                settle()
        settle()
        if len(self.seen) > self.limit:  # a single text may have more words
            self.seen.clear()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior; ``und`` and 0 where a text is null or has no letter."""
        filled = [t or "" for t in texts]
        raw = self.log_likelihoods(filled)
        heard = raw.any(axis=1)
        joint = raw + np.log(self.prior)
        joint -= joint.max(axis=1, keepdims=True)
        post = np.exp(joint)
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        names = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, heard, strict=True)]
        return names, np.where(heard, post[np.arange(len(best)), best], 0.0)


def expected_counts(model: UnigramModel, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations (forward-backward)."""
    out = np.zeros_like(model.prob)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, rows in by_length.items():
        for lo in range(0, len(rows), 5_000):
            part = rows[lo : lo + 5_000]
            same, weight = [words[k] for k in part], counts[part]
            if n >= SCALED_FROM:
                for k, word in enumerate(same):
                    add_long_word(model, word, weight[k], out)
                continue
            cuts = {(i, j): ids for i, j, ids in model.cuts(same)}
            shape = (len(same), len(model.langs))
            fwd, bwd = [np.zeros(shape) for _ in range(n + 1)], [np.zeros(shape) for _ in range(n + 1)]
            fwd[0][:] = 1
            bwd[n][:] = 1
            for (i, j), ids in sorted(cuts.items(), key=lambda x: x[0][1]):
                fwd[j] += fwd[i] * model.prob[ids]
            for (i, j), ids in sorted(cuts.items(), key=lambda x: -x[0][0]):
                bwd[i] += bwd[j] * model.prob[ids]
            share = weight / np.maximum(fwd[n], 1e-300)
            for (i, j), ids in cuts.items():
                np.add.at(out, ids, fwd[i] * model.prob[ids] * bwd[j] * share)
    out[0] = 0
    return out


def add_long_word(model: UnigramModel, word: str, weight: np.ndarray, out: np.ndarray) -> None:
    """Add one word's expected uses to ``out``, with logarithms: products over long words vanish."""
    n, logs = len(word), np.full(model.prob.shape, -np.inf)
    np.log(model.prob, out=logs, where=model.prob > 0)
    at, to, ids = (np.array(x) for x in zip(*[(i, j, int(p[0])) for i, j, p in model.cuts([word]) if p[0]], strict=True))
    fwd, bwd = (np.full((n + 1, len(model.langs)), -np.inf) for _ in range(2))
    fwd[0] = bwd[n] = 0
    ends, starts = np.searchsorted(np.sort(to), np.arange(n + 2)), np.searchsorted(at, np.arange(n + 2))
    by_end = np.argsort(to, kind="stable")
    for j in range(1, n + 1):
        some = by_end[ends[j] : ends[j + 1]]
        fwd[j] = np.logaddexp.reduce(fwd[at[some]] + logs[ids[some]], axis=0)
    for i in range(n - 1, -1, -1):
        some = slice(starts[i], starts[i + 1])
        bwd[i] = np.logaddexp.reduce(bwd[to[some]] + logs[ids[some]], axis=0)
    np.add.at(out, ids, np.exp(fwd[at] + logs[ids] + bwd[to] - fwd[n]) * weight)


def fit(words: list[str], counts: np.ndarray, langs: list[str], prior: np.ndarray, pieces: list[str], rounds: int = 3, smooth: float = 0.1) -> UnigramModel:
    """Expectation maximisation from equal probabilities.  ``counts``: words by languages."""
    longest, known, present = max(map(len, pieces), default=1), set(pieces), set()
    for word in words:
        w = MARK + word
        # Only pieces are kept: all substrings would be many times the words.
        present.update(known.intersection([w[i:j] for i in range(len(w)) for j in range(i + 1, min(len(w), i + longest) + 1)]))
    pieces = [p for p in pieces if p in present or len(p) == 1]
    prob = np.full((len(pieces) + 2, len(langs)), 1.0 / (len(pieces) + 1))
    prob[0] = 0
    model = UnigramModel(pieces, langs, prob, prior)
    marked = [MARK + w for w in words]
    for _ in range(rounds):
        seen = expected_counts(model, marked, counts) + smooth
        seen[0] = 0
        model.prob = seen / seen.sum(axis=0)
    return model


def train(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 500, seed: int = 7, most_langs: int = 1_000) -> UnigramModel | None:
    """Fit on a seeded sample of about ``sample_docs`` whole texts of each language; None without labelled words.

    Repeated rows stand once in the sample, so it stays bounded whatever is repeated; the
    model has a column for each language, so more than ``most_langs`` are refused.
    """
    known = labelled.where(F.col(lang).isNotNull())
    sizes = {r[lang]: r["count"] for r in known.groupBy(lang).count().limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    rate = F.lit(0.0)
    for name in langs:
        rate = F.when(F.col(lang) == name, min(1.0, sample_docs / sizes[name])).otherwise(rate)
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(1_000_000)) / 1_000_000
    sample = known.where(spot < rate).select(lang, text).distinct()

    def count(batches):
        table: Counter = Counter()
        for pdf in batches:
            for name, body in zip(pdf[lang], pdf[text], strict=True):
                table.update((name, w) for w in words_of(body or ""))
            if len(table) > 300_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in table.items()], columns=["lang", "word", "n"])
                table.clear()
        yield pd.DataFrame([(a, b, n) for (a, b), n in table.items()], columns=["lang", "word", "n"])

    table = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # All word types of the sample: its size is what bounds them.
    rows = table.toArrow()
    if not rows.num_rows:
        return None
    words = sorted(pc.unique(rows["word"]).to_pylist())
    counts = np.zeros((len(words), len(langs)))
    counts[pc.index_in(rows["word"], pa.array(words)).to_numpy(), pc.index_in(rows["lang"], pa.array(langs)).to_numpy()] = rows["n"].to_numpy()
    del rows
    prior = np.array([sizes[x] for x in langs], float)
    return fit(words, counts, langs, prior / prior.sum(), load_pieces(vocabulary))


def predict(spark: SparkSession, text: Column, model: UnigramModel | None) -> Column:
    """A struct (lang_pred string, score double) for each text.

    Null texts, texts without a letter and all texts under a missing model give
    ``und`` with score 0.  Equal texts get equal results; texts are read whole, however
    long, as are words of any length; equally likely languages are settled by name.
    """
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        # The broadcast value is one object for each worker, so words met are kept; texts are
        # taken out of the batch some at a time.
        names, scores = [], []
        for lo in range(0, len(texts), 256):
            some = sent.value.predict(texts[lo : lo + 256].to_pylist())
            names += some[0]
            scores += some[1].tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    run = F.arrow_udf(run, "lang_pred string, score double")

    return run(text)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(folds)) == fold


def crc_fold(key: int, folds: int = 4) -> int:
    """The fold of a key as ``held_out`` sees it, for tests."""
    return zlib.crc32(str(key).encode()) % folds
