"""Operator 2, token counts: byte-pair merging with a heap over a linked list.

Only the count is wanted, so no identifiers are emitted: a text has as many
tokens as its pre-tokens have bytes less the merges made in them.  Merges always
take the lowest rank among all adjacent pairs, leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How text is cut before merging; fixed by the vocabulary's byte-level scheme.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = 20
_POS = 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Pre-token -> number of tokens.  A dictionary that works out what it lacks.

    It holds ``limit`` short pre-tokens at most and then starts afresh, so memory is
    bounded; long pre-tokens are never kept.
    """

    def __init__(self, spec: bytes, limit: int = 400_000, longest: int = 48):
        super().__init__()
        model = json.loads(spec)
        vocab, self.limit, self.longest = model["model"]["vocab"], limit, longest
        self.byte_id = [vocab[c] for c in byte_symbols()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << _SHIFT | vocab[b], len(self.merged))
            self.merged.append(vocab[a + b])
        special = sorted((t["content"] for t in model.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PRETOKEN).findall

    def __missing__(self, token: str) -> int:
        n = self.count_merges(token)
        if len(token) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[token] = n
        return n

    def count_merges(self, token: str) -> int:
        ids, rank, merged = self.byte_id, self.rank, self.merged
        sym = [ids[b] for b in token.encode("utf-8", "surrogatepass")]
        n = tokens = len(sym)
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] << _SHIFT | sym[i + 1])
            if r is not None:
                heap.append(r << _POS | i)
        if not heap:
            return tokens
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask, pop, push = (1 << _POS) - 1, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            r, i = top >> _POS, top & mask
            j = after[i]
            # A merged-away symbol is -1 and its pair has no rank; any other change gives another rank.
            if j >= n or rank.get(sym[i] << _SHIFT | sym[j]) != r:
                continue
            sym[i], sym[j] = merged[r], -1
            tokens -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(sym[i] << _SHIFT | sym[k])
                if r is not None:
                    push(heap, r << _POS | i)
            h = before[i]
            if h >= 0:
                r = rank.get(sym[h] << _SHIFT | sym[i])
                if r is not None:
                    push(heap, r << _POS | h)
        return tokens

    def count(self, text: str) -> int:
        """Tokens of a whole text; an added token's own string counts as one token."""
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.cut(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.cut(p))) for p in parts)


_COUNTERS: dict[str, MergeCounter] = {}


def counter_for(digest: str, spec: bytes) -> MergeCounter:
    """One counter for each vocabulary and worker process."""
    if digest not in _COUNTERS:
        _COUNTERS[digest] = MergeCounter(spec)
    return _COUNTERS[digest]


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """The number of tokens of ``text``: long, never null.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's
    JSON format, read on the driver and broadcast (its size is fixed by the
    vocabulary, about 1.5 MB here).  Null and empty texts have 0 tokens; texts are read
    whole, however long (a heap for each pre-token); added tokens' own strings count as
    one token each; equal texts, repeated rows among them, have equal counts.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    digest, spec = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = counter_for(digest, spec.value)
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))
