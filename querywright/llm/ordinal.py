"""Operator 1, toxicity: cumulative-link ordinal regression over sparse text features.

Severity grades 0..K share one vector of weights, none below 0; the K thresholds that part them are
ordered, and P(grade > k) is the logistic function of (score - threshold k).  A
text's expected severity is the sum of these probabilities.

The model is fitted on a bounded sample of labelled rows (``sample_rows``); the
features are the words of a whole text and the first letters of its long words,
each present or absent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm.common import written

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
STEMS = (4, 5, 6)


def features_of(text: str) -> set[str]:
    """Distinct lower-case words, and their first 4, 5 and 6 letters with a star where they have more."""
    words = set(WORDS.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class OrdinalModel:
    """weights by feature, and ascending thresholds."""

    weights: dict[str, float]
    cuts: np.ndarray

    def score(self, text: str) -> float:
        get = self.weights.get
        return sum([w for f in features_of(text) if (w := get(f)) is not None])

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts[None, :], -500, 500)))


def penalised_loss(w: np.ndarray, cuts: np.ndarray, rows: list[np.ndarray], grades: np.ndarray, ridge: float) -> float:
    """What ``fit`` minimises: the mean negative log likelihood and the ridge on the weights."""
    score = np.array([w[r].sum() for r in rows])
    over = np.column_stack([np.ones(len(rows)), 1 / (1 + np.exp(-(score[:, None] - cuts[None, :]))), np.zeros(len(rows))])
    here = np.arange(len(rows))
    return float(-np.log(over[here, grades] - over[here, grades + 1]).mean() + ridge / 2 * (w @ w))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, rounds: int = 400, ridge: float = 1e-5, rate: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam on all rows at once, the step falling to nothing.

    Weights are at least 0: a feature can raise the severity, and the many harmless ones
    of a long text cannot talk it down.  The thresholds are kept in order by writing
    them as a first one and positive steps.
    """
    lengths = np.array([len(r) for r in rows])
    row_of = np.repeat(np.arange(len(rows)), lengths)
    col_of = np.concatenate(rows) if len(row_of) else np.empty(0, np.int64)
    w, theta = np.zeros(n_features), np.zeros(n_grades - 1)
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    theta[0] = start[0]
    theta[1:] = np.log(np.expm1(np.maximum(np.diff(start), 0.05)))
    both = [w, theta]
    m, v = [np.zeros_like(x) for x in both], [np.zeros_like(x) for x in both]
    for t in range(1, rounds + 1):
        steps = np.log1p(np.exp(theta[1:]))
        cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(steps)])
        score = np.bincount(row_of, w[col_of], len(rows))
        up = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -500, 500)))
        over = np.column_stack([np.ones(len(rows)), up, np.zeros(len(rows))])
        here = np.arange(len(rows))
        p = np.maximum(over[here, grades] - over[here, grades + 1], 1e-9)
        slope = over * (1 - over)
        d_score = -(slope[here, grades] - slope[here, grades + 1]) / p / len(rows)
        d_cut = np.zeros((len(rows), n_grades + 1))
        d_cut[here, grades] += slope[here, grades] / p
        d_cut[here, grades + 1] -= slope[here, grades + 1] / p
        g_cut = d_cut[:, 1:n_grades].sum(axis=0) / len(rows)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_theta = np.concatenate([tail[:1], tail[1:] / (1 + np.exp(-theta[1:]))])
        g_w = np.bincount(col_of, d_score[row_of], n_features) + ridge * w
        for x, g, a, b in zip(both, (g_w, g_theta), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (1 - t / (rounds + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        np.maximum(w, 0, out=w)
    steps = np.log1p(np.exp(theta[1:]))
    return w, np.concatenate([theta[:1], theta[0] + np.cumsum(steps)])


def grades_from_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade): 0 not toxic, 1 toxic, 2 toxic in a text of low quality.

    The labels say toxic or not only; low quality stands for the graver case.  Rows
    without a toxic label are left out, repeated ones stand once; a null quality
    counts as good.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    return labels.where(F.col("toxic").isNotNull()).select(key, grade.alias("grade")).distinct()


def train(docs: DataFrame, grades: DataFrame, text: str = "text", grade: str = "grade", key: str = "doc_id", n_grades: int = 3, sample_rows: int = 16_000, least_docs: int = 4, least_lift: float = 4.0, seed: int = 1) -> OrdinalModel | None:
    """Fit on the texts of a seeded sample of about ``sample_rows`` graded rows; None if it holds fewer than two grades.

    Kept are all features in ``least_docs`` sampled rows at least whose presence differs
    between grade 0 and the others by ``least_lift`` standard deviations at least; others
    would only be fitted to chance.  Null texts count as empty, rows of null grade are
    left out; of texts that share a key the one with the smallest hash is used; graded
    rows without a document (or an empty documents table) add nothing.
    """
    grades = grades.where(F.col(grade).isNotNull())
    total = grades.count()
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    picked = grades.where(spot < min(1.0, sample_rows / max(total, 1))).select(key, F.col(grade).cast("int").alias("g"))
    # The pick is bounded by sample_rows, about 20 bytes each; the texts stay where they are read.
    # However many texts share a picked key, one of them stands for it.
    sample = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), key)
    sample = sample.groupBy(key, "g").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", "g")

    def tell(batches):
        for pdf in batches:
            yield pd.DataFrame({"g": pdf["g"], "f": [sorted(features_of(t)) for t in pdf["t"]]})

    told = written(sample.mapInPandas(tell, "g int, f array<string>"), "ordinal-features")
    # Counting and choosing features happens on the executors; the driver gets the chosen ones.
    seen = told.select("g", F.explode("f").alias("f")).groupBy("f").agg(F.sum(F.when(F.col("g") > 0, 1).otherwise(0)).alias("up"), F.count(F.lit(1)).alias("n"))
    by_grade = {r["g"]: r["n"] for r in told.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(by_grade) < 2:
        return None
    rows_n, base = sum(by_grade.values()), 1 - by_grade.get(0, 0) / sum(by_grade.values())
    lift = F.abs(F.col("up") - base * F.col("n")) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    chosen = [r["f"] for r in seen.where((F.col("n") >= min(least_docs, rows_n)) & (lift >= least_lift)).select("f").orderBy("f").collect()]
    place = {f: i for i, f in enumerate(chosen)}
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def number(batches):
        for pdf in batches:
            at = sent.value
            yield pd.DataFrame({"g": pdf["g"], "c": [sorted(at[f] for f in fs if f in at) for fs in pdf["f"]]})

    data = told.mapInPandas(number, "g int, c array<int>").toPandas()
    w, cuts = fit([np.asarray(c, np.int64) for c in data["c"]], data["g"].to_numpy().clip(0, n_grades - 1), len(chosen), n_grades)
    return OrdinalModel({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4}, cuts)


def severity(spark: SparkSession, text: Column, model: OrdinalModel | None, n_grades: int = 3) -> Column:
    """A struct (expected_severity double, p_toxic double, grade int) for each whole text.

    ``p_toxic`` is P(grade > 0), ``grade`` the likeliest grade (of equally likely ones
    the lowest).  Null counts as empty, an empty text has the score 0 of no features;
    texts are read whole, however long, and a repeated word counts once; equal texts get
    equal results; without a model (no labels of two grades) all three are null.
    """
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("expected_severity"), F.lit(None).cast("double").alias("p_toxic"), F.lit(None).cast("int").alias("grade"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected_severity double, p_toxic double, grade int")
    def run(texts: pd.Series) -> pd.DataFrame:
        up = sent.value.exceed(np.array([sent.value.score(t) for t in texts], float))
        edges = np.column_stack([np.ones(len(up)), up, np.zeros(len(up))])
        return pd.DataFrame({"expected_severity": up.sum(axis=1), "p_toxic": up[:, 0], "grade": (edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype(np.int32)})

    return run(F.coalesce(text, F.lit("")))
