"""Five corpus stages in a row: language, near duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm import interleave, jaccard, langid, mixing, spaced
from querywright.llm.common import on_all_cores, read_table, written
from querywright.llm.queries import N_SHARDS, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose likeliest language is less sure than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a determined language go; the rest stay as they are."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), tokenizer_path("piece_bpe_32k.model"))
    told = docs.withColumn("_qw_p", langid.predict(spark, F.col("text"), model))
    sure = (F.col("_qw_p.lang_pred") != langid.UNDETERMINED) & (F.col("_qw_p.score") >= LEAST_LANGUAGE_SCORE)
    return told.where(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near or exact copies the document with the smallest id stays."""
    return jaccard.keep_first_of_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a passage of a test item go."""
    return spaced.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document stays as many times as the mix takes it."""
    return mixing.repeat_taken(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all rows with their shard and slot."""
    return interleave.interleave(docs, N_SHARDS, tie=("text",))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: SQL has no segmentation-marginalised model; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = on_all_cores(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
