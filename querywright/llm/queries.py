"""The registered queries of this subpackage: thin callers of the operators, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm import bpe_count, cdc, html_blocks, interleave, jaccard, langid, mixing, oracle, ordinal, spaced, warc
from querywright.llm.common import on_all_cores, read_table, written

TOKEN_LIMIT = 512
N_SHARDS = 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = on_all_cores(read_table(spark, sf_dir, "documents"))
    model = ordinal.train(docs, ordinal.grades_from_labels(read_table(spark, sf_dir, "labels")))
    told = docs.select("doc_id", ordinal.severity(spark, F.col("text"), model).alias("s"))
    return told.select("doc_id", "s.expected_severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= 0.5).alias("toxic"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = on_all_cores(read_table(spark, sf_dir, "documents"))
    n = bpe_count.token_count(spark, F.col("text"), tokenizer_path("byte_bpe_50k.json"))
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_single_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.fingerprint_with_neighbours(read_table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = on_all_cores(read_table(spark, sf_dir, "pages"))
    told = pages.select("page_id", "url", html_blocks.extract_main_text(F.col("html")).alias("text"))
    return told.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = on_all_cores(read_table(spark, sf_dir, "documents"))
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out), tokenizer_path("piece_bpe_32k.model"))
    found = docs.select("doc_id", out.alias("held_out"), langid.predict(spark, F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_groups(on_all_cores(read_table(spark, sf_dir, "documents")))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    dealt = interleave.interleave(written(sized, "shard-sizes"), N_SHARDS, tie=("text_crc32", "size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def mix_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document belongs to the source 'all' and English ones to 'en' as well; quotas ask for all words once, then twice.

    Filling source by source would take English documents too often; the flow shares
    their words between the two quotas.
    """
    docs = read_table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    sized = docs.select("doc_id", mixing.word_count(F.col("text")).alias("size"), F.when(english, F.array(F.lit("all"), F.lit("en"))).otherwise(F.array(F.lit("all"))).alias("members"))
    sized = written(sized, "mix-overlapping")
    n = sized.agg(F.sum(F.when(F.size("members") == 2, F.col("size"))).alias("en"), F.sum("size").alias("all")).first()
    total, own = n["all"] or 0, (n["en"] or 0) // 3
    out = None
    for times in (1, 2):
        mixed = mixing.mix_by_membership(sized, "members", "size", {"all": float(times * (total - own)), "en": float(times * own)})
        part = mixed.select("doc_id", F.lit(times).alias("times"), "copies", "taken")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_mix_sources": op4_mix_sources,
    "op5_fingerprints": op5_fingerprints,
    "op6_main_text": op6_main_text,
    "op7_language": op7_language,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_contamination": op9_contamination,
    "op10_shards": op10_shards,
    "mix_overlapping": mix_overlapping,
}

SQL: dict[str, str] = dict(oracle.SQL)
