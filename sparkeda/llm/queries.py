"""Queries over the standard tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkeda.llm import decontamination, jaccard, licences, lines, mixing, quality, scoring, sharding, substring, tokens

SHARDS = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokens.token_table(documents(spark, sf_dir), vocabulary)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARDS).select("doc_id", "slot", "shard")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir), keep_text=False)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(documents(spark, sf_dir), keep_text=False)


def line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 with single lines of 50 words or more, and documents of one or two lines, as runs of their own."""
    return lines.deduplicate(documents(spark, sf_dir), keep_text=False, long_words=50, whole=True)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_codes, op2_shards, op3_substring_dedup, op4_licence_scan, op5_source_mix, op6_decontaminate, op7_line_dedup, op8_jaccard_join, op9_quality_rules, op10_lm_scores, line_dedup_passages)}

ORACLES = {
    "op2_shards": sharding.oracle(SHARDS),
    "op4_licence_scan": licences.oracle(),
    "op5_source_mix": mixing.oracle(),
    "op6_decontaminate": decontamination.oracle(),
    "op7_line_dedup": lines.oracle(),
    "line_dedup_passages": lines.passages_oracle(),
}
