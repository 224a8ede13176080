"""Queries of this subpackage over the provided tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from launchlens.llm import bpe, chat, context_mixing, hard_negatives, jaccard, licenses, near_vectors, packing, quality_model, quality_rules, runs, secret_scan, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.audited(near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))).drop("audit_links")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    shown = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(shown).alias("text"))
    return chat.digests(chat.format_chat(turns.unionByName(extra)))


OP2_SQL = chat.oracle(
    "select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'"
)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    path = tok.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(table(spark, sf_dir, "documents"), path, tok.PATTERN, with_ids=False)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label is first made wrong, as the contract says."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(table(spark, sf_dir, "documents"), make_tail=True, digest=True))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_near_vectors, op2_chat_format, op3_jaccard_join, op4_context_mixing, op5_url_filter, op6_quality_rules, op7_bpe, op8_quality_classifier, op9_license_scan, op10_length_packing, op11_hard_negatives, op12_secret_scan, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_near_vectors": near_vectors.oracle(), "op2_chat_format": OP2_SQL, "op3_jaccard_join": jaccard.oracle(), "op5_url_filter": url_filters.oracle(), "op11_hard_negatives": hard_negatives.oracle()}
