"""Driver queries of the operators in this package, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate as D
from veilspark.llm.common import table
from veilspark.llm.repeats import remove_repeats
from veilspark.llm import personal
from veilspark.llm.wrapper import main_text
from veilspark.llm import urlfilter
from veilspark.llm import quality
from veilspark.llm import langid
from veilspark.llm import merkle, negatives, tokenfile
from veilspark.llm.simhash import near_duplicates
from veilspark.llm.packing import pack
from veilspark.llm.sharding import shard_rows


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op8_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op7_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op1_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op5_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda host, path: urlfilter.has_word(host, urlfilter.LISTED_WORDS)
    found = urlfilter.filter_urls(table(spark, sf_dir, "pages"), listed)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op2_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(personal.KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(personal.listed("base"), 256).alias("base_sha256"), personal.listed("spans").alias("spans"))


def op6_merged_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_kronecker_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op13_cogrouped_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), claimed=merkle.tampered())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op4_feistel_shards": op4_feistel_shards,
        "op8_minimum_slack_packing": op8_minimum_slack_packing,
        "op10_prefix_decontamination": op10_prefix_decontamination,
        "op7_pigeonring_simhash": op7_pigeonring_simhash,
        "op3_hyperdimensional_langid": op3_hyperdimensional_langid,
        "op1_isolation_forest_quality": op1_isolation_forest_quality,
        "op5_bloom_cascade_urls": op5_bloom_cascade_urls,
        "op2_wrapper_main_text": op2_wrapper_main_text,
        "op9_boosted_personal_data": op9_boosted_personal_data,
        "op6_merged_bwt_repeats": op6_merged_bwt_repeats,
        "op11_repair_token_files": op11_repair_token_files,
        "op12_kronecker_hard_negatives": op12_kronecker_hard_negatives,
        "op13_cogrouped_merkle": op13_cogrouped_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_bloom_cascade_urls": urlfilter.oracle_sql(),
        "op10_prefix_decontamination": D.oracle_sql(),
        "op12_kronecker_hard_negatives": negatives.oracle_sql(),
        "op13_cogrouped_merkle": merkle.oracle_sql(),
    }
