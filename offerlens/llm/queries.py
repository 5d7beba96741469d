"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import (
    html_text, merkle, mixing, ngram_trie, packing, permutation_index, quality_rules, rindex_dedup, secrets, simhash, spelling, suffix_trees, token_counts,
)
from offerlens.llm.common import read
from offerlens.llm.oracle import oracle_sql


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read(spark, sf_dir, "documents"), tokenizer_path(secrets.VOCABULARY))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors.where("vec_id % 50 = 0"), vectors)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(token_counts.MODEL))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def op8_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(read(spark, sf_dir, "documents"), order=3)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(packing.TOKENIZER))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_passage_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_passages(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_repeat_removal, op2_source_mix, op3_secret_scan, op4_html_text, op5_nearest_vectors, op6_token_counts, op7_quality_rules, op8_ngram_scores, op9_simhash_groups, op10_sequence_packing,
            op11_spelling_variants, op12_passage_removal, op13_merkle_manifest,
        )
    }


__all__ = ["oracle_sql", "queries", "tokenizer_path"]
