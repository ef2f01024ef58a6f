"""The queries opN_<name> and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arglake.llm import cross_polytope, exact_dedup, jaccard_join, main_text, maxent_lm, mixing, piece_coding, quality_rules, snapshot_diff, spelling, suffix_dedup, token_blocks, toxicity
from arglake.llm.common import table


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_table(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled).drop("row")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.language_model(table(spark, sf_dir, "documents"))


def op9_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep_ids=False, digests=True)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"))


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = snapshot_diff.snapshot_diff(docs, snapshot_diff.later_snapshot(docs), "doc_id", ["text", "lang", "source"], ["text", "lang"], snapshot_diff.document_row())
    return found.select("key", "old_key", "op", "changed", F.col("row_digest").alias("row_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_main_text": op3_main_text,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_maxent_lm": op8_maxent_lm,
    "op9_piece_coding": op9_piece_coding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_cross_polytope": op11_cross_polytope,
    "op12_snapshot_diff": op12_snapshot_diff,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op12_snapshot_diff": snapshot_diff.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
