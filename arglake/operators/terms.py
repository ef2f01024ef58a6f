"""Counts of terms and their combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.functions.text import col, matched_terms

# The stems of the topic.
STEMS = ["ethic", "moral", "deontolog", "utilitar", "virtue", "justice"]


def term_counts(df: DataFrame, column, stems: list[str] = STEMS, combos: bool = True) -> DataFrame:
    """(term, n): rows that have each stem and, for rows with several, each combination as ``Combo: a + b``."""
    rows = df.select(matched_terms(column, stems).alias("terms"))
    single = rows.select(F.explode("terms").alias("term"))
    if combos:
        several = rows.where(F.size("terms") > 1).select(F.concat(F.lit("Combo: "), F.array_join(F.array_sort("terms"), " + ")).alias("term"))
        single = single.unionByName(several)
    return single.groupBy("term").agg(F.count("*").alias("n"))


def topic_share(df: DataFrame, key: str, column, stems: list[str] = STEMS) -> DataFrame:
    """Distinct keys with a matching value, other distinct keys, and the share of rows that match."""
    match = F.lower(F.coalesce(col(column), F.lit(""))).rlike("|".join(stems))
    per_key = df.groupBy(key).agg(F.max(match.cast("int")).alias("m"), F.count("*").alias("rows"), F.sum(match.cast("long")).alias("hits"))
    return per_key.agg(F.count("*").alias("keys"), F.sum(F.col("m").cast("long")).alias("matching"), F.sum((1 - F.col("m")).cast("long")).alias("others"), F.sum("rows").alias("rows"), F.sum("hits").alias("matching_rows"), F.round(100 * F.sum("hits") / F.sum("rows"), 6).alias("percent_rows"))
