"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all
but the last return the columns of ``documents``, further and clashing ones too.  An empty table passes through as an
empty table; repeated rows are rows of their own until exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arglake.llm import exact_dedup, jaccard_join, mixing, piece_coding, toxicity
from arglake.llm.common import materialise, table
from arglake.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon scores 0.3 or more go.  It learns from all labelled rows outside the held-out
    fold; null and empty texts have no term and stay, and without labels the seed lexicon decides."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.clean_rows(docs, lexicon)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (runs of white space as one space, null as empty) the one with the smallest doc_id
    stays; of rows that repeat id and text one; null ids are the largest."""
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more the one with the smallest doc_id stays; texts without
    words are linked with nothing and stay."""
    return jaccard_join.one_of_each(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small languages are repeated, to smoothed token shares, and none is dropped; languages are learned from
    the documents that ``labels`` lists, without which all are one domain and every row stays once."""
    return mixing.mix_rows(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded text and the digests of both, for each row; a null text has the end id alone."""
    return piece_coding.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), keep_ids=True, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_languages),
    ("piece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{i}")
    return docs


#: SQL cannot express the stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
