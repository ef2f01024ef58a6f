"""Queries over vectors and prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arglake.operators import inference, prompts, retrieval
from arglake.plans.registry import Registry
from arglake.session import table
from arglake.work import shared_dir

query = Registry()


_NEAREST = """
SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10
"""


@query(_NEAREST)
def vector_topk_l2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.top_k(vectors, queries, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_NEAREST)
def vector_index_search(spark, sf_dir):
    """The same from an index of two additions, the second of which replaces wrong vectors of the first, that is then compacted."""
    path = f"{shared_dir(spark)}/arglake/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = retrieval.VectorIndex(spark, path)
    index.add(vectors.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding")))
    index.add(vectors.where("vec_id % 3 = 0"))
    index.compact()
    found = index.search(vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 80 THEN 1 ELSE 1 + ceil((n - 80) / 68)::BIGINT END)) AS i FROM w)
SELECT doc_id AS id, i::INT AS chunk_index, least(80, n - 68 * i)::INT AS tokens FROM c
""")
def token_chunks(spark, sf_dir):
    """Chunks of 80 words, 12 of them shared; the tests hold chunks of a tokenizer's tokens against brute force."""
    return retrieval.token_chunks(table(spark, sf_dir, "documents"), size=80, overlap=12).select("id", "chunk_index", "tokens")


@query("""
WITH c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY i))
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS similarity FROM embeddings, c
""")
def centroid_ranking(spark, sf_dir):
    return retrieval.centroid_ranking(table(spark, sf_dir, "embeddings")).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def vector_cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(retrieval.cosine("x", "y"), 6).alias("similarity"))


@query("""
SELECT c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (ORDER BY c_acctbal, c_custkey) <= greatest(1, floor(0.03 * count(*) OVER ()))
""")
def bottom_percent(spark, sf_dir):
    return retrieval.bottom_share(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")


@query()
def embed_documents(spark, sf_dir):
    return retrieval.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


_PROMPTS = [("zero-shot", "1", "1", "You are careful.", "Read: <paper text inserted here> END"), ("zero-shot", "2", "1", "You are brief.", "Summarise <paper text inserted here>.")]
_PROMPT_SQL = "(VALUES " + ", ".join("('" + "', '".join(p) + "')" for p in _PROMPTS) + ") p(shot_type, variation, user_file, system, u)"


def _prompts(spark):
    return prompts.prompt_table(spark, [dict(zip(("shot_type", "variation", "user_file", "system", "user"), p)) for p in _PROMPTS])


@query(f"SELECT item_id, shot_type, variation, user_file, system, replace(u, '<paper text inserted here>', text) AS user FROM benchmark, {_PROMPT_SQL} WHERE text IS NOT NULL")
def prompt_cross(spark, sf_dir):
    return prompts.prompt_papers(_prompts(spark), table(spark, sf_dir, "benchmark"))


@query("SELECT item_id, replace('Read: <paper text inserted here> END', '<paper text inserted here>', text) AS prompt FROM benchmark")
def prompt_render(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", prompts.render(F.lit("Read: <paper text inserted here> END"), F.col("text")).alias("prompt"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def stepwise_fold(spark, sf_dir):
    return prompts.fold_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""
SELECT doc_id, 'Task: Extract the argument map.' || chr(10) || chr(10) || 'Input:' || chr(10) || text || chr(10) || chr(10) || 'Return JSON with keys: ACC, ARI, ARC' AS prompt FROM documents
""")
def default_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.default_prompt(F.col("text")).alias("prompt"))


@query(f"""
WITH p AS (SELECT item_id, variation, system, replace(u, '<paper text inserted here>', text) AS user FROM benchmark, {_PROMPT_SQL} WHERE text IS NOT NULL)
SELECT item_id, variation, length(system) || ':' || length(user) AS text, len(regexp_extract_all(user, '\\S+'))::BIGINT AS tokens, NULL::VARCHAR AS error FROM p
""")
def generate_outputs(spark, sf_dir):
    return inference.generate(prompts.prompt_papers(_prompts(spark), table(spark, sf_dir, "benchmark"))).select("item_id", "variation", "text", "tokens", "error")


@query("""
WITH f AS (SELECT item_id, '3:' || length(coalesce(text, '')) AS one FROM benchmark)
SELECT item_id, '3:' || (6 + length(one)) AS text, [one, '3:' || (6 + length(one))] AS trace FROM f
""")
def generate_stepwise(spark, sf_dir):
    steps = F.array(F.struct(F.lit("one").alias("system"), F.col("text").alias("user")), F.struct(F.lit("two").alias("system"), F.lit("Given <step 1 output>").alias("user")))
    return inference.run_steps(table(spark, sf_dir, "benchmark").select("item_id", steps.alias("steps"))).select("item_id", "text", "trace")
