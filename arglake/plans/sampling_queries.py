"""Queries of the sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arglake.operators import sampling
from arglake.plans.registry import Registry
from arglake.session import table

query = Registry()


@query("""
WITH e AS (SELECT c_nationkey AS g, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_acctbal) AS n FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN NOT (n >= 4 AND lo < q[1] AND q[1] < q[2] AND q[2] < q[3] AND q[3] < hi) OR c_acctbal IS NULL OR c_acctbal <= q[1] THEN 'Q1' WHEN c_acctbal <= q[2] THEN 'Q2' WHEN c_acctbal <= q[3] THEN 'Q3' ELSE 'Q4' END AS quartile
FROM customer JOIN e ON c_nationkey = g
""")
def year_quartiles(spark, sf_dir):
    return sampling.quartiles(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal").select("c_custkey", "quartile")


@query("""
WITH c AS (SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT g, n, round_even(n * 200 / sum(n) OVER (), 0)::BIGINT AS s FROM c)
SELECT g AS c_mktsegment, n, greatest(0, s + CASE WHEN row_number() OVER (ORDER BY n DESC, g DESC) = 1 THEN 200 - (SELECT sum(s) FROM s) ELSE 0 END)::BIGINT AS allocated FROM s
""")
def cluster_allocation(spark, sf_dir):
    return sampling.allocation(table(spark, sf_dir, "customer"), "c_mktsegment", 200)


@query()
def constrained_sample(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    quotas = sampling.allocation(customers, "c_nationkey", 60)
    return sampling.constrained_draw(customers, "c_nationkey", "c_custkey", quotas, ["c_mktsegment"])


_TFIDF = r"""
w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\b\w\w+\b')) AS term FROM part),
tf AS (SELECT p_partkey, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(DISTINCT p_partkey) AS n FROM part),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
"""


@query(f"""
WITH {_TFIDF}, r AS (SELECT p_partkey, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT p_partkey, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS weight FROM r
""")
def title_tfidf(spark, sf_dir):
    return sampling.tfidf(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", "term", F.round("weight", 6).alias("weight"))


#: Words that the titles of the query below leave out.
_STOP_WORDS = ["the", "of", "and", "in", "for"]


@query(rf"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN '  ' WHEN p_partkey % 11 = 2 THEN 'the ' || p_name || ' of the ' || p_type ELSE p_name END AS title FROM part),
k AS (SELECT * FROM t WHERE trim(title) <> ''), n AS (SELECT count(*) AS n FROM k),
w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(title), '\b\w\w+\b')) AS term FROM k),
tf AS (SELECT p_partkey, term, count(*) AS tf FROM w WHERE term NOT IN ({", ".join(f"'{x}'" for x in _STOP_WORDS)}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
f AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf, n FROM df, n WHERE df >= 2),
r AS (SELECT p_partkey, term, tf * idf AS w, n FROM tf JOIN f USING (term)), u AS (SELECT p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS w, n FROM r),
c AS (SELECT term, sum(w) / max(n) AS c FROM u GROUP BY 1), l AS (SELECT sqrt(sum(c * c)) AS len FROM c),
d AS (SELECT p_partkey, sum(w * c) AS dot FROM u JOIN c USING (term) GROUP BY 1)
SELECT p_partkey, round(1 - coalesce(dot / len, 0), 6) AS distance FROM k LEFT JOIN d USING (p_partkey), l
""")
def title_diversity(spark, sf_dir):
    """Titles that are missing, blank or have stop words, too."""
    rest = F.col("p_partkey") % 11
    title = F.when(rest == 0, F.lit(None)).when(rest == 1, F.lit("  ")).when(rest == 2, F.concat(F.lit("the "), "p_name", F.lit(" of the "), "p_type")).otherwise(F.col("p_name"))
    parts = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    return sampling.diversity(parts, "p_partkey", "title", stop_words=_STOP_WORDS).select("p_partkey", F.round("distance", 6).alias("distance"))


@query()
def sample_with_suggestions(spark, sf_dir):
    """More rows are wanted than the draw can find without a repeated segment and balance, so that suggestions follow."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor("c_acctbal").alias("balance"))
    return sampling.sample_with_suggestions(customers, "c_nationkey", "c_custkey", 150, ["c_mktsegment", "balance"])


@query()
def title_clusters(spark, sf_dir):
    return sampling.clusters(table(spark, sf_dir, "part"), "p_partkey", "p_name", k=12)


@query("""
WITH f AS (SELECT p_partkey, p_name, p_size <= 3 AS sampled, regexp_matches(lower(p_name), 'red|blue') AS t FROM part),
x AS (SELECT greatest(0, ceil(0.5 * count(*)) - sum(t::INT))::BIGINT AS need FROM f WHERE sampled),
o AS (SELECT p_partkey FROM f, x WHERE sampled AND NOT t QUALIFY row_number() OVER (ORDER BY p_partkey) <= need),
a AS (SELECT p_partkey FROM f, x WHERE NOT sampled AND t QUALIFY row_number() OVER (ORDER BY p_partkey) <= need)
SELECT p_partkey FROM f WHERE sampled AND p_partkey NOT IN (SELECT p_partkey FROM o) UNION ALL SELECT p_partkey FROM a
""")
def topic_ratio_fill(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return sampling.fill_ratio(parts.where("p_size <= 3"), parts, "p_partkey", "p_name", 0.5, ["red", "blue"]).select("p_partkey")


@query("""
SELECT o_orderkey, concat_ws('|', coalesce(o_custkey::VARCHAR, 'nan'), coalesce(year(o_orderdate)::VARCHAR, 'nan'), coalesce(o_orderpriority, 'None')) AS stratum FROM orders
""")
def stratum_label(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return orders.select("o_orderkey", sampling.stratum("o_custkey", "y", "o_orderpriority").alias("stratum"))


@query()
def random_sample(spark, sf_dir):
    return sampling.random_sample(table(spark, sf_dir, "customer"), "c_custkey", 100)
