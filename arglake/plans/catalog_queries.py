"""Queries over bibliographic tables and taxonomies (stand-ins: see the README)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arglake.functions import text as T
from arglake.operators import catalog, taxonomy
from arglake.plans.registry import Registry
from arglake.session import table

query = Registry()


@query("SELECT coalesce(lang, 'nan') AS value, count(*) AS n FROM documents GROUP BY 1")
def language_distribution(spark, sf_dir):
    return catalog.distribution(table(spark, sf_dir, "documents"), "lang")


_FIELD = """
WITH c AS (SELECT {c}::VARCHAR AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1), a AS (SELECT count(*) AS r, count({c}) AS p FROM {t})
SELECT value, n, round(100 * n / p, 6) AS percent, r - p AS missing, round(100 * (r - p) / r, 6) AS missing_percent FROM c, a
"""


@query(_FIELD.format(c="source", t="documents"))
def source_distribution(spark, sf_dir):
    return catalog.field_distribution(table(spark, sf_dir, "documents"), "source")


@query(_FIELD.format(c="event_type", t="events"))
def event_type_distribution_pct(spark, sf_dir):
    return catalog.field_distribution(table(spark, sf_dir, "events"), "event_type")


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def year_distribution(spark, sf_dir):
    return catalog.year_distribution(table(spark, sf_dir, "orders"), F.year("o_orderdate"))


@query("""
SELECT count(o_totalprice) AS n, sum((o_totalprice IS NULL)::INT)::BIGINT AS missing, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median,
       round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders
""")
def numeric_summary(spark, sf_dir):
    return catalog.numeric_summary(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""
SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS value FROM part) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 20
""")
def top_subjects(spark, sf_dir):
    return catalog.top_values(table(spark, sf_dir, "part"), "p_name", " ", 20)


@query("""
SELECT count(*) AS total, count(DISTINCT coalesce(lang, 'nan')) AS distinct_lang, count(DISTINCT coalesce(source, 'nan')) AS distinct_source, min(n_chars) AS least_n_chars, max(n_chars) AS most_n_chars FROM documents
""")
def metadata_summary(spark, sf_dir):
    return catalog.summary(table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


@query("""
SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 3000 AND source IN ('src1', 'src2', 'src3') AND regexp_matches(coalesce(text, 'nan'), '(?i)license|the ')
""")
def metadata_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("lang").alias("language"), F.col("source").alias("type"), F.col("text").alias("subjects"), F.col("n_chars").alias("year"))
    return catalog.metadata_filter(docs, "en", (500, 3000), ["src1", "src2", "src3"], "license|the ").select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(coalesce(p_name, 'nan'), '(?i)^[a-m].*e')")
def title_regex_search(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "^[a-m].*e")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return catalog.find(table(spark, sf_dir, "customer"), "c_custkey", 42)


def _authors(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("authors"), F.collect_set(F.col("l_partkey").cast("string")).alias("categories"))


@query("""
WITH p AS (SELECT l_orderkey, list(DISTINCT l_suppkey::VARCHAR) AS a, list(DISTINCT l_partkey::VARCHAR) AS c FROM lineitem GROUP BY 1),
e AS (SELECT author, unnest(c) AS category FROM (SELECT unnest(a) AS author, c FROM p))
SELECT author, count(*) AS n FROM e GROUP BY author
""")
def double_explode_inflation(spark, sf_dir):
    return catalog.pair_counts(_authors(spark, sf_dir), "authors", "categories")


@query("""
SELECT l_suppkey::VARCHAR AS author, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1
""")
def author_counts_corrected(spark, sf_dir):
    return catalog.pair_counts(_authors(spark, sf_dir), "authors", "categories", corrected=True)


@query(r"""
WITH r AS (SELECT page_id, regexp_extract(html, '<html lang="(\w+)"', 1) AS lang, row_number() OVER (ORDER BY page_id) AS ordinal FROM pages WHERE page_id >= 10)
SELECT page_id, lang FROM r WHERE ordinal BETWEEN 5 AND 120 AND lang IN ('en', 'fr')
""")
def record_scan_filters(spark, sf_dir):
    lang = F.regexp_extract("html", r'<html lang="(\w+)"', 1)
    rows = table(spark, sf_dir, "pages").select("page_id", lang.alias("lang"), F.array(lang).alias("languages"), F.col("page_id").alias("datestamp"), F.lit(None).cast("string").alias("status"), F.floor(F.col("page_id") / 100).alias("file"), F.col("page_id").alias("pos"))
    return catalog.record_filters(rows, since=10, first=5, last=120, languages=["en", "fr"]).select("page_id", "lang")


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/]+)') THEN regexp_extract(url, '^https?://([^/]+)', 1) ELSE url END AS host, regexp_extract(url, '([^/]*)$', 1) AS leaf FROM pages
""")
def record_id_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extract_id("url", "^https?://([^/]+)").alias("host"), T.last_segment("url").alias("leaf"))


@query("""
SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
""")
def assignment_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return catalog.keep_last(rows, "user_id", "event_id")


@query(r"""
SELECT l.doc_id FROM labels l SEMI JOIN (SELECT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) >= 1000) d USING (doc_id) WHERE quality = 1
""")
def eligible_papers(spark, sf_dir):
    papers = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "article").alias("type"))
    return catalog.eligible(papers, table(spark, sf_dir, "documents"), "doc_id").select("doc_id")


@query("SELECT least(floor((o_totalprice - 0) * 50 / 500000), 49)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1")
def histogram_series(spark, sf_dir):
    return catalog.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0)


@query("""
SELECT d.doc_id, coalesce(CASE d.lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END, d.lang) AS language_name FROM documents d
""")
def language_names(spark, sf_dir):
    names = spark.createDataFrame([("en", "English"), ("de", "German")], "language string, name string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"))
    return catalog.language_names(docs, names).select("doc_id", "language_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def skip_existing(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.skip_existing(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey")


# --- taxonomy: regions 0.., nations 100.., market segments of a nation as leaves -------------------


def _categories(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("category_id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("primary_parent"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("int").alias("category_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("primary_parent"))
    leaf = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("int").alias("category_id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).cast("int").alias("primary_parent"))
    rows = region.unionByName(nation).unionByName(leaf)
    return rows.withColumn("parent_ids", F.when(F.col("primary_parent").isNull(), F.array().cast("array<int>")).otherwise(F.array("primary_parent")))


_CATEGORIES = """c AS (SELECT r_regionkey::INT AS category_id, r_name AS name, NULL::INT AS parent FROM region UNION ALL SELECT (n_nationkey + 100)::INT, n_name, n_regionkey::INT FROM nation
UNION ALL SELECT (c_custkey + 1000)::INT, c_name, (c_nationkey + 100)::INT FROM customer)"""


@query(f"""
WITH RECURSIVE {_CATEGORIES},
p AS (SELECT category_id, parent, name AS path, 1 AS depth FROM c UNION ALL SELECT p.category_id, c.parent, c.name || ' > ' || p.path, p.depth + 1 FROM p JOIN c ON p.parent = c.category_id WHERE p.depth < 10)
SELECT category_id, path, depth::BIGINT AS depth FROM p QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY depth DESC) = 1
""")
def taxonomy_paths(spark, sf_dir):
    return taxonomy.paths(_categories(spark, sf_dir))


@query(f"""
WITH {_CATEGORIES} SELECT c.category_id, c.name, coalesce(p.name, CASE WHEN c.parent IS NOT NULL THEN '[Unknown ID: ' || c.parent || ']' END, '') AS parents FROM c LEFT JOIN c p ON c.parent = p.category_id
""")
def category_parent_names(spark, sf_dir):
    return taxonomy.parent_names(_categories(spark, sf_dir)).select("category_id", "name", F.array_join("parent_names", ";").alias("parents"))


def _assignments(spark, sf_dir):
    """Customers with their nation and region (and an id that no category has)."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("paper_id"), F.array((F.col("n_nationkey") + 100).cast("int"), F.lit(-5), F.col("n_regionkey").cast("int")).alias("category_ids"))


@query("""
SELECT c_custkey::VARCHAR AS paper_id, n_name || ';' || r_name AS names FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0
""")
def category_names_ordered(spark, sf_dir):
    return taxonomy.ordered_names(_assignments(spark, sf_dir), _categories(spark, sf_dir)).select("paper_id", F.array_join("category_names", ";").alias("names"))


@query("""
SELECT c_custkey::VARCHAR AS identifier, CASE WHEN c_acctbal > 0 THEN 3 ELSE 0 END::BIGINT AS num_categories, CASE WHEN c_acctbal > 0 THEN r_name || ' > ' || n_name END AS primary_path,
       CASE WHEN c_acctbal > 0 THEN r_name || ' > ' || n_name || ' | ' || r_name END AS paths
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def papers_with_categories(spark, sf_dir):
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("identifier"))
    out = taxonomy.combine(papers, _assignments(spark, sf_dir), _categories(spark, sf_dir))
    return out.select("identifier", "num_categories", F.col("primary_category_hierarchy").alias("primary_path"), F.col("all_category_hierarchies").alias("paths"))


@query(f"""
WITH {_CATEGORIES}, u AS (SELECT category_id, count(*) AS n FROM (SELECT unnest([n_nationkey + 100, -5, n_regionkey]) AS category_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS categories, (SELECT sum((parent IS NOT NULL)::INT)::BIGINT FROM c) AS with_parents, (SELECT sum((parent IS NULL)::INT)::BIGINT FROM c) AS roots,
       count(*) AS used, max(n) AS most, min(n) AS least, (SELECT category_id::INT FROM u ORDER BY n DESC, category_id LIMIT 1) AS most_used, round(avg(n), 6) AS mean_use FROM u
""")
def category_statistics(spark, sf_dir):
    return taxonomy.statistics(_categories(spark, sf_dir), _assignments(spark, sf_dir))


@query("""
SELECT sum((c_acctbal > 0)::INT)::BIGINT AS with_categories, sum((NOT c_acctbal > 0)::INT)::BIGINT AS without_categories, 0::BIGINT AS unknown_papers FROM customer
""")
def category_coverage(spark, sf_dir):
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("identifier"))
    return taxonomy.usage_report(_categories(spark, sf_dir), _assignments(spark, sf_dir), papers)[0]


@query("SELECT c_custkey::VARCHAR AS paper_id FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3")
def papers_in_category(spark, sf_dir):
    return taxonomy.papers_in(_assignments(spark, sf_dir), 103)
