"""Queries over document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from arglake.functions import text as T
from arglake.operators import catalog, retrieval, terms
from arglake.plans.registry import Registry
from arglake.session import table

query = Registry()
STEMS = ["tion", "ment", "heit", "thing"]
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'))::BIGINT"


@query(rf"""
WITH w AS (SELECT {_WORDS} AS n FROM documents)
SELECT count(*) AS n_docs, sum((n > 100)::INT)::BIGINT AS over_100, sum((n > 500)::INT)::BIGINT AS over_500, sum((n > 1000)::INT)::BIGINT AS over_1000,
       round(100 * sum((n > 100)::INT) / count(*), 6) AS percent_over_100, round(100 * sum((n > 500)::INT) / count(*), 6) AS percent_over_500,
       round(100 * sum((n > 1000)::INT) / count(*), 6) AS percent_over_1000,
       round(avg(n), 6) AS mean_words, median(n) AS median_words, round(stddev_pop(n), 6) AS std_words, min(n) AS min_words, max(n) AS max_words FROM w
""")
def word_count_thresholds(spark, sf_dir):
    return catalog.word_thresholds(table(spark, sf_dir, "documents"))


@query(rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS n FROM documents),
b AS (SELECT (CASE WHEN n > 1000 THEN 1000 WHEN n > 500 THEN 500 WHEN n > 100 THEN 100 ELSE 0 END)::BIGINT AS bucket, doc_id, n FROM w)
SELECT bucket, doc_id, n FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n, doc_id) <= 10
""")
def word_count_examples(spark, sf_dir):
    return catalog.word_examples(table(spark, sf_dir, "documents"))


@query(rf"""
WITH t AS (SELECT length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))::BIGINT AS chars, {_WORDS} AS words FROM documents)
SELECT count(*) AS n_docs, round(avg(chars), 6) AS mean_chars, median(chars) AS median_chars, round(stddev_pop(chars), 6) AS std_chars, min(chars) AS min_chars, max(chars) AS max_chars,
       round(avg(words), 6) AS mean_words, median(words) AS median_words, round(stddev_pop(words), 6) AS std_words, min(words) AS min_words, max(words) AS max_words
FROM t WHERE chars > 0
""")
def content_lengths(spark, sf_dir):
    return catalog.content_lengths(table(spark, sf_dir, "documents"))


@query("""
SELECT count(*) AS papers, count(l.doc_id) AS available, round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS rate
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def content_availability(spark, sf_dir):
    return catalog.availability(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_MATCHED = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '(" + "|".join(STEMS) + ")', 1))"


@query(f"""
WITH m AS (SELECT list_sort({_MATCHED}) AS terms FROM documents),
t AS (SELECT unnest(terms) AS term FROM m UNION ALL SELECT 'Combo: ' || array_to_string(terms, ' + ') FROM m WHERE len(terms) > 1)
SELECT term, count(*) AS n FROM t GROUP BY term
""")
def term_counts(spark, sf_dir):
    return terms.term_counts(table(spark, sf_dir, "documents"), "text", STEMS)


@query(r"""
WITH p AS (SELECT source, max(regexp_matches(lower(coalesce(text, '')), 'license|apache')::INT) AS m, count(*) AS r, sum(regexp_matches(lower(coalesce(text, '')), 'license|apache')::INT) AS h FROM documents GROUP BY source)
SELECT count(*) AS keys, sum(m)::BIGINT AS matching, sum(1 - m)::BIGINT AS others, sum(r)::BIGINT AS rows, sum(h)::BIGINT AS matching_rows, round(100 * sum(h) / sum(r), 6) AS percent_rows FROM p
""")
def topic_docs(spark, sf_dir):
    return terms.topic_share(table(spark, sf_dir, "documents"), "source", "text", ["license", "apache"])


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '-[?\s]\n{1,2}([\p{L}\p{N}_]+ *)', E'\\1\n', 'g'), '-\s{1,2}([\p{L}\p{N}_]+ *)', '\1', 'g') AS text FROM documents
""")
def clean_stage_hyphen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.dehyphenate("text").alias("text"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_LINES = "l AS (SELECT doc_id, (i - 1)::INT AS pos, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"


@query(rf"""
WITH {_LINES}, t AS (SELECT *, trim(line) AS t, regexp_matches(coalesce(string_split(trim(line), ' ')[2], ''), '[1-3][0-9][0-9][0-9]') AS dated FROM l)
SELECT doc_id, pos, CASE WHEN length(line) < 50 AND (t[1] = '©' OR (dated AND (t[1] = 'r' OR string_split(t, ' ')[1] = 'copyright'))) THEN '' ELSE line END AS line FROM t
""")
def clean_stage_header(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.drop_header("line").alias("line"))


@query(r"""SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '\s\s+', ' ', 'g') AS text FROM documents""")
def clean_stage_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze_spaces(T.newlines_to_spaces("text")).alias("text"))


@query(rf"""
WITH {_LINES}
SELECT doc_id, pos, round(len(regexp_extract_all(line, '\(cid:[0-9]+\)')) * 8 / length(line), 6) AS cid, round(length(regexp_replace(line, '[^A-Za-z]', '', 'g')) / length(line), 6) AS letters
FROM l WHERE length(line) > 0
""")
def clean_stage_shares(spark, sf_dir):
    return _lines(spark, sf_dir).where(F.length("line") > 0).select("doc_id", "pos", F.round(T.cid_share("line"), 6).alias("cid"), F.round(T.letter_share("line"), 6).alias("letters"))


@query(rf"""
WITH {_LINES}
SELECT doc_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(trim(line), '^[0-9]+', ''), '[0-9]+$', '')), '\(cid:[0-9]+\)', '', 'g') AS line FROM l
""")
def clean_stage_digits(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.remove_cids(T.strip_edge_digits("line")).alias("line"))


@query()
def clean_document(spark, sf_dir):
    return T.clean_documents(table(spark, sf_dir, "documents"), separator="\n")


@query("SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 3 THEN ' Schön – Schön' ELSE ' café' END AS p_name FROM part")
def mojibake_fix(spark, sf_dir):
    """Names with a word that is whole, was decoded wrongly once or twice, or in part."""
    rest = F.col("p_partkey") % 4
    garbled = F.when(rest == 0, " café").when(rest == 1, " cafÃ©").when(rest == 2, " cafÃƒÂ©").otherwise(" SchÃ¶n – SchÃƒÂ¶n")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", garbled).alias("p_name")).select("p_partkey", T.fix_mojibake("p_name").alias("p_name"))


@query(r"""
WITH b AS (SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS bare FROM benchmark),
d AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS bare FROM documents)
SELECT item_id, count(doc_id) AS n_docs, min(doc_id) AS first_doc FROM b LEFT JOIN d ON contains(d.bare, b.bare) GROUP BY item_id
""")
def quote_in_source(spark, sf_dir):
    """Where the quotes of a stated set (the benchmark items) are found: they are matched together against every document."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.regexp_replace("text", r"\s+", "")).alias("quote"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_replace("text", r"\s+", "")).alias("text"))
    hits = retrieval.contained(items, docs, "item_id", "doc_id").groupBy(F.col("quote_id").alias("item_id")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")


@query()
def sentence_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.start", "s.end", "s.text")


@query()
def text_chunks(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents"))


@query(r"""SELECT page_id, len(string_split(url, '/'))::BIGINT AS n FROM pages""")
def multi_value_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.multi_value_count("url", "/").alias("n"))


@query(r"""
WITH y AS (SELECT page_id, TRY_CAST(regexp_extract(url, '\b(\d{1,4})\b', 1) AS INT) AS y FROM pages)
SELECT page_id, CASE WHEN y BETWEEN 1 AND 2026 THEN y END AS year FROM y
""")
def year_parse_a(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.year_word("url").alias("year"))


@query(r"""
WITH d AS (SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS d FROM pages)
SELECT page_id, CASE WHEN length(d) >= 3 AND TRY_CAST(d[1:4] AS INT) BETWEEN 1500 AND 2035 THEN TRY_CAST(d[1:4] AS INT) END AS year FROM d
""")
def year_parse_b(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.year_digits("url").alias("year"))


@query(r"""
SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INT) AS year FROM pages
""")
def year_parse_c(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.year_number(F.regexp_extract("url", r"/([0-9]+)", 1)).alias("year"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\s]+'))::BIGINT AS tokens FROM documents
""")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").alias("tokens"))


@query(r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents
""")
def prompt_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise_lines("text").alias("text"))
