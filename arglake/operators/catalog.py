"""Bibliographic tables: filters, lookups, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arglake.functions.text import col, contains_any, multi_values, token_count, word_count
from arglake.operators.quantiles import medians
from arglake.work import written

#: Stems of the topic.
TOPIC = ["philosophy", "ethic", "moral", "value", "virtue"]


# --- filters and lookups --------------------------------------------------------------------------


def find(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key).cast("string") == str(value)).limit(1)


def search(df: DataFrame, column: str, pattern: str, case: bool = False) -> DataFrame:
    """Regular-expression search; null reads as the text 'nan'."""
    return df.where(F.coalesce(F.col(column), F.lit("nan")).rlike(pattern if case else f"(?i){pattern}"))


def metadata_filter(df: DataFrame, language=None, years=None, types=None, subjects=None, year_column="year") -> DataFrame:
    """Conjunction of equal language, inclusive years, listed types and a pattern in the subjects; absent columns are not filtered."""
    if language is not None and "language" in df.columns:
        df = df.where(F.col("language") == language)
    if years is not None and year_column in df.columns:
        df = df.where(F.col(year_column).cast("string").try_cast("double").between(*years))
    if types is not None and "type" in df.columns:
        df = df.where(F.col("type").isin(list(types)))
    if subjects is not None and "subjects" in df.columns:
        df = search(df, "subjects", subjects)
    return df


def record_filters(df: DataFrame, keep_deleted=True, since=None, until=None, first=None, last=None, languages=None, limit=None, order=("file", "pos")) -> DataFrame:
    """Harvest filters in their order: deleted, stamp range (inclusive), ordinal range of what is left, any language, limit.

    The ordinal needs one order over all records: it is counted per file first, and files are added up.
    """
    if not keep_deleted:
        df = df.where(~F.col("status").eqNullSafe("deleted"))
    if since is not None or until is not None:
        df = df.where(F.col("datestamp").isNotNull())
        if since is not None:
            df = df.where(F.col("datestamp") >= F.lit(since))
        if until is not None:
            df = df.where(F.col("datestamp") <= F.lit(until))
    if first is not None or last is not None:
        df = with_ordinal(df, *order)
        df = df.where(F.col("ordinal").between(first or 1, last or 2**62))
    if languages:
        df = df.where(F.arrays_overlap("languages", F.array(*map(F.lit, languages))))
    return df.limit(limit) if limit is not None else df


def with_ordinal(df: DataFrame, group: str, position: str) -> DataFrame:
    """1-based number in the order (group, position): a window inside each group, and running group totals (a row a group)."""
    inside = F.row_number().over(Window.partitionBy(group).orderBy(position))
    totals = df.groupBy(group).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col(group).alias("_g"), before.alias("_before"))
    return df.withColumn("_n", inside).join(totals, F.col(group).eqNullSafe(F.col("_g"))).withColumn("ordinal", (F.col("_n") + F.col("_before")).cast("long")).drop("_n", "_g", "_before")


def eligible(papers: DataFrame, documents: DataFrame, key: str = "identifier", least_tokens: int = 1000) -> DataFrame:
    """Articles whose text is there and has enough white-space tokens."""
    long = documents.where(token_count("text") >= least_tokens).select(key)
    return papers.where("type = 'article'").join(long, key, "left_semi")


def download_filter(df: DataFrame, languages=None, years=None, shuffle_seed=None, limit=None, key="identifier") -> DataFrame:
    if languages:
        df = df.where(F.col("language").rlike("(?i)" + "|".join(languages)))
    if years:
        df = df.where(F.col("year").cast("string").try_cast("int").between(*years))
    if shuffle_seed is not None:
        df = df.orderBy(F.xxhash64(F.col(key), F.lit(shuffle_seed)))
    return df.limit(limit) if limit is not None else df


def is_topic(c):
    return contains_any(F.coalesce(col(c), F.lit("")), TOPIC)


def skip_existing(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


# --- distributions --------------------------------------------------------------------------------


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n); null counts as 'nan'."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).agg(F.count("*").alias("n"))


def field_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent, missing, missing_percent): shares of the rows that have a value, and what is missing."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    totals = df.agg(F.count("*").alias("rows"), F.count(column).alias("present"))
    out = counts.where("value is not null").join(F.broadcast(totals))  # one row
    return out.select("value", "n", F.round(100 * F.col("n") / F.col("present"), 6).alias("percent"), (F.col("rows") - F.col("present")).alias("missing"), F.round(100 * (F.col("rows") - F.col("present")) / F.col("rows"), 6).alias("missing_percent"))


def year_distribution(df: DataFrame, year) -> DataFrame:
    return df.select(col(year).cast("long").alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, separator: str, n: int) -> DataFrame:
    """The ``n`` most frequent parts of a multi-value column; ties by value."""
    rows = df.select(F.explode(multi_values(column, separator)).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """count, missing, mean, median, sample deviation, least and most."""
    x = F.col(column)
    stats = df.agg(F.count(x).alias("n"), F.sum(x.isNull().cast("long")).alias("missing"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    middle = medians(df.select(x.alias("x")), "x").select(F.round("median_x", 6).alias("median"))
    return stats.join(F.broadcast(middle)).select("n", "missing", "mean", "median", "std", "least", "most")  # a row each


def summary(df: DataFrame, distinct: list[str], span: str | None = None) -> DataFrame:
    """Rows, distinct values (null counts as one) of ``distinct``, range of ``span``."""
    columns = [F.count("*").alias("total")]
    columns += [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("nan"))).alias(f"distinct_{c}") for c in distinct]
    if span:
        columns += [F.min(span).alias(f"least_{span}"), F.max(span).alias(f"most_{span}")]
    return df.agg(*columns)


def pair_counts(df: DataFrame, authors: str, categories: str, corrected: bool = False) -> DataFrame:
    """(author, n): each author counts once for each category of a paper, papers lacking either dropped; once a paper if ``corrected``."""
    rows = df.select(F.explode(authors).alias("author"), F.col(categories).alias("_c"))
    rows = rows.where("author is not null and trim(author) <> ''")
    if corrected:
        rows = rows.where(F.size("_c") > 0)
    else:
        rows = rows.select("author", F.explode("_c").alias("category")).where("category is not null and trim(category) <> ''")
    return rows.groupBy("author").agg(F.count("*").alias("n"))


# --- documents ------------------------------------------------------------------------------------


def word_thresholds(docs: DataFrame, thresholds=(100, 500, 1000)) -> DataFrame:
    n = F.col("n")
    over = [F.sum((n > k).cast("long")) for k in thresholds]
    rows = written(docs.select(word_count("text").alias("n")), "word-counts")
    stats = rows.agg(
        F.count("*").alias("n_docs"),
        *(o.alias(f"over_{k}") for o, k in zip(over, thresholds)),
        *(F.round(100 * o / F.count("*"), 6).alias(f"percent_over_{k}") for o, k in zip(over, thresholds)),
        F.round(F.avg(n), 6).alias("mean_words"),
        F.round(F.stddev_pop(n), 6).alias("std_words"),
        F.min(n).alias("min_words"),
        F.max(n).alias("max_words"),
    )
    return stats.join(F.broadcast(medians(rows, "n").withColumnRenamed("median_n", "median_words")))  # a row each


def word_examples(docs: DataFrame, thresholds=(100, 500, 1000), each: int = 10) -> DataFrame:
    """(bucket, doc_id, n): up to ``each`` shortest documents above each threshold and below the next."""
    n = F.col("n")
    bucket = F.lit(0)
    for k in thresholds:
        bucket = F.when(n > k, F.lit(k)).otherwise(bucket)
    rows = docs.select("doc_id", word_count("text").alias("n")).withColumn("bucket", bucket.cast("long"))
    # a partial top-k in each task's slice of a bucket, so no bucket meets in one task
    slices = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket", slices).orderBy("n", "doc_id"))).where(F.col("r") <= each)
    return some.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("n", "doc_id"))).where(F.col("r") <= each).select("bucket", "doc_id", "n")


def content_lengths(docs: DataFrame) -> DataFrame:
    """Characters of the trimmed text and words, over documents that are not empty."""
    t = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"^\s+|\s+$", "")
    rows = docs.select(F.length(t).cast("long").alias("chars"), word_count("text").alias("words")).where("chars > 0")
    rows = written(rows, "content-lengths")
    out = [F.count("*").alias("n_docs")]
    for c in ("chars", "words"):
        out += [F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.stddev_pop(c), 6).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return rows.agg(*out).join(F.broadcast(medians(rows, "chars", "words")))  # a row each


def availability(papers: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """How many papers have a file."""
    found = files.select(F.col(key), F.lit(1).alias("_f")).dropDuplicates([key])
    return papers.join(found, key, "left").agg(F.count("*").alias("papers"), F.count("_f").alias("available"), F.round(F.avg(F.coalesce(F.col("_f"), F.lit(0))), 6).alias("rate"))


def language_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """(code -> name) by a small dimension table, the code where it is unknown."""
    return df.join(F.broadcast(names), "language", "left").withColumn("language_name", F.coalesce("name", "language")).drop("name")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """(bin, n): the series a plot would show."""
    return df.where(F.col(column).between(low, high)).groupBy(F.least(F.floor((F.col(column) - low) * bins / (high - low)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order`` (a partial maximum, no window)."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.trim(F.col(key).cast("string")) != "").groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def introspect(df: DataFrame, key: str) -> dict:
    """Columns and types, and the column of identifiers as a DataFrame."""
    return {"columns": df.columns, "types": dict(df.dtypes), "identifiers": df.select(F.col(key).cast("string").alias(key))}


def compare_samples(frame: DataFrame, sample: DataFrame, authors: str, categories: str, key: str) -> DataFrame:
    """The frame's and the sample's summary, a row each."""

    def row(df, name):
        return df.agg(F.lit(name).alias("set"), F.count_distinct(key).alias("papers"), F.round(F.avg(F.size(authors)), 6).alias("authors_per_paper"), F.round(F.avg(F.size(categories)), 6).alias("categories_per_paper"))

    return row(frame, "frame").unionByName(row(sample, "sample"))


def flattened(df: DataFrame) -> DataFrame:
    """All columns as text, names trimmed: null as nothing, lists of plain values by semicolons, other nested values as JSON."""

    def text(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType | T.MapType | T.StructType):
            c = F.when(F.exists(c, lambda x: x.isNull()), F.to_json(c)).otherwise(F.array_join(c.cast("array<string>"), ";"))
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name.strip())

    return df.select(*map(text, df.schema.fields))
