"""Stratified, constrained sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arglake.functions.text import contains_any
from arglake.operators.catalog import TOPIC
from arglake.operators.quantiles import exact_quantiles
from arglake.work import parts_of, written


def tfidf(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, weight): smooth idf ln((1+n)/(1+df))+1, rows of unit length; terms are lower-case words of two letters or more."""
    terms = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"\b\w\w+\b"), F.lit(0))).alias("term"))
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.select(key).distinct().agg(F.count("*").alias("n_rows"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))  # one row
    weight = F.col("tf") * (F.log((1 + F.col("n_rows")) / (1 + F.col("df"))) + 1)
    raw = tf.join(idf.select("term", "df", "n_rows"), "term").select(key, "term", weight.alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def diversity(df: DataFrame, key: str, column: str, min_df: int = 2, most_terms: int = 1000, stop_words: list[str] | None = None) -> DataFrame:
    """(key, distance): cosine distance of each row's TF-IDF vector to the mean vector, over rows whose text is not null or blank.

    ``stop_words`` are left out: Spark's list of English ones unless given.  A row without a term left is at distance 1.
    """
    if stop_words is None:
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    df = df.where(F.trim(F.regexp_replace(column, r"\s+", " ")) != "")
    terms = df.select(key, F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"\b\w\w+\b"), F.lit(0))).alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(*stop_words))
    frequent = terms.groupBy("term").agg(F.count_distinct(key).alias("df"), F.count("*").alias("n")).where(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(most_terms)
    n = df.select(key).distinct().agg(F.count("*").alias("n_rows"))
    idf = frequent.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n_rows")) / (1 + F.col("df"))) + 1).alias("idf"), "n_rows")
    raw = terms.groupBy(key, "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"), "n_rows")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"), "n_rows")
    centre = unit.groupBy("term").agg((F.sum("w") / F.max("n_rows")).alias("c"))
    length = centre.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"))
    dots = unit.join(F.broadcast(centre), "term").groupBy(key).agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    out = df.select(key).distinct().join(dots, key, "left").join(F.broadcast(length))
    return out.select(key, (1 - F.coalesce(F.col("dot") / F.col("len"), F.lit(0.0))).alias("distance"))


def clusters(df: DataFrame, key: str, column: str, k: int = 94, seed: int = 42, features: int = 1 << 14) -> DataFrame:
    """(key, cluster): KMeans over hashed TF-IDF of a text column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    # a small file may hold many rows, whose vectors KMeans keeps: parts of a bounded number of them
    rows = df.select(key, F.coalesce(F.col(column), F.lit("")).alias("_t")).repartition(parts_of(df), key)
    steps = [RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+", minTokenLength=2), HashingTF(inputCol="_w", outputCol="_h", numFeatures=features), IDF(inputCol="_h", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_n"), KMeans(featuresCol="_n", predictionCol="cluster", k=k, seed=seed)]
    return Pipeline(stages=steps).fit(rows).transform(rows).select(key, "cluster")


def quartiles(df: DataFrame, group: str, value: str, name: str = "quartile") -> DataFrame:
    """``df`` with Q1..Q4 of ``value`` inside each group, by linearly interpolated edges, right-closed.

    Q1 where the value is null, the group has fewer than four values, or two edges are equal.
    """
    x = F.col(value).cast("double")
    cuts = exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], group)
    edges = cuts.select(F.col(group).alias("_g"), F.slice("q", 2, 3).alias("_q"), F.col("q")[0].alias("_low"), F.col("q")[4].alias("_high"), F.col("n").alias("_n"))
    out = df.join(edges, F.col(group).eqNullSafe(F.col("_g")), "left")
    q = F.col("_q")
    good = (F.col("_n") >= 4) & (F.col("_low") < q[0]) & (q[0] < q[1]) & (q[1] < q[2]) & (q[2] < F.col("_high"))
    label = F.when(~F.coalesce(good, F.lit(False)) | x.isNull() | (x <= q[0]), "Q1").when(x <= q[1], "Q2").when(x <= q[2], "Q3").otherwise("Q4")
    return out.select(*df.columns, label.alias(name))


def allocation(df: DataFrame, group: str, size: int) -> DataFrame:
    """(group, n, allocated): proportional shares rounded half to even, the residual to the largest group, none below 0."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    first = counts.join(F.broadcast(total)).withColumn("share", F.bround(F.col("n") * size / F.col("total")).cast("long"))
    residual = first.agg((F.lit(size) - F.sum("share")).alias("residual"), F.max(F.struct("n", F.struct(F.col(group)))).alias("top"))
    out = first.join(F.broadcast(residual))
    extra = F.when(F.col(group).eqNullSafe(F.col(f"top.col2.{group}")), F.col("residual")).otherwise(0)
    return out.select(group, "n", F.greatest(F.lit(0), F.col("share") + extra).cast("long").alias("allocated"))


def _used(df: DataFrame, columns: list[str]) -> Column:
    """The values of columns that hold one or several, each with its column's number; missing ones count for nothing."""
    kinds = dict(df.dtypes)

    def values(i: int, c: str) -> Column:
        many = F.coalesce(F.col(c), F.array()) if kinds[c].startswith("array") else F.array(c)
        return F.transform(F.filter(many, lambda v: v.isNotNull() & ~F.coalesce(v == float("nan"), F.lit(False)) if "double" in kinds[c] or "float" in kinds[c] else v.isNotNull()), lambda v: F.struct(F.lit(i).alias("c"), v.cast("string").alias("v")))

    return F.array_distinct(F.flatten(F.array(*(values(i, c) for i, c in enumerate(columns)))))


def constrained_draw(df: DataFrame, group: str, key: str, quotas: DataFrame, no_repeat: list[str], seed: int = 42) -> DataFrame:
    """Greedy draw in each group in hash order: up to the group's ``allocated`` rows, none of which repeats a value of the columns ``no_repeat``.

    The rows that a sequential draw takes, found in parallel rounds: a row is taken once none before it that is still
    undecided shares a value with it, and then decides all rows that do.  In a random order few rounds are needed.
    Rows after a group's last wanted one are dropped as soon as that is known.  No task holds a group or the rows of a value.
    """
    order = F.struct(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k"), F.monotonically_increasing_id().alias("i"))
    rows = df.withColumn("_n", F.lit(1)).join(quotas.select(F.col(group).alias("_q"), F.col("allocated").alias("_most")).where("allocated > 0"), F.col(group).eqNullSafe(F.col("_q")))
    rows = written(rows.drop("_q", "_n").withColumn("_o", order).withColumn("_v", _used(df, no_repeat)), "draw-rows")
    left = rows.select(F.struct(F.col(group).alias("g")).alias("g"), "_most", F.col("_o").alias("o"), F.col("_v").alias("vs"))
    taken = None
    while True:
        each = left.select("g", "o", F.explode("vs").alias("v"))
        first = each.groupBy("g", "v").agg(F.min("o").alias("o"))
        wins = first.groupBy("g", "o").agg(F.count("*").alias("wins"))
        new = left.join(wins, ["g", "o"], "left").where(F.coalesce("wins", F.lit(0)) == F.size("vs")).select("g", "_most", "o", "vs")
        new = written(new, "draw-taken")
        taken = new.drop("vs") if taken is None else taken.unionByName(new.drop("vs"))
        gone = each.join(new.select("g", F.explode("vs").alias("v")), ["g", "v"], "left_semi").select("g", "o").distinct()
        rank = F.row_number().over(Window.partitionBy("g").orderBy("o"))
        last = taken.withColumn("r", rank).where(F.col("r") == F.col("_most")).select("g", F.col("o").alias("last"))
        left = left.join(new.select("g", "o"), ["g", "o"], "left_anti").join(gone, ["g", "o"], "left_anti")
        left = left.join(last, "g", "left").where(F.col("last").isNull() | (F.col("o") < F.col("last"))).drop("last")
        left = written(left, "draw-left")
        if left.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("g").orderBy("o"))
    taken = taken.withColumn("r", rank).where(F.col("r") <= F.col("_most")).select(F.col("o").alias("_o"))
    return rows.join(taken, "_o", "left_semi").select(df.columns)


def sample_with_suggestions(df: DataFrame, group: str, key: str, size: int, no_repeat: list[str], seed: int = 42) -> DataFrame:
    """Allocation, draw and, where the draw falls short, suggestions: the rows with ``role`` 'sampled' or 'suggested'."""
    drawn = written(constrained_draw(df, group, key, allocation(df, group, size), no_repeat, seed), "draw-sample")
    short = size - drawn.count()
    out = drawn.withColumn("role", F.lit("sampled"))
    return out.unionByName(suggestions(df, drawn, short, no_repeat, key, seed + 1).withColumn("role", F.lit("suggested"))) if short > 0 else out


def suggestions(rest: DataFrame, taken: DataFrame, shortage: int, no_repeat: list[str], key: str, seed: int = 43) -> DataFrame:
    """Up to twice the ``shortage`` of rows of ``rest`` that repeat no value that ``taken`` has used, in hash order."""
    left = rest.join(taken.select(key), key, "left_anti")
    for c in no_repeat:
        used = taken.select(F.explode(c) if dict(taken.dtypes)[c].startswith("array") else F.col(c)).toDF("_u").where("_u is not null").distinct()
        if dict(left.dtypes)[c].startswith("array"):
            hit = left.select(key, F.explode(c).alias("_u")).join(used, "_u", "left_semi").select(key).distinct()
            left = left.join(hit, key, "left_anti")
        else:
            left = left.join(used, F.col(c) == F.col("_u"), "left_anti")
    return left.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(2 * shortage)


def fill_ratio(sample: DataFrame, frame: DataFrame, key: str, text: str, least: float = 0.5, stems: list[str] = TOPIC) -> DataFrame:
    """``sample`` with so many of its first rows off topic replaced by the frame's first rows on topic that the share of topic rows is at least ``least``."""
    on_topic = contains_any(F.coalesce(F.col(text), F.lit("")), stems)
    flagged = sample.withColumn("_t", on_topic)
    n, on = flagged.agg(F.count("*"), F.coalesce(F.sum(F.col("_t").cast("long")), F.lit(0))).first()
    need = max(0, -int(-least * n // 1) - on)
    if need == 0:
        return sample
    out = flagged.where("not _t").orderBy(key).limit(need).select(key)
    new = frame.where(on_topic).join(sample.select(key), key, "left_anti").orderBy(key).limit(need)
    return sample.join(out, key, "left_anti").unionByName(new.select(sample.columns))


def stratum(cluster, year, category):
    """cluster|year|category, with the texts that missing values become."""
    part = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    return F.concat_ws("|", part(cluster, "nan"), part(year, "nan"), part(category, "None"))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)

