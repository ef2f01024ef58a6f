"""Exact quantiles of all groups at once, by grouped radix selection.

Values are counted by buckets (first sign and power of two, then equal parts of a bucket's own range), and only
buckets that hold a wanted rank are looked at again, until they hold one value or few enough to sort.  No buffer holds a
group's values, and a group of any size is as many partial counts as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arglake.work import written

#: Parts of a bucket's range; values of a bucket that are sorted at the end rather than counted again.
PARTS, FEW = 4096, 4096


def _power(x: Column) -> Column:
    """A bucket that never falls as ``x`` rises: sign and power of two; NaN, which counts as the largest, has the last."""
    size = F.floor(F.log2(F.abs(x))) + 1100
    return F.when(F.isnan(x), F.lit(1 << 20)).when(x == 0, F.lit(0)).when(x == float("inf"), F.lit(1 << 19)).when(x == float("-inf"), F.lit(-(1 << 19))).when(x > 0, size).otherwise(-size).cast("long")


def _held(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, base, sub, first, n, lo, hi, rank): the buckets that hold a rank; ``first`` is the rank of a bucket's least value."""
    before = F.sum("n").over(Window.partitionBy("g", "base").orderBy("sub").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("first", F.col("base") + before - F.col("n"))
    return placed.join(ranks, "g").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g", "base", "sub").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def exact_quantiles(df: DataFrame, value, probabilities: list[float], *by: str, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(by..., n, q): count and linearly interpolated quantiles of the values of each group that are not null.

    Null is a group like others; groups without a value are missing (without ``by`` there is then no row).
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    group = F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by))) if by else F.struct(F.lit(0).alias("k0"))
    rows = written(df.select(group.alias("g"), x.alias("x")).where("x IS NOT NULL"), "quantile-values")
    rows = rows.select("g", F.lit(0).cast("long").alias("base"), _power(F.col("x")).alias("sub"), "x")
    counts = written(_counted(rows), "quantile-counts")
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"))
    places = F.array(*(F.lit(float(p)) * (F.col("size") - 1) for p in probabilities))
    sizes = sizes.withColumn("places", places)
    both = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(F.floor(p), F.ceil(p)))))
    ranks = sizes.select("g", F.explode(both).alias("rank"))
    found = []
    while True:
        held = written(_held(counts, ranks), "quantile-held")
        found.append(held.where("lo = hi OR n = 1").select("g", "rank", F.col("lo").alias("v")))
        wide = held.where("NOT (lo = hi OR n = 1)")
        keys = ["g", "base", "sub"]
        short = wide.where(F.col("n") <= few)
        values = rows.join(short.select(keys).distinct(), keys).groupBy(keys).agg(F.sort_array(F.collect_list("x")).alias("xs"))
        found.append(short.join(values, keys).select("g", "rank", F.col("xs")[(F.col("rank") - F.col("first")).cast("int")].alias("v")))
        wide = wide.where(F.col("n") > few)
        if wide.isEmpty():
            break
        ranks = wide.select("g", "rank")
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1)).cast("long")
        rows = rows.join(wide.select(*keys, "first", "lo", "hi").distinct(), keys).select("g", F.col("first").alias("base"), part.alias("sub"), "x")
        rows = written(rows, "quantile-rows")
        counts = written(_counted(rows), "quantile-counts")
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    at = values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    low, high = (lambda p: F.element_at("at", F.floor(p))), (lambda p: F.element_at("at", F.ceil(p)))
    between = lambda p: F.when(F.floor(p) == F.ceil(p), low(p)).otherwise((F.ceil(p) - p) * low(p) + (p - F.floor(p)) * high(p))
    return sizes.join(at, "g").select(*(F.col(f"g.k{i}").alias(b) for i, b in enumerate(by)), F.col("size").alias("n"), F.transform("places", between).alias("q"))


def medians(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the median of each column (``median_<c>``), null where it has no value; the columns are selected together."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")
    q = exact_quantiles(df.select(pairs).select("p.*"), "x", [0.5], "c")
    return q.agg(*(F.max(F.when(F.col("c") == c, F.col("q")[0])).alias(f"median_{c}") for c in columns))
