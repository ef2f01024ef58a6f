"""Run logs, checkpoints and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arglake.operators.quantiles import exact_quantiles

LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)[,.]?\d*\s*\|\s*(\w+)\s*\|\s*([^|]*?)\s*\|\s*(.*)$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, level, logger, message, total, latency, produced) of ``ts | level | logger | message`` lines; other lines are dropped."""
    c = F.col(column)
    rows = lines.where(c.rlike(LINE)).select("*", *(F.regexp_extract(c, LINE, i).alias(n) for i, n in enumerate(("ts", "level", "logger", "message"), 1)))
    number = lambda p: F.regexp_extract("message", p, 1)
    return rows.withColumns({"ts": F.to_timestamp("ts"), "total": number(r"(?i)total[^0-9]*(\d+)").try_cast("long"), "latency": number(r"(?i)latency[^0-9]*([0-9]+(?:\.[0-9]+)?)").try_cast("double"), "produced": number(r"(?i)(?:produced|saved|checkpoint)[^0-9]*(\d+)").try_cast("long")})


def latency_stats(rows: DataFrame, latency: str, order: str, *by: str, last: int = 5) -> DataFrame:
    """n, mean, median, sample deviation and the last few latencies.

    The last few are a bounded partial top-k: an array of ``last`` of the newest in each slice, then of the slices.
    """
    x = F.col(latency)
    stats = rows.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"))
    from pyspark.sql import Window

    newest = rows.where(x.isNotNull()).withColumn("_s", F.pmod(F.xxhash64(order, latency), F.lit(64)))
    for keys in ([*by, "_s"], list(by)):
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(order), latency)
        newest = newest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    tail = newest.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), x.alias("x")))), lambda s: s.x).alias("last"))
    middle = exact_quantiles(rows, latency, [0.5], *by).select(*by, F.round(F.col("q")[0], 6).alias("median"))
    if not by:
        return stats.join(F.broadcast(middle), how="left").join(F.broadcast(tail), how="left").select("n", "mean", "median", "std", "last")
    for more in (middle, tail):
        named = more.select(*(F.col(b).alias(f"_{b}") for b in by), *(c for c in more.columns if c not in by))
        same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        stats = stats.join(named, same, "left").drop(*(f"_{b}" for b in by))
    return stats.select(*by, "n", "mean", "median", "std", "last")


def remaining_seconds(total, produced, mean_latency) -> Column:
    """max(0, total - produced) * mean latency; null where total or latency is missing."""
    return F.greatest(F.lit(0), total - F.coalesce(produced, F.lit(0))) * mean_latency


def started_with(lines: DataFrame, marker: str, newest: int, path: str = "path", number: str = "line_no", text: str = "value") -> DataFrame:
    """Lines of the ``newest`` files (by path) whose first line that is not blank contains ``marker``."""
    first = lines.where(F.trim(text) != "").groupBy(path).agg(F.min_by(text, number).alias("first"))
    files = first.where(F.contains("first", F.lit(marker))).orderBy(F.desc(path)).limit(newest).select(path)
    return lines.join(F.broadcast(files), path)  # ``newest`` rows


def file_time(path) -> Column:
    return F.to_timestamp(F.regexp_extract(path, r"(\d{8}_\d{6})", 1), "yyyyMMdd_HHmmss")


def checkpoints(outputs: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """(by, num_outputs, json): one envelope a group."""
    packed = outputs.groupBy(by).agg(F.count("*").alias("num_outputs"), F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("outputs"))
    return packed.select(by, "num_outputs", F.to_json(F.struct(F.col(by).alias("strategy"), "num_outputs", "outputs")).alias("json"))


def failures(log: DataFrame, key: str = "filename", when: str = "ts", error: str = "error", order: str | None = None) -> DataFrame:
    """(key, attempts, first_seen, last_seen, last_error) of an append-only table of failures; the last by ``order``, else by time."""
    return log.groupBy(key).agg(F.count("*").alias("attempts"), F.min(when).alias("first_seen"), F.max(when).alias("last_seen"), F.max_by(error, order or when).alias("last_error"))


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*(f"`{c}`" for c in rest)), order).alias("_r")).select(*(F.col(f"_r.`{c}`").alias(c) if c != key else F.col(key) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys.  With ``order``, the last row of a key that ``new`` repeats wins."""
    if order:
        new = last_of_each(new, key, order)
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
