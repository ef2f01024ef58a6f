"""Sinks: CSV and JSON tables, prompts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order of the combined table's columns.
ORDER = ["identifier", "type", "language", "year", "authors", "title", "subjects", "category_names", "category_ids", "num_categories", "identifier-url"]


def csv(df: DataFrame, path: str, order: str | None = None, quote_all: bool = False) -> None:
    """CSV with a header, missing cells empty, arrays joined by ';', sorted by ``order``."""
    flat = df.select(*(F.array_join(F.col(f"`{c}`").cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes))
    flat = flat.orderBy(order) if order else flat
    flat.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("quoteAll", quote_all).option("escape", '"').csv(path)


def reordered(df: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """The listed columns first, the rest behind."""
    first = [c for c in order if c in df.columns]
    return df.select(*(f"`{c}`" for c in [*first, *(c for c in df.columns if c not in first)]))


def json(df: DataFrame, path: str, by: list[str] | None = None, append: bool = False) -> None:
    """JSON lines; a job's files appear all at once when it commits."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def texts(df: DataFrame, column: str, path: str, by: list[str] | None = None) -> None:
    rows = df.select(*(by or []), F.col(column).alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def markdown(df: DataFrame) -> DataFrame:
    """(line): a Markdown table of a small result."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "n long, line string")
    rows = df.select((F.monotonically_increasing_id() + 2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)), F.lit(" |")).alias("line"))
    return head.unionByName(rows).orderBy("n").select("line")


def report(parts: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """Small aggregates as one structure (at most 1000 rows of each)."""
    return {k: [r.asDict(True) for r in d.limit(1000).collect()] for k, d in parts.items()}
