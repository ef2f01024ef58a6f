"""Evaluation of generated outputs against gold maps: from rows or folders, one result an output and a summary.

Outputs are (id, text, prompt_info struct<strategy, shot_type, ...>), as ``readers.generations`` gives them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arglake.operators import maps, metrics
from arglake.sources import discovery, readers
from arglake.work import written

#: Scores of an evaluated output.
SCORES = ["precision", "recall", "f1", "support_f1", "attack_f1", "macro_f1", "adu_rmse", "rel_rmse", "combined_rmse", "scaled_rmse", "ged", "similarity", "combined_score"]


def _parsed(once: DataFrame, saved: str | None) -> DataFrame:
    """``once`` with its parsed map ``m``; with ``saved``, a Parquet folder, maps that are there are reused and new ones added to it."""
    if saved is None:
        return once.withColumn("m", maps.parse_maps("text"))
    spark = once.sparkSession
    try:
        known = spark.read.parquet(saved)
    except AnalysisException as missing:
        if not any(x in str(missing) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        known = None
    new = once.select("h", "text").dropDuplicates(["h"])
    if known is not None:
        new = new.join(known.select("h"), "h", "left_anti")
    new.select("h", maps.parse_maps("text").alias("m")).write.mode("append").parquet(saved)
    return once.join(spark.read.parquet(saved).dropDuplicates(["h"]), "h")


def evaluate_outputs(outputs: DataFrame, gold_nodes: DataFrame, gold_edges: DataFrame, threshold: float = metrics.THRESHOLD, saved_maps: str | None = None) -> DataFrame:
    """(output, paper_id, strategy, shot_type, parse_success, parse_error, <scores>): a row for each output, repeated ones too.

    ``gold_nodes`` and ``gold_edges`` have the paper in ``map_id``.  An output that cannot be parsed, or whose paper has
    no gold map, has no scores; a missing id, strategy or shot type is 'unknown'.  Parsed maps are kept in the folder
    ``saved_maps``, and those of outputs that were parsed before are taken from there.
    """
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    name = F.xxhash64("id", "text", F.to_json("prompt_info"))
    rows = outputs.select(name.alias("h"), known(F.col("id")).alias("paper_id"), known(F.col("prompt_info.strategy")).alias("strategy"), known(F.col("prompt_info.shot_type")).alias("shot_type"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal outputs are parsed and scored once; every one of them has its row in the result.
    once = rows.groupBy("h", "paper_id", "strategy", "shot_type", "text").agg(F.count("*").cast("int").alias("times"))
    parsed = _parsed(once, saved_maps).select("h", "paper_id", "strategy", "shot_type", "times", "m.*").withColumn("id", F.col("h").cast("string"))
    parsed = written(parsed, "parsed-maps")
    node = lambda x, i: F.struct(i.cast("long").alias("pos"), x["id"].alias("id"), x["text"].alias("text"), x["quote"].alias("quote"))
    edge = lambda x, i: F.struct(i.cast("long").alias("pos"), x["src"].alias("src"), x["tgt"].alias("tgt"), x["type"].alias("type"))
    good = parsed.where("error is null").select(F.col("id"), "paper_id", F.transform("adus", node).alias("pred_nodes"), F.transform("relations", edge).alias("pred_edges"))
    gold = metrics.sides("paper_id", gold=(gold_nodes, gold_edges))
    scores = metrics.scored(good.join(gold, "paper_id").withColumnRenamed("id", "map_id"), threshold)
    keep = [c for c in SCORES if c in scores.columns]
    scores = scores.select(F.col("map_id").alias("id"), *keep)
    out = parsed.select("id", "paper_id", "strategy", "shot_type", "times", F.col("error").isNull().alias("parse_success"), F.col("error").alias("parse_error")).join(scores, "id", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("output", F.concat_ws("-", "id", "copy"))
    return out.select("output", "paper_id", "strategy", "shot_type", "parse_success", "parse_error", *keep)


def summary(results: DataFrame) -> DataFrame:
    """(strategy, shot_type, n, avg_<score>, std_<score>) of the parsed outputs: by strategy, by shot type, and over all (both null)."""
    return metrics.breakdown(results.where("parse_success"), [c for c in SCORES if c in results.columns])


def totals(results: DataFrame) -> DataFrame:
    """(total_papers, successful_parses, failed_parses, parse_success_rate); zeros where there are no outputs."""
    good = F.coalesce(F.sum(F.col("parse_success").cast("long")), F.lit(0))
    n = F.count("*")
    return results.agg(n.alias("total_papers"), good.alias("successful_parses"), (n - good).alias("failed_parses"), F.when(n > 0, good / n).otherwise(0.0).alias("parse_success_rate"))


def _breakdown(summary_rows: DataFrame, by: str, other: str) -> Column:
    scores = [c for c in summary_rows.columns if c.startswith(("avg_", "std_"))]
    entry = F.struct(F.col(by).alias("key"), F.struct("n", *scores).alias("value"))
    return F.map_from_entries(F.filter(F.collect_list(F.when(F.col(by).isNotNull() & F.col(other).isNull(), entry)), lambda x: x.isNotNull()))


def report(results: DataFrame) -> DataFrame:
    """The report's one row: counts and rate of ``totals``, ``aggregate`` scores, and maps of scores by strategy and by shot type."""
    rows = summary(results)
    scores = [c for c in rows.columns if c.startswith(("avg_", "std_"))]
    whole = F.max(F.when(F.col("strategy").isNull() & F.col("shot_type").isNull(), F.struct("n", *scores)))
    parts = rows.agg(whole.alias("aggregate"), _breakdown(rows, "strategy", "shot_type").alias("by_strategy"), _breakdown(rows, "shot_type", "strategy").alias("by_shot_type"))
    return totals(results).join(F.broadcast(parts))  # a row each


def write_report(results: DataFrame, path: str) -> None:
    """``results`` as JSON under ``path``: a row for each paper in ``papers``, then the report's one row in ``summary``, which a whole report has."""
    kept = written(results, "evaluation")
    kept.write.mode("overwrite").json(f"{path}/papers", ignoreNullFields=False)
    report(kept).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def outputs_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The outputs of listed files, in any of their three layouts; a file that is listed twice is read twice.

    The listing, a row a file, is what goes to the driver.
    """
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], readers.OUTPUT)
    return readers.generations_of(spark.read.text(paths, wholetext=True))


def evaluate_folder(spark: SparkSession, folder: str, gold_nodes: DataFrame, gold_edges: DataFrame, threshold: float = metrics.THRESHOLD, once: bool = False) -> DataFrame:
    """``evaluate_outputs`` of a checkpoint folder's output files; an empty folder has no rows, and ``totals`` of it are zeros."""
    return evaluate_outputs(outputs_of(spark, discovery.output_files(spark, folder, once=once)), gold_nodes, gold_edges, threshold)


def printed(results: DataFrame) -> DataFrame:
    """(line): the totals and the averages of a summary, to be shown."""
    t = totals(results).select(F.format_string("papers %d, parsed %d, failed %d, success rate %.3f", "total_papers", "successful_parses", "failed_parses", "parse_success_rate").alias("line"), F.lit(0).alias("n"))
    s = summary(results)
    scores = [c for c in s.columns if c.startswith("avg_")]
    text = F.concat_ws(", ", *(F.format_string(f"{c[4:]} %.3f", F.col(c)) for c in scores))
    group = F.coalesce(F.concat(F.lit("strategy "), "strategy"), F.concat(F.lit("shot type "), "shot_type"), F.lit("all"))
    s = s.select(F.concat(group, F.lit(": "), text).alias("line"), F.lit(1).alias("n"))
    return t.unionByName(s).orderBy("n", "line").select("line")
