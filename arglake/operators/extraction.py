"""Documents to argument maps: spans, optionally the major claim, relations, and the map, as one plan of plug-in models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.operators import inference, maps


def spans_to_nodes(found: DataFrame) -> DataFrame:
    """(map_id, pos, id, type, text, quote, isImplicit, positions) of classified spans (id, pos, start, end, text, label)."""
    rank = F.row_number().over(maps.Window.partitionBy("id").orderBy("pos")) - 1
    return found.select(F.col("id").alias("map_id"), "pos", rank.cast("string").alias("node"), maps.renamed("label", maps.NODE_NAMES, "Unknown").alias("type"), "text", F.lit(None).cast("string").alias("quote"), F.lit(False).alias("isImplicit"), F.array(F.struct("start", "end")).alias("positions")).withColumnRenamed("node", "id")


def with_major(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``major``: whether a node is its map's major one (the longest claim)."""
    chosen = maps.major_node(nodes).select("map_id", "id", F.lit(True).alias("major"))
    return nodes.join(chosen, ["map_id", "id"], "left").withColumn("major", F.coalesce("major", F.lit(False)))


def extract_maps(docs: DataFrame, spans: Callable, relations: Callable, id_column: str = "doc_id", text_column: str = "text", major: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each document: sentences that the span classifier takes for arguments, and the pairs of them that
    the relation classifier relates.  With ``major``, nodes carry the flag of ``with_major``.  A document without
    arguments has no rows; edges only join nodes of their map."""
    found = inference.spans(docs, spans, id_column, text_column)
    nodes = spans_to_nodes(found)
    if major:
        nodes = with_major(nodes)
    ids = nodes.select("map_id", "pos", F.col("id").alias("node"))
    related = inference.relations(found, relations)
    edges = related.select(F.col("id").alias("map_id"), "head", "tail", maps.renamed("label", maps.RELATION_NAMES, "unknown").alias("type"))
    for end, name in (("head", "src"), ("tail", "tgt")):
        edges = edges.join(ids.select("map_id", F.col("pos").alias(end), F.col("node").alias(name)), ["map_id", end])
    return nodes, edges.select("map_id", "src", "tgt", "type")


def results(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, adus, relations, statistics): a row a document, its numbers of nodes and of relations beside."""
    columns = [c for c in nodes.columns if c not in ("map_id", "pos")]
    a = nodes.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *columns))), lambda n: F.struct(*(n[c].alias(c) for c in columns))).alias("adus"))
    r = edges.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("src", "tgt", "type"))).alias("relations"))
    out = a.join(r, "map_id", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<struct<src:string,tgt:string,type:string>>")))
    return out.withColumn("statistics", F.struct(F.size("adus").alias("total_adus"), F.size("relations").alias("total_relations")))


def evaluate_generator(prompts: DataFrame, factory: Callable, gold_nodes: DataFrame, gold_edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Generated answers to ``prompts`` (map_id, system, user) as maps, scored against gold: the last JSON object of an answer counts."""
    from arglake.operators import metrics

    answers = inference.generate(prompts, factory).withColumn("m", maps.parse_maps(maps.last_json("text"))).select(F.col("map_id").alias("id"), "m.*")
    return metrics.evaluate(gold_nodes, gold_edges, maps.nodes_of(answers), maps.edges_of(answers), threshold)
