"""Scores of predicted argument maps against gold ones.

Nodes are (map_id, pos, id, text) and edges (map_id, pos, src, tgt, type); a map's own columns only meet
those of the map with the same id.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arglake.functions.edit_distance import edit_distance
from arglake.functions.similarity import ratios, scores_of_lists
from arglake.functions.text import fuzzy_ratio, fuzzy_ratio_from, ratio_bound
from arglake.session import arrow_function

THRESHOLD = 0.7


def similarities(gold: DataFrame, pred: DataFrame, least: float | None = None) -> DataFrame:
    """(map_id, gold, gold_pos, pred, pred_pos, score) of the node pairs of each map.

    With ``least``, pairs that the lengths rule out are dropped, and those that counts of letters and bigrams rule out score 0
    without the exact ratio being taken.
    """
    g = gold.select("map_id", F.col("id").alias("gold"), F.col("pos").alias("gold_pos"), F.col("text").alias("_g"))
    p = pred.select("map_id", F.col("id").alias("pred"), F.col("pos").alias("pred_pos"), F.col("text").alias("_p"))
    pairs = g.join(p, "map_id")
    if least is not None:
        pairs = pairs.where(ratio_bound("_g", "_p") >= least)
    return pairs.select("map_id", "gold", "gold_pos", "pred", "pred_pos", (fuzzy_ratio("_g", "_p") if least is None else fuzzy_ratio_from(least)("_g", "_p")).alias("score"))


def best_matches(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(map_id, gold, gold_pos, pred): for each gold node the best predicted one (many to one), the first of equals."""
    good = scores.where(F.col("score") >= threshold)
    return good.groupBy("map_id", "gold", "gold_pos").agg(F.max_by("pred", F.struct("score", -F.col("pred_pos"))).alias("pred"))


def greedy_matches(pairs: list) -> int:
    """How many gold nodes, in order, find a predicted node that no earlier one has taken; the best score first, the first of equals."""
    used: set = set()
    matched, at = 0, None
    for p in sorted(pairs, key=lambda p: (p["gold_pos"], -p["score"], p["pred_pos"])):
        if p["gold_pos"] != at and p["pred"] not in used:
            used.add(p["pred"])
            matched, at = matched + 1, p["gold_pos"]
    return matched


@arrow_function("long")
def _greedy(pairs: pd.Series) -> pd.Series:
    return pairs.map(greedy_matches)


def node_f1(gold: DataFrame, pred: DataFrame, scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(map_id, matched, precision, recall, f1): greedy one-to-one matching in gold order."""
    good = scores.where(F.col("score") >= threshold).groupBy("map_id").agg(F.collect_list(F.struct("gold_pos", "pred", "pred_pos", "score")).alias("pairs"))
    matched = good.select("map_id", _greedy("pairs").alias("matched"))
    g, p = gold.groupBy("map_id").agg(F.count("*").alias("n_gold")), pred.groupBy("map_id").agg(F.count("*").alias("n_pred"))
    out = g.join(p, "map_id", "left").join(matched, "map_id", "left").na.fill(0)
    precision = F.when(F.col("n_pred") > 0, F.col("matched") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.col("n_gold") > 0, F.col("matched") / F.col("n_gold")).otherwise(0.0)
    f1 = F.when(F.col("matched") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select("map_id", "matched", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def relation_f1(gold_edges: DataFrame, pred_edges: DataFrame, matches: DataFrame) -> DataFrame:
    """(map_id, support_f1, attack_f1, macro_f1) over the gold edges whose ends both have a match (0 for a map without
    one); types other than support count as attack.

    Predicted edges are carried to gold ids by ``matches``; of several gold nodes with one match the last takes it.
    """
    back = matches.groupBy("map_id", "pred").agg(F.max_by("gold", "gold_pos").alias("gold"))
    src = back.select("map_id", F.col("pred").alias("src"), F.col("gold").alias("gsrc"))
    tgt = back.select("map_id", F.col("pred").alias("tgt"), F.col("gold").alias("gtgt"))
    moved = pred_edges.join(src, ["map_id", "src"]).join(tgt, ["map_id", "tgt"])
    moved = moved.groupBy("map_id", "gsrc", "gtgt").agg(F.min_by(F.col("type") == "support", "pos").alias("predicted"))
    moved = moved.withColumnsRenamed({"gsrc": "src", "gtgt": "tgt"})
    ends = matches.select("map_id", "gold").distinct()
    both = gold_edges.select("map_id", "src", "tgt", (F.col("type") == "support").alias("support")).join(moved, ["map_id", "src", "tgt"], "left")
    for end in ("src", "tgt"):
        both = both.join(ends.select("map_id", F.col("gold").alias(end), F.lit(True).alias(f"has_{end}")), ["map_id", end], "left")
    counted = F.col("has_src").isNotNull() & F.col("has_tgt").isNotNull()

    def f1(own: Column, hit: Column) -> Column:
        tp = F.sum((counted & own & hit).cast("long"))
        wrong = F.sum((counted & (own != hit)).cast("long"))
        return F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(0.0)

    is_support, says_support = F.col("support"), F.coalesce("predicted", F.lit(False))
    says_attack = F.coalesce(~F.col("predicted"), F.lit(False))
    out = both.groupBy("map_id").agg(f1(is_support, says_support).alias("support_f1"), f1(~is_support, says_attack).alias("attack_f1"))
    return out.withColumn("macro_f1", (F.col("support_f1") + F.col("attack_f1")) / 2)


def count_error(df: DataFrame, gold_adus="gold_adus", pred_adus="pred_adus", gold_rels="gold_rels", pred_rels="pred_rels") -> DataFrame:
    """Absolute count differences, their root mean square and that scaled to 0..1."""
    a, r = F.abs(F.col(gold_adus) - F.col(pred_adus)), F.abs(F.col(gold_rels) - F.col(pred_rels))
    both = F.sqrt((a * a + r * r) / 2)
    scaled = 1 - F.exp(-both / F.greatest(F.lit(1.0), (F.col(gold_adus) + F.col(gold_rels)) / 2))
    return df.withColumns({"adu_rmse": a.cast("double"), "rel_rmse": r.cast("double"), "combined_rmse": both, "scaled_rmse": scaled})


def combined(f1, macro, scaled, ged) -> Column:
    return (f1 + macro + (1 - scaled) + ged) / 4


def weighted_loss(rewards: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """1 - sum of weighted rewards; equal weights unless given, missing rewards count as 0."""
    weights = weights or dict.fromkeys(rewards, 1 / len(rewards))
    return 1 - sum((F.lit(weights.get(k, 0.0)) * F.coalesce(r, F.lit(0.0)) for k, r in rewards.items()), F.lit(0.0))


# --- graph edit distance --------------------------------------------------------------------------


def edge_kind(type_: str | None) -> str:
    """Lower case; an unknown or empty type is support."""
    kind = (type_ or "").strip().lower()
    return "support" if kind in ("", "unknown") else kind


@functools.lru_cache(1 << 16)
def _distance(n: int, m: int, gold: tuple, pred: tuple, like: bytes, bounds: int | None) -> tuple[int, int]:
    """``edit_distance`` of graphs of n and m nodes; many maps pose the same problem."""
    return edit_distance((range(n), gold), (range(m), pred), np.frombuffer(like, bool).reshape(n, m), bounds)


@functools.lru_cache(1 << 16)
def _edits(shape: str, like: bytes, bounds: int | None) -> tuple[float, float, float]:
    """(ged, ged_low, similarity) of a pair of maps from its shape and the likeness of its nodes; an end that is no node becomes one, which is like no other."""
    sides = json.loads(shape)
    sizes, graphs = [], []
    for ids, links in (sides[:2], sides[2:]):
        number = {x: i for i, x in enumerate(ids)}
        last = {(s, t): edge_kind(k) for s, t, k in links if s is not None and t is not None}
        ends = sorted({e for x in last for e in x} - set(number))
        number |= {e: len(ids) + i for i, e in enumerate(ends)}
        sizes.append(len(ids) + len(ends))
        graphs.append(tuple(sorted((number[s], number[t], k) for (s, t), k in last.items())))
    n, m = sizes
    same = np.zeros((n, m), bool)
    a, b = len(sides[0]), len(sides[2])
    same[:a, :b] = np.frombuffer(like, bool).reshape(a, b)
    low, high = _distance(n, m, *graphs, same.tobytes(), bounds)
    return float(high), float(low), 1 - min(1.0, high / max(1, n + m + len(graphs[0]) + len(graphs[1])))


@functools.lru_cache(1 << 16)
def _matched(shape: str, scores: bytes, threshold: float) -> tuple[int, float, float]:
    """(matched, support_f1, attack_f1) as of ``node_f1`` and ``relation_f1``, from a pair's shape and the scores of its nodes."""
    gold, gold_links, pred, pred_links = json.loads(shape)
    rows = np.frombuffer(scores).reshape(len(gold), len(pred)).tolist()
    pairs = [(i, s, j) for i, row in enumerate(rows) for j, s in enumerate(row) if s >= threshold]
    matched = greedy_matches([{"gold_pos": i, "score": s, "pred": pred[j], "pred_pos": j} for i, s, j in pairs])
    best: dict[int, tuple] = {}
    for i, s, j in pairs:
        best[i] = max(best.get(i, (s, -j)), (s, -j))
    ends = {gold[i] for i in best}
    back = {pred[-best[i][1]]: gold[i] for i in sorted(best)}
    moved: dict[tuple, bool | None] = {}
    for s, t, k in pred_links:
        if s in back and t in back:
            moved.setdefault((back[s], back[t]), None if k is None else k == "support")
    hits, wrong = [0, 0], [0, 0]  # of support, of attack
    for s, t, k in gold_links:
        if s in ends and t in ends and k is not None:
            said = moved.get((s, t))
            for i, own, hit in ((0, k == "support", said is True), (1, k != "support", said is False)):
                hits[i] += own and hit
                wrong[i] += own != hit
    f1 = [2 * h / (2 * h + w) if 2 * h + w else 0.0 for h, w in zip(hits, wrong)]
    return matched, f1[0], f1[1]


def sides(key: str = "map_id", **parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, <name>_nodes, <name>_edges of each named (nodes, edges)): a row for each map that has any, in the order of ``pos``.

    One grouping: frames that are parted by map alike stay where they are.
    """
    node, edge = "struct<pos:bigint,id:string,text:string,quote:string>", "struct<pos:bigint,src:string,tgt:string,type:string>"
    kinds = {f"{name}_{part}": kind for name in parts for part, kind in (("nodes", node), ("edges", edge))}
    every = None
    for name, (nodes, edges) in parts.items():
        quote = F.col("quote") if "quote" in nodes.columns else F.lit(None)
        own = {f"{name}_nodes": (nodes, F.struct("pos", "id", "text", quote)), f"{name}_edges": (edges, F.struct("pos", "src", "tgt", "type"))}
        for column, (df, value) in own.items():
            rows = df.select(F.col("map_id").alias(key), *((value if c == column else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
            every = rows if every is None else every.unionByName(rows)
    return every.groupBy(key).agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in kinds))


def _compared(both: DataFrame, threshold: float, bounds: int | None, match: bool) -> DataFrame:
    """``both``, a row for each pair of maps as ``sides`` gives them, to (map_id, [matched, support_f1, attack_f1,] ged, ged_low, similarity).

    Python gets the texts and, as one JSON text, the rest of a pair: its shape.  A batch's equal pairs of texts are compared
    once, and equal problems are solved once by a worker.
    """
    kind = dict(both.dtypes)["map_id"]
    part = lambda name: F.coalesce(name, F.array())
    ids = lambda name: F.transform(part(name), lambda x: x["id"])
    links = lambda name: F.transform(part(name), lambda x: F.array(x["src"], x["tgt"], x["type"]))
    texts = lambda name: F.transform(part(name), lambda x: x["text"])
    told = lambda name: F.transform(part(name), lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["quote"]))
    shape = F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(f(n)) for n, f in (("gold_nodes", ids), ("gold_edges", links), ("pred_nodes", ids), ("pred_edges", links)))), F.lit("]"))
    columns = ["map_id", shape.alias("shape"), told("gold_nodes").alias("g"), told("pred_nodes").alias("p")]
    if match:
        columns += [texts("gold_nodes").alias("a"), texts("pred_nodes").alias("b")]

    def work(batches):
        for batch in batches:
            shapes = batch.column(1).to_pylist()
            found = []
            like = scores_of_lists(batch.column(2), batch.column(3), threshold, strip=True)
            own = scores_of_lists(batch.column(4), batch.column(5), threshold) if match else iter(())
            for x in shapes:
                edits = _edits(x, (next(like) >= threshold).tobytes(), bounds)
                found.append((_matched(x, next(own).tobytes(), threshold) if match else ()) + edits)
            out = [pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["map_id", *names])

    names = (["matched", "support_f1", "attack_f1"] if match else []) + ["ged", "ged_low", "similarity"]
    types = ([pa.int64()] + [pa.float64()] * 2 if match else []) + [pa.float64()] * 3
    ddl = ", ".join(f"{n} {'long' if n == 'matched' else 'double'}" for n in names)
    return both.select(*columns).mapInArrow(work, f"map_id {kind}, {ddl}")


def edit_similarity(nodes: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, bounds: int | None = 2_000) -> DataFrame:
    """(map_id, ged, ged_low, similarity) from nodes and edges with a column ``side`` ('gold' or 'pred'); of parallel edges the last counts.

    The distance is between ``ged_low`` and ``ged``: equal unless the search took ``bounds`` of them.  Texts are stripped; a node without text has its quote (if ``nodes`` has that column); an end of an edge that is no node becomes one
    without text, which is like no other; unknown and empty types are support.
    """
    edges = edges.where("src is not null and tgt is not null")
    of = lambda side: (nodes.where(F.col("side") == side), edges.where(F.col("side") == side))
    return _compared(sides(gold=of("gold"), pred=of("pred")), threshold, bounds, match=False)


# --- aggregates -----------------------------------------------------------------------------------


def aggregate(df: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """avg_<m> and std_<m> (population) of each metric; a missing one counts as 0."""
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(x for m in metrics for x in (F.round(F.avg(value(m)), 6).alias(f"avg_{m}"), F.round(F.stddev_pop(value(m)), 6).alias(f"std_{m}"))))


def breakdown(df: DataFrame, metrics: list[str], strategy: str = "strategy", shot: str = "shot_type") -> DataFrame:
    """Aggregates by strategy, by shot type and over all, in one pass; a missing strategy is 'unknown'."""
    rows = df.withColumn(strategy, F.coalesce(F.col(strategy), F.lit("unknown"))).withColumn(shot, F.coalesce(F.col(shot), F.lit("unknown")))
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    aggregates = [F.count("*").alias("n"), *(x for m in metrics for x in (F.round(F.avg(value(m)), 6).alias(f"avg_{m}"), F.round(F.stddev_pop(value(m)), 6).alias(f"std_{m}")))]
    return rows.groupingSets([[F.col(strategy)], [F.col(shot)], []], F.col(strategy), F.col(shot)).agg(*aggregates)


def success_rate(df: DataFrame, column: str = "parse_success") -> DataFrame:
    return df.agg(F.round(F.avg(F.col(column).cast("int")), 6).alias("success_rate"))


def evaluate(gold_nodes: DataFrame, gold_edges: DataFrame, pred_nodes: DataFrame, pred_edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All scores of each gold map against the predicted map with its id; a map without a prediction has none."""
    return scored(sides(gold=(gold_nodes, gold_edges), pred=(pred_nodes, pred_edges)), threshold)


def scored(both: DataFrame, threshold: float = THRESHOLD, bounds: int | None = 2_000) -> DataFrame:
    """All scores of pairs of maps, a row each: (map_id, gold_nodes, gold_edges, pred_nodes, pred_edges) as ``sides`` gives them; pairs without gold nodes are left out."""
    size = lambda c: F.greatest(F.size(F.col(c)), F.lit(0)).cast("long")
    counted = {"gold_adus": "gold_nodes", "pred_adus": "pred_nodes", "gold_rels": "gold_edges", "pred_rels": "pred_edges"}
    both = both.where(F.col("map_id").isNotNull() & (F.size("gold_nodes") > 0))
    keyed = both.withColumn("map_id", F.struct("map_id", *(size(c).alias(n) for n, c in counted.items())))
    out = count_error(_compared(keyed, threshold, bounds, match=True).select("map_id.*", "matched", "support_f1", "attack_f1", "ged", "ged_low", "similarity"))
    precision = F.when(F.col("pred_adus") > 0, F.col("matched") / F.col("pred_adus")).otherwise(0.0)
    recall = F.col("matched") / F.col("gold_adus")
    out = out.withColumns({"precision": precision, "recall": recall, "macro_f1": (F.col("support_f1") + F.col("attack_f1")) / 2})
    out = out.withColumn("f1", F.when(F.col("matched") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    names = ["map_id", *counted, "adu_rmse", "rel_rmse", "combined_rmse", "scaled_rmse", "matched", "precision", "recall", "f1", "support_f1", "attack_f1", "macro_f1", "ged", "ged_low", "similarity"]
    return out.select(*names, combined(F.col("f1"), F.col("macro_f1"), F.col("scaled_rmse"), F.col("similarity")).alias("combined_score"))
