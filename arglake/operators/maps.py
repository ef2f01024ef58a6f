"""Argument maps: parsing, validation, conversion, lookups and traversal.

A map is a row (id, adus array<struct>, relations array<struct>); ``nodes`` and ``edges`` flatten it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arglake.session import arrow_function

ADU = "struct<id:string,type:string,text:string,quote:string,isImplicit:boolean,positions:array<struct<start:int,end:int>>>"
RELATION = "struct<id:string,src:string,tgt:string,type:string>"
MAP = f"struct<adus:array<{ADU}>,relations:array<{RELATION}>,error:string>"
ADU_TYPES = ("Major Claim", "Claim", "Unknown")
RELATION_TYPES = ("support", "attack", "unknown")


# --- parsing: tolerant, so Python behind one Arrow function ---------------------------------------


def _truth(x) -> bool:
    return x if isinstance(x, bool) else str(x).strip().lower() == "true"


def _adu(i: str, x: dict) -> dict | None:
    if not isinstance(x, dict) or not x.get("text"):
        return None
    kind = x.get("type") if x.get("type") in ADU_TYPES else "Claim"
    return {"id": str(i), "type": kind, "text": str(x["text"]), "quote": x.get("quote") or None, "isImplicit": _truth(x.get("isImplicit", False)), "positions": []}


def _relations(found, known: set | None) -> list[dict]:
    out = []
    for n, r in enumerate(found if isinstance(found, list) else []):
        if not isinstance(r, dict) or not all(r.get(k) for k in ("src", "tgt", "type")):
            continue
        src, tgt, kind = str(r["src"]), str(r["tgt"]), str(r["type"]).lower()
        if kind in RELATION_TYPES and (known is None or {src, tgt} <= known):
            out.append({"id": f"rel-{n + 1}", "src": src, "tgt": tgt, "type": kind})
    return out


def parse_structure(x) -> dict:
    """A map from decoded JSON; key case at the top does not matter, ADUs may be an object or a list."""
    if not isinstance(x, dict):
        raise ValueError("not an object")
    x = {k.lower(): v for k, v in x.items()}
    if "adus" not in x:
        raise ValueError("no ADUs")
    raw = x["adus"]
    pairs = list(raw.items()) if isinstance(raw, dict) else [(a.get("id") or f"adu-{n + 1}", a) for n, a in enumerate(raw) if isinstance(a, dict)]
    adus = [a for a in (_adu(i, v) for i, v in pairs) if a]
    return {"adus": adus, "relations": _relations(x.get("relations"), {a["id"] for a in adus}), "error": None}


_ENTRY = re.compile(r'"([^"\\]+)"\s*:\s*\{([^{}]*)\}')
_OBJECT = re.compile(r"\{([^{}]*)\}")
_FIELD = re.compile(r'"(\w+)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(true|false|null))')


def _fields(body: str) -> dict:
    out = {}
    for k, quoted, bare in _FIELD.findall(body):
        out[k] = {"true": True, "false": False, "null": None}[bare] if bare else quoted.encode().decode("unicode_escape", "ignore") if "\\u" in quoted else quoted.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
    return out


def parse_broken(text: str) -> dict:
    """What can be read of a map that is not JSON: from the last "ADUs" on, objects one by one; edges may dangle."""
    low = text.lower()
    at = low.rfind('"adus"')
    if at < 0:
        raise ValueError("no ADUs")
    cut = low.find('"relations"', at)
    head, tail = (text[at:], "") if cut < 0 else (text[at:cut], text[cut:])
    adus = []
    for i, body in _ENTRY.findall(head):
        f = _fields(body)
        kind = str(f.get("type", "Claim"))
        folded = kind.replace(" ", "").lower()
        if folded in ("string", "boolean"):  # an echo of the schema
            continue
        f["type"] = "Major Claim" if folded == "majorclaim" else "Claim"
        if a := _adu(i, f):
            adus.append(a)
    found = [f for f in map(_fields, _OBJECT.findall(tail)) if "text" not in f]
    if not adus:
        raise ValueError("no ADU can be read")
    return {"adus": adus, "relations": _relations(found, None), "error": None}


def parse_text(text: str | None) -> dict:
    """A map from a text: JSON, else what can be read of it; what fails has an error and no nodes."""
    try:
        try:
            return parse_structure(json.loads(text or ""))
        except ValueError:
            return parse_broken(text or "")
    except (ValueError, TypeError, AttributeError) as e:
        return {"adus": [], "relations": [], "error": str(e)[:200] or "cannot be parsed"}


def parse_response(text: str | None) -> dict:
    """A map from a model's answer: fenced JSON, any fence, the widest braces, else the whole; the first that parses."""
    text = text or ""
    tries = re.findall(r"```json\s*(.*?)```", text, re.S) + re.findall(r"```\s*(.*?)```", text, re.S) + re.findall(r"\{.*\}", text, re.S)
    for t in tries:
        try:
            return parse_structure(json.loads(t))
        except (ValueError, TypeError, AttributeError):
            continue
    return parse_text(text)


@arrow_function(MAP)
def parse_maps(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_text(t) for t in texts], columns=["adus", "relations", "error"])


@arrow_function(MAP)
def parse_responses(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_response(t) for t in texts], columns=["adus", "relations", "error"])


_JSON = "struct<ADUs:map<string,struct<type:string,text:string,quote:string,isImplicit:string>>,relations:array<struct<src:string,tgt:string,type:string>>,_corrupt_record:string>"


def parse_strict(df: DataFrame, id_column: str, json_column: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of well-formed maps, JVM-side only; edges with unknown ends are dropped."""
    # No filter comes before the explosions, as it would parse each text once more for each condition.
    parsed = df.select(F.col(id_column).alias("map_id"), F.from_json(json_column, _JSON, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    formed = lambda c: F.when(F.col("m._corrupt_record").isNull(), F.col(c))
    nodes = parsed.select("map_id", F.posexplode_outer(formed("m.ADUs")).alias("pos", "id", "x")).where("x.text is not null")
    kind = F.when(F.col("x.type").isin(*ADU_TYPES), F.col("x.type")).otherwise("Claim")
    nodes = nodes.select("map_id", "pos", "id", kind.alias("type"), F.col("x.text").alias("text"), F.col("x.quote").alias("quote"), F.coalesce(F.lower("x.isImplicit") == "true", F.lit(False)).alias("isImplicit"))
    ids = F.map_keys("m.ADUs")
    edges = parsed.select("map_id", ids.alias("ids"), F.posexplode_outer(formed("m.relations")).alias("pos", "r"))
    edges = edges.where(F.array_contains("ids", F.col("r.src")) & F.array_contains("ids", F.col("r.tgt")) & F.lower("r.type").isin(*RELATION_TYPES))
    return nodes, edges.select("map_id", F.concat(F.lit("rel-"), (F.col("pos") + 1).cast("string")).alias("id"), F.col("r.src").alias("src"), F.col("r.tgt").alias("tgt"), F.lower("r.type").alias("type"))


def valid(json_column: str) -> Column:
    """Whether a text has the map schema: ADUs with known types and texts, relations support or attack between texts."""
    m = F.from_json(json_column, _JSON, {"columnNameOfCorruptRecord": "_corrupt_record"})
    adus = F.forall(F.map_values(m["ADUs"]), lambda a: F.coalesce(a["type"].isin("Major Claim", "Claim") & a["text"].isNotNull(), F.lit(False)))
    relations = F.forall(m["relations"], lambda r: F.coalesce(r["src"].isNotNull() & r["tgt"].isNotNull() & r["type"].isin("support", "attack"), F.lit(False)))
    return F.coalesce(m["_corrupt_record"].isNull() & m["ADUs"].isNotNull() & m["relations"].isNotNull() & adus & relations, F.lit(False))


def last_json(c) -> Column:
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def to_json_map(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(map_id, json): the schema-shaped text of each map, absent fields left out.

    Without ``edges``, a node's own relation is in its columns tgt and relation (null: it has none), and one grouping gathers both.
    """
    adus = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", F.struct("type", "text", "quote", "isImplicit").alias("x")))), lambda n: F.struct(n.id, n.x))).alias("ADUs")
    relations = lambda r: F.array_sort(F.collect_list(r)).alias("relations")
    if edges is None:
        own = F.when(F.col("tgt").isNotNull(), F.struct(F.col("id").alias("src"), "tgt", F.col("relation").alias("type")))
        found = nodes.groupBy("map_id").agg(adus, relations(own))
    else:
        found = nodes.groupBy("map_id").agg(adus).join(edges.groupBy("map_id").agg(relations(F.struct("src", "tgt", "type"))), "map_id", "left")
    return found.select("map_id", F.to_json(F.struct("ADUs", F.coalesce("relations", F.array()).alias("relations"))).alias("json"))


# --- labels of classifiers ------------------------------------------------------------------------

# Names of node and relation types.
NODE_NAMES = {"majorclaim": "Major Claim", "major_claim": "Major Claim", "major-claim": "Major Claim", "major claim": "Major Claim", "claim": "Claim", "premise": "Claim", "own_claim": "Claim", "background_claim": "Claim", "data": "Claim"}
RELATION_NAMES = {"support": "support", "supports": "support", "attack": "attack", "attacks": "attack", "contradicts": "attack"}
INFERENCE_NAMES = {"inference": "support", "conflict": "attack", "rephrase": "support"}
NEGATIVE_RELATIONS = ("no-relation", "none", "no", "norel", "no-rel", "negative", "other", "o")
NEGATIVE_SPANS = ("NON-ARGUMENT", "NONE", "O", "NEGATIVE", "NO")
SPAN_LABELS = {"own_claim": "claim", "background_claim": "claim", "data": "premise", "contradicts": "attacks"}


def renamed(c, names: dict[str, str], other: str | None = None) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    found = F.create_map(*(x for p in names.items() for x in map(F.lit, p)))[F.lower(out)]
    return F.coalesce(found, out if other is None else F.lit(other))


def keep_spans(df: DataFrame, positive: str | None = None) -> DataFrame:
    return df.where(F.col("label") == positive) if positive else df.where(~F.upper("label").isin(*NEGATIVE_SPANS))


def drop_non_relations(df: DataFrame) -> DataFrame:
    return df.where(~F.lower(F.regexp_replace("label", "_", "-")).isin(*NEGATIVE_RELATIONS))


def normalise_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """(id, adus): spans (start, end, label, score) to nodes whose id is their place, with the text that they cover."""
    node = lambda s, i: F.struct(i.cast("string").alias("id"), renamed(s["label"], NODE_NAMES, "Unknown").alias("type"), F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("text"), F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("positions"))
    return df.withColumn("adus", F.transform("spans", node)).withColumn("statistics", F.struct(F.size("spans").alias("total_adus")))


def resolve_ends(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations (map_id, pos, head, tail, label), whose ends are texts, with the ids of the first nodes that have these texts; else the raw end."""
    first = nodes.groupBy("map_id", F.trim("text").alias("t")).agg(F.min_by("id", "pos").alias("i"))
    out = relations
    for end, name in (("head", "src"), ("tail", "tgt")):
        out = out.join(first.select(F.col("map_id").alias("_m"), F.col("t").alias("_t"), F.col("i").alias("_i")), (F.col("map_id") == F.col("_m")) & (F.trim(end) == F.col("_t")), "left")
        out = out.withColumn(name, F.coalesce("_i", F.col(end), F.concat(F.lit("node-"), F.col("pos").cast("string")))).drop("_m", "_t", "_i")
    return out.withColumn("type", renamed("label", RELATION_NAMES, "unknown"))


def from_components(df: DataFrame) -> DataFrame:
    """(map_id, adus, relations) of ACC/ARI/ARC rows: ids a1, a2, ...; typed relations are preferred to bare ones."""
    adus = F.transform("ACC", lambda s, i: F.struct(F.concat(F.lit("a"), (i + 1).cast("string")).alias("id"), F.lit("Claim").alias("type"), s["span"].alias("text")))
    end = lambda x: F.concat(F.lit("a"), (x + 1).cast("string"))
    typed = F.transform("ARC", lambda r: F.struct(end(r["head"]).alias("src"), end(r["tail"]).alias("tgt"), renamed(r["type"], RELATION_NAMES, "unknown").alias("type")))
    bare = F.transform("ARI", lambda r: F.struct(end(r["head"]).alias("src"), end(r["tail"]).alias("tgt"), F.lit("unknown").alias("type")))
    return df.select("map_id", adus.alias("adus"), F.when(F.size("ARC") > 0, typed).otherwise(bare).alias("relations"))


# --- argdown --------------------------------------------------------------------------------------

ARGDOWN = "struct<statements:map<string,struct<members:array<struct<text:string,isReference:boolean>>,isUsedAsTopLevelStatement:boolean,data:struct<quote:string,isImplicit:boolean>>>,relations:array<struct<from:string,to:string,relationType:string>>>"


def from_argdown(df: DataFrame, id_column: str, json_column: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of argdown JSON: canonical texts, roots as major claims, edges between known nodes."""
    parsed = df.select(F.col(id_column).alias("map_id"), F.from_json(json_column, ARGDOWN).alias("a"))
    s = parsed.select("map_id", F.posexplode("a.statements").alias("pos", "id", "x"))
    written = F.filter("x.members", lambda m: F.coalesce(m["text"], F.lit("")) != "")
    own = F.filter(written, lambda m: ~F.coalesce(m["isReference"], F.lit(False)))
    text = F.regexp_replace(F.coalesce(F.get(own, 0)["text"], F.get(written, 0)["text"]), "^Main Thesis: ", "")
    r = parsed.select("map_id", F.posexplode("a.relations").alias("pos", "r")).select("map_id", "pos", F.col("r.from").alias("src"), F.col("r.to").alias("tgt"), F.lower("r.relationType").alias("kind"))
    edges = r.select("map_id", "pos", "src", "tgt", F.when(F.col("kind").rlike("attack|contra|undercut"), "attack").otherwise("support").alias("type"))
    supporting = edges.where("type = 'support'").select("map_id", F.col("src").alias("id")).distinct().withColumn("_s", F.lit(True))
    nodes = s.select("map_id", "pos", "id", text.alias("text"), F.col("x.data.quote").alias("quote"), F.coalesce("x.data.isImplicit", F.lit(False)).alias("isImplicit"), F.coalesce("x.isUsedAsTopLevelStatement", F.lit(False)).alias("top")).where("text is not null")
    nodes = nodes.join(supporting, ["map_id", "id"], "left").withColumn("type", F.when(F.col("top") & F.col("_s").isNull(), "Major Claim").otherwise("Claim")).drop("top", "_s")
    return nodes, with_known_ends(edges, nodes)


def standard_argdown(lines: DataFrame) -> DataFrame:
    """(doc, pos, line): custom syntax lines to the standard one: ``-`` becomes ``+`` with a line {isImplicit: true} unless metadata follows."""
    from pyspark.sql import Window

    item = r"^(\s*)([-+])\s+(.+)$"
    follow = F.lead("line").over(Window.partitionBy("doc").orderBy("pos"))
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    after = F.length(F.regexp_extract(F.coalesce("next", F.lit("")), r"^(\s*)", 1))
    metadata = F.coalesce(F.col("next").rlike(r"^\s*\{") & (after > indent), F.lit(False))
    implicit = F.col("line").rlike(item) & (F.regexp_extract("line", item, 2) == "-")
    first = F.when(implicit, F.regexp_replace("line", r"^(\s*)-(\s+)", "$1+$2")).otherwise(F.col("line"))
    second = F.concat(F.regexp_extract("line", r"^(\s*)", 1), F.lit("  {isImplicit: true}"))
    out = lines.withColumn("next", follow).select("doc", "pos", F.when(implicit & ~metadata, F.array(first, second)).otherwise(F.array(first)).alias("l"))
    return out.select("doc", "pos", F.posexplode("l").alias("sub", "line"))


def argdown_tree(text: str | None) -> dict:
    """A map from indented argdown text: each item relates to the nearest one with less indentation."""
    nodes, edges, stack = [], [], []
    for line in (text or "").splitlines():
        stripped = line.strip()
        if stripped.startswith("{") and nodes:
            nodes[-1]["isImplicit"] = "isImplicit: true" in stripped
            continue
        m = re.match(r"^(\s*)([-+])?\s*(?:\[([^\]]+)\]:?)?\s*(.*)$", line)
        if not stripped or not m:
            continue
        depth, sign, title, body = len(m[1]), m[2], m[3], m[4]
        i = f"a{len(nodes) + 1}"
        while stack and stack[-1][0] >= depth:
            stack.pop()
        nodes.append({"id": i, "type": "Claim" if stack else "Major Claim", "text": body or title or "", "quote": None, "isImplicit": False, "positions": []})
        if stack and sign:
            edges.append({"id": f"rel-{len(edges) + 1}", "src": i, "tgt": stack[-1][1], "type": "support" if sign == "+" else "attack"})
        stack.append((depth, i))
    return {"adus": nodes, "relations": edges, "error": None if nodes else "empty"}


@arrow_function(MAP)
def parse_argdown(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([argdown_tree(t) for t in texts], columns=["adus", "relations", "error"])


# --- graphs ---------------------------------------------------------------------------------------


def nodes_of(maps: DataFrame) -> DataFrame:
    return maps.select(F.col("id").alias("map_id"), F.posexplode("adus").alias("pos", "a")).select("map_id", "pos", "a.*")


def edges_of(maps: DataFrame) -> DataFrame:
    return maps.select(F.col("id").alias("map_id"), F.posexplode("relations").alias("pos", "r")).select("map_id", "pos", "r.*")


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("map_id", F.col("id").alias("_i"))
    for end in ("src", "tgt"):
        edges = edges.alias("e").join(ids.alias("n"), (F.col("e.map_id") == F.col("n.map_id")) & (F.col(f"e.{end}") == F.col("n._i")), "left_semi")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("map_id", F.col("id").alias("_i"), F.lit(1).alias("_k")).distinct()
    for end in ("src", "tgt"):
        edges = edges.join(ids.withColumnsRenamed({"_i": end, "_k": f"_{end}"}), ["map_id", end], "left")
    return edges.where("_src is null or _tgt is null").drop("_src", "_tgt")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("map_id").agg(F.count("*").alias("adus"), F.sum((F.col("type") == "Major Claim").cast("long")).alias("major_claims"), F.sum((F.col("type") == "Claim").cast("long")).alias("claims"))
    e = edges.groupBy("map_id").agg(F.count("*").alias("relations"), F.sum((F.col("type") == "support").cast("long")).alias("support"), F.sum((F.col("type") == "attack").cast("long")).alias("attack"))
    return n.join(e, "map_id", "left").na.fill(0)


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("map_id", "type").agg(F.count("*").alias("n"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that support nothing."""
    sources = edges.where("type = 'support'").select("map_id", F.col("src").alias("id"))
    return nodes.join(sources, ["map_id", "id"], "left_anti")


def neighbours(nodes: DataFrame, edges: DataFrame, kind: str = "support") -> DataFrame:
    """(map_id, id, neighbour, text): for each node those that support (or attack) it."""
    e = edges.where(F.col("type") == kind).select("map_id", F.col("tgt").alias("id"), F.col("src").alias("neighbour"))
    return e.join(nodes.select("map_id", F.col("id").alias("neighbour"), "text"), ["map_id", "neighbour"]).select("map_id", "id", "neighbour", "text")


def edges_at(edges: DataFrame, node: str, as_source: bool = True) -> DataFrame:
    return edges.where(F.col("src" if as_source else "tgt") == node)


def chains(edges: DataFrame, most_nodes: int = 5, least_nodes: int = 3) -> DataFrame:
    """(map_id, path): simple support paths of ``least_nodes`` to ``most_nodes`` nodes; each is one row, prefixes included."""
    e = edges.where("type = 'support' and src <> tgt").select("map_id", F.col("src").alias("a"), F.col("tgt").alias("b")).distinct()
    level = e.select("map_id", F.array("a", "b").alias("path"), F.col("b").alias("end"))
    out = level.where("false") if least_nodes > 2 else level
    for size in range(3, most_nodes + 1):
        level = level.join(e, (level["map_id"] == e["map_id"]) & (F.col("end") == F.col("a")) & ~F.array_contains("path", F.col("b"))).select(level["map_id"], F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("end"))
        if size >= least_nodes:
            out = out.unionByName(level)
    return out.select("map_id", "path")


def major_node(nodes: DataFrame) -> DataFrame:
    """One node a map: the longest among those whose type starts with 'claim', the first of equals; else the first node."""
    claim = F.lower("type").startswith("claim")
    rank = F.struct(claim.cast("int"), F.when(claim, F.length("text")).otherwise(0), -F.col("pos"))
    rest = [c for c in nodes.columns if c != "map_id"]
    return nodes.groupBy("map_id").agg(F.max_by(F.struct(*rest), rank).alias("m")).select("map_id", "m.*")


def distance_buckets(relations: DataFrame) -> DataFrame:
    """(bucket, n, percent) of the distance of two spans: under 200, under 1000, more."""
    d = F.abs(F.col("head_start") - F.col("tail_start"))
    counts = relations.groupBy(F.when(d < 200, "near").when(d < 1000, "middle").otherwise("far").alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("bucket", "n", F.round(100 * F.col("n") / F.col("t"), 6).alias("percent"))


def span_pairs(spans: DataFrame, key: str) -> DataFrame:
    """Ordered pairs of different spans of one document (the head's and the tail's ``pos``)."""
    a, b = spans.select(key, F.col("pos").alias("head")), spans.select(F.col(key).alias("_k"), F.col("pos").alias("tail"))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("head") != F.col("tail"))).drop("_k")


def quotes_in_source(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose text is in their source (map_id, source), and the edges between them."""
    from arglake.functions.text import in_source

    kept = nodes.join(sources, "map_id").where(in_source("text", "source")).drop("source")
    return kept, with_known_ends(edges, kept)
