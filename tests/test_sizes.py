"""What a task holds does not grow with the table."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arglake import work
from arglake.operators import maps, retrieval, sampling, taxonomy
from arglake.plans import graph_queries


def test_passes_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["abcd", None, "ef", "g" * 20, "h"])], names=["id", "text"])
    assert list(retrieval._passes(batch, 6)) == [([0, 1, 2], ["abcd", "", "ef"]), ([3], ["g" * 20]), ([4], ["h"])]


def test_paths_of_many_children(spark, monkeypatch):
    rows = [(1, "r", None), (2, "a", 1), (5, "c", 6), (6, "d", 5), (7, "e", 5), (8, "s", 8), (9, "u", 99)] + [(100 + i, f"n{i}", 2) for i in range(500)]
    categories = spark.createDataFrame(rows, "category_id int, name string, primary_parent int")
    sizes = []
    monkeypatch.setattr(taxonomy, "written", lambda df, name: (sizes.append(df.count()), work.written(df, name))[1])
    got = {r["category_id"]: (r["path"], r["depth"]) for r in taxonomy.paths(categories).collect()}
    assert [got[i] for i in (1, 2, 5, 6, 7, 8, 9)] == [("r", 1), ("r > a", 2), ("d > c", 2), ("c > d", 2), ("d > c > e", 3), ("s", 1), ("u", 1)]
    assert len(got) == len(rows) and all(got[100 + i] == (f"r > a > n{i}", 3) for i in range(500))
    assert max(sizes) <= 5  # parents only


def test_clusters_are_found_in_parts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sampling, "parts_of", lambda df: seen.append(df) or 5)
    df = spark.createDataFrame([(i, ["red apple", "blue sky"][i % 2]) for i in range(40)], "k int, t string").coalesce(1)
    got = sampling.clusters(df, "k", "t", k=2)
    assert len({(r["k"] % 2, r["cluster"]) for r in got.collect()}) == 2 and len(seen) == 1
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_parts_grow_with_rows(spark):
    assert [work.parts_of(spark.range(n), 10) for n in (0, 10, 11, 95)] == [1, 1, 2, 10]


@pytest.mark.parametrize("name", ["map_parse_json", "map_parse_relations", "map_parse_response", "parse_success_rate", "map_validate"])
def test_json_maps_are_gathered_once_in_parts(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(graph_queries, "parts_of", lambda df: asked.append(df.count()) or 7)
    got = graph_queries.query.queries[name](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and plan.count("Relation [l_orderkey") == 1 and plan.count("Join ") == 1  # of part; nodes and relations are not joined
    assert plan.count("from_json(") <= {"map_parse_json": 2, "map_parse_relations": 3, "map_validate": 5}.get(name, 0)
    if got.columns[0] == "map_id":
        assert got.select(F.spark_partition_id()).distinct().count() == 7


def test_json_of_nodes_with_their_relations(spark):
    rows = [(1, 1, "1", "Major Claim", "a", None, None), (1, 2, "2", "Claim", "b", "1", "attack"), (1, 10, "10", "Claim", 'c"', "2", "support"), (2, 1, "1", "Claim", "d", None, None)]
    nodes = spark.createDataFrame(rows, "map_id long, pos int, id string, type string, text string, tgt string, relation string").withColumns({"quote": F.lit(None).cast("string"), "isImplicit": F.lit(False)})
    edges = nodes.where("tgt is not null").select("map_id", F.col("id").alias("src"), "tgt", F.col("relation").alias("type"))
    one, two = ({r["map_id"]: r["json"] for r in maps.to_json_map(*x).collect()} for x in ((nodes,), (nodes, edges)))
    assert one == two and len(one) == 2 and one[2].endswith('"relations":[]}')


def test_strict_parsing_of_broken_texts(spark):
    good = '{"ADUs": {"1": {"text": "x"}, "2": {"type": "Claim"}}, "relations": [{"src": "1", "tgt": "2", "type": "Support"}, {"src": "1", "tgt": "3", "type": "support"}]}'
    texts = [good, good[:-3], '{"relations": []}', '{"ADUs": {}}', '{"ADUs": {"1": {"text": "y"}}}', None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    nodes, edges = maps.parse_strict(df, "i", "j")
    assert [(r["map_id"], r["pos"], r["id"], r["text"]) for r in nodes.orderBy("map_id").collect()] == [(0, 0, "1", "x"), (4, 0, "1", "y")]
    assert [tuple(r) for r in edges.collect()] == [(0, "rel-1", "1", "2", "support")]
