import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arglake.functions import edit_distance
from arglake.operators import catalog, inference, maps, metrics, prompts, retrieval, runlog, sampling, taxonomy


def test_taxonomy_cycles_and_depth(spark):
    rows = [(i, f"c{i}", [i - 1] if i > 1 else [], i - 1 if i > 1 else None) for i in range(1, 13)]
    rows += [(20, "x", [21], 21), (21, "y", [20], 20), (30, "lost", [99], 99), (31, "zero", [], None)]
    c = spark.createDataFrame(rows, "category_id int, name string, parent_ids array<int>, primary_parent int")
    got = {r.category_id: r.path for r in taxonomy.paths(c).collect()}
    assert got[3] == "c1 > c2 > c3" and got[12].count(">") == 9 and got[12].endswith("c12")
    assert got[20] == "y > x" and got[30] == "lost" and got[31] == "zero"
    names = {r.category_id: r.parent_names for r in taxonomy.parent_names(c).collect()}
    assert names[30] == ["[Unknown ID: 99]"] and names[31] == []


def test_record_ordinals_cross_files(spark):
    rows = [("f1", i, None, i) for i in range(5)] + [("f2", i, "deleted" if i == 0 else None, 10 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "file string, pos int, status string, datestamp int")
    got = catalog.record_filters(df, keep_deleted=False, first=4, last=6).collect()
    assert sorted((r.file, r.pos) for r in got) == [("f1", 3), ("f1", 4), ("f2", 1)]


def test_quartiles_fall_back(spark):
    rows = [("few", 1.0), ("few", 2.0), ("few", 3.0)] + [("equal", 5.0)] * 6 + [("ok", float(i)) for i in range(1, 9)] + [("ok", None)]
    got = sampling.quartiles(spark.createDataFrame(rows, "g string, y double"), "g", "y").collect()
    assert {r.quartile for r in got if r.g != "ok"} == {"Q1"}
    assert [r.quartile for r in sorted((r for r in got if r.g == "ok"), key=lambda r: (r.y is not None, r.y))] == ["Q1", "Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4"]


def test_allocation_and_draw(spark):
    r = random.Random(1)
    rows = [(i, f"g{r.randrange(4)}", [f"a{r.randrange(60)}", f"a{r.randrange(60)}"], r.randrange(1990, 2020), f"c{r.randrange(30)}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, authors array<string>, year int, category string")
    quotas = sampling.allocation(df, "g", 30)
    assert quotas.agg(F.sum("allocated")).first()[0] == 30
    got = sampling.constrained_draw(df, "g", "id", quotas, ["authors", "year", "category"]).collect()
    for g in {x.g for x in got}:
        own = [x for x in got if x.g == g]
        for values in ([a for x in own for a in set(x.authors)], [x.year for x in own], [x.category for x in own]):
            assert len(values) == len(set(values))
    more = sampling.suggestions(df, spark.createDataFrame(got, df.schema), 3, ["authors"], "id").collect()
    used = {a for x in got for a in x.authors}
    assert len(more) <= 6 and not any(used & set(x.authors) for x in more)


GOOD = {"ADUs": {"a1": {"type": "Major Claim", "text": "T", "isImplicit": "True"}, "a2": {"type": "Premise", "text": "U"}}, "relations": [{"src": "a2", "tgt": "a1", "type": "Support"}, {"src": "a9", "tgt": "a1", "type": "attack"}]}


def test_map_parsing():
    m = maps.parse_text(json.dumps(GOOD))
    assert [(a["id"], a["type"], a["isImplicit"]) for a in m["adus"]] == [("a1", "Major Claim", True), ("a2", "Claim", False)]
    assert m["relations"] == [{"id": "rel-1", "src": "a2", "tgt": "a1", "type": "support"}]
    listed = maps.parse_text(json.dumps({"adus": [{"text": "x"}, {"id": "k", "text": "y"}], "RELATIONS": []}))
    assert [a["id"] for a in listed["adus"]] == ["adu-1", "k"]
    broken = json.dumps(GOOD)[:-1] + ",}"
    b = maps.parse_text(broken)
    assert len(b["adus"]) == 2 and len(b["relations"]) == 2  # this path keeps dangling edges
    echo = '{"ADUs": {"id": {"type": "string", "text": "string"}}} then "ADUs": {"a": {"type": "claim", "text": "real"}} "relations": []'
    assert [a["text"] for a in maps.parse_text(echo)["adus"]] == ["real"]
    assert maps.parse_response(f"Sure!\n```json\n{json.dumps(GOOD)}\n```")["error"] is None
    for bad in (None, "", "no map", "[]", '{"x": 1}'):
        assert maps.parse_text(bad)["error"] and not maps.parse_text(bad)["adus"]


def test_map_columns(spark):
    df = spark.createDataFrame([("m", json.dumps(GOOD)), ("bad", "{"), ("none", None)], "id string, j string")
    nodes, edges = maps.parse_strict(df, "id", "j")
    assert nodes.count() == 2 and [(r.src, r.tgt, r.type) for r in edges.collect()] == [("a2", "a1", "support")]
    ok = {"ADUs": {"a": {"type": "Claim", "text": "t"}}, "relations": []}
    v = spark.createDataFrame([(json.dumps(ok),), (json.dumps(GOOD),), ("{",)], "j string").select(maps.valid("j")).collect()
    assert [r[0] for r in v] == [True, False, False]
    argdown = {"statements": {"s": {"members": [{"text": "Main Thesis: Root", "isReference": False}], "isUsedAsTopLevelStatement": True}, "t": {"members": [{"text": "Ref", "isReference": True}]}}, "relations": [{"from": "t", "to": "s", "relationType": "Support"}, {"from": "q", "to": "s", "relationType": "attack"}]}
    n, e = maps.from_argdown(spark.createDataFrame([("d", json.dumps(argdown))], "id string, j string"), "id", "j")
    assert {(r.id, r.text, r.type) for r in n.collect()} == {("s", "Root", "Major Claim"), ("t", "Ref", "Claim")}
    assert [(r.src, r.type) for r in e.collect()] == [("t", "support")]
    lines = spark.createDataFrame([("d", 0, "+ a"), ("d", 1, "  - b"), ("d", 2, "  - c"), ("d", 3, "    {isImplicit: true}")], "doc string, pos int, line string")
    assert [r.line for r in maps.standard_argdown(lines).orderBy("pos", "sub").collect()] == ["+ a", "  + b", "    {isImplicit: true}", "  + c", "    {isImplicit: true}"]
    tree = maps.argdown_tree("+ root\n  + pro\n  - con\n    + deep")
    assert [(x["src"], x["tgt"], x["type"]) for x in tree["relations"]] == [("a2", "a1", "support"), ("a3", "a1", "attack"), ("a4", "a3", "support")]


NODES = "map_id string, pos int, id string, text string"
EDGES = "map_id string, pos int, src string, tgt string, type string"


def test_equal_maps_score_one(spark):
    n = spark.createDataFrame([("m", 0, "a", "first claim"), ("m", 1, "b", "other premise"), ("m", 2, "c", "a third one")], NODES)
    e = spark.createDataFrame([("m", 0, "b", "a", "support"), ("m", 1, "c", "a", "attack")], EDGES)
    r = metrics.evaluate(n, e, n, e).first()
    assert (r.f1, r.support_f1, r.attack_f1, r.scaled_rmse, r.similarity, r.combined_score) == (1, 1, 1, 0, 1, 1)


def test_disjoint_and_greedy(spark):
    g = spark.createDataFrame([("m", 0, "a", "same text"), ("m", 1, "b", "same text")], NODES)
    p = spark.createDataFrame([("m", 0, "x", "same text"), ("m", 1, "y", "qqqqqqqq")], NODES)
    s = metrics.similarities(g, p, 0.7)
    r = metrics.node_f1(g, p, s).first()
    assert (r.matched, r.precision, r.recall) == (1, 0.5, 0.5)
    assert {x.pred for x in metrics.best_matches(s).collect()} == {"x"}  # many to one
    none = metrics.node_f1(g, p.where("false"), s.where("false")).first()
    assert none.f1 == 0


def test_relations_with_an_unmatched_end_do_not_count(spark):
    g = spark.createDataFrame([("m", 0, "a", "first claim"), ("m", 1, "b", "other premise"), ("m", 2, "c", "zzz qqq"), ("k", 0, "a", "lonely"), ("k", 1, "b", "alone")], NODES)
    e = spark.createDataFrame([("m", 0, "b", "a", "support"), ("m", 1, "c", "a", "attack"), ("k", 0, "b", "a", "support")], EDGES)
    p = g.where("id <> 'c' and map_id = 'm'")
    pe = e.where("src = 'b' and map_id = 'm'")
    got = {r.map_id: r for r in metrics.relation_f1(e, pe, metrics.best_matches(metrics.similarities(g, p, 0.7))).collect()}
    assert (got["m"].support_f1, got["m"].attack_f1, got["m"].macro_f1) == (1, 0, 0.5)
    assert (got["k"].support_f1, got["k"].attack_f1) == (0, 0)


def test_edit_similarity_of_unknown_types_dangling_ends_and_quotes(spark):
    sided = "map_id string, pos int, id string, text string, quote string, side string"
    rows = [("m", 0, "a", "first claim", None, "gold"), ("m", 1, "b", None, "quoted words", "gold"), ("m", 0, "x", "first claim", None, "pred"), ("m", 1, "y", "", "quoted words", "pred")]
    edges = lambda *x: spark.createDataFrame(x, EDGES + ", side string")
    n = spark.createDataFrame(rows, sided)
    same = metrics.edit_similarity(n, edges(("m", 0, "b", "a", "unknown", "gold"), ("m", 0, "y", "x", "Support", "pred"))).first()
    assert (same.ged, same.similarity) == (0, 1)
    loose = metrics.edit_similarity(n, edges(("m", 0, "b", "a", "support", "gold"), ("m", 0, "y", "x", None, "pred"), ("m", 1, "ghost", "x", "attack", "pred"))).first()
    assert loose.ged == 2 and abs(loose.similarity - (1 - 2 / 8)) < 1e-9  # a node and an edge more


def like(a, b):
    from arglake.functions.similarity import ratios

    return (ratios([x for x in a for _ in b], [y for _ in a for y in b]) >= 0.7).reshape(len(a), len(b))


def distance(gold, pred, **options):
    return edit_distance.edit_distance(gold, pred, like(gold[0], pred[0]), **options)


def test_edit_distance():
    a = (["one thing", "another thing", "third"], [(1, 0, "support"), (2, 0, "attack")])
    assert distance(a, a) == (0, 0)
    assert distance(a, (a[0], [(1, 0, "support"), (2, 0, "support")])) == (1, 1)
    assert distance(a, (a[0][:2], [(1, 0, "support")])) == (2, 2)
    assert distance(a, ([], [])) == (5, 5)
    assert distance(([], []), ([], [])) == (0, 0)
    big = ([f"{chr(97 + i)}" * 9 for i in range(12)], [(i, i - 1, "support") for i in range(1, 12)])
    assert distance(big, (big[0][::-1], [(11 - s, 11 - t, k) for s, t, k in big[1]][1:])) == (1, 1)


def brute_distance(gold, pred, same):
    (a, ea), (b, eb) = gold, pred
    ea, eb = {(s, t): k for s, t, k in ea}, {(s, t): k for s, t, k in eb}
    best = len(a) + len(b) + len(ea) + len(eb)
    for n in range(min(len(a), len(b)) + 1):
        for some in itertools.combinations(range(len(a)), n):
            for images in itertools.permutations(range(len(b)), n):
                of = dict(zip(some, images))
                moved = {(of[s], of[t]): k for (s, t), k in ea.items() if s in of and t in of}
                cost = len(a) + len(b) - 2 * n + sum(not same[i][j] for i, j in of.items())
                cost += len(ea) - len(moved) + sum(eb.get(p) != k for p, k in moved.items()) + len(eb.keys() - moved.keys())
                best = min(best, cost)
    return best


def test_edit_distance_by_brute_force():
    r = random.Random(3)

    def graph(n):
        return list(range(n)), [(s, t, r.choice("sa")) for s in range(n) for t in range(n) if r.random() < r.choice((0.15, 0.4))]

    for k in range(80):
        n, m = (6, 6) if k % 40 == 0 else (r.randint(0, 5), r.randint(0, 5))
        a, b = graph(n), graph(m)
        same = np.array([[r.random() < 0.3 for _ in range(m)] for _ in range(n)]).reshape(n, m)
        true = brute_distance(a, b, same)
        assert edit_distance.edit_distance(a, b, same, None) == (true, true)
        low, high = edit_distance.edit_distance(a, b, same, 3)
        assert low <= true <= high


def test_assignment():
    r = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        cost = r.random((n, n))
        total, columns = edit_distance.assignment(cost)
        assert sorted(columns) == list(range(n)) and abs(total - min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n)))) < 1e-9


def test_evaluation_falls_back_on_quotes(spark):
    quoted = NODES + ", quote string"
    g = spark.createDataFrame([("m", 0, "a", None, " a quoted claim "), ("m", 1, "b", " premise ", None)], quoted)
    p = spark.createDataFrame([("m", 0, "x", "", "a quoted claim"), ("m", 1, "y", "premise", None)], quoted)
    e, f = spark.createDataFrame([("m", 0, "b", "a", "support")], EDGES), spark.createDataFrame([("m", 0, "y", "x", "support")], EDGES)
    assert metrics.evaluate(g, e, p, f).first().similarity == 1
    assert metrics.evaluate(g.drop("quote"), e, p, f).first().similarity < 1


def test_chunks_and_search(spark):
    text = ("word " * 300).strip() + "\n\n" + "x" * 2500
    spans = retrieval.split_text(text, 500, 50)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < z - a <= 500 for a, z in spans)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))
    assert retrieval.chunks(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(5, [5.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.id for r in retrieval.top_k(v, q, 3).orderBy("rank").collect()] == [4, 6, 3]
    assert [r.id for r in retrieval.top_k(v, v.withColumnRenamed("vec_id", "query_id"), 1, block=3).where("query_id = 19").collect()] == [18]


def test_bottom_share(spark):
    r = random.Random(5)
    rows = [(i, r.choice([r.gauss(0, 1), 0.5, -3.0, None])) for i in range(2000)]
    want = sorted((x, i) for i, x in rows if x is not None)
    df = spark.createDataFrame(rows, "id long, x double")
    for share in (0.0, 0.03, 0.3, 0.5):
        got = retrieval.bottom_share(df, "id", "x", share, small=5, buckets=7).collect()
        assert sorted((g.x, g.id) for g in got) == want[: max(1, int(share * len(want)))]


def test_prompts_and_steps(spark):
    t = prompts.parse_template("# System Prompt\n--- 1 ---\n```\nS1\n```\n--- 2 ---\nS2\n# User Prompt\nU <a.txt> <b.txt>\n")
    assert t == {"system": ["S1", "S2"], "user": ["U <a.txt> <b.txt>"]}
    assert prompts.substitute("U <a.txt> <b.txt> <step 2 formatting instructions>", {"a.txt": "A"}, {2: "F"}) == "U A <b.txt> F"
    assert len(prompts.variations(t, "one-shot", ["z1", "z2"])) == 4
    assert inference.fill_steps("x <Step 1 Output> <step 9 output>", ["o"]) == "x o "
    with pytest.raises(KeyError):
        prompts.render_format("{a}", {})
    bad = inference.generate(spark.createDataFrame([("s", "u")], "system string, user string"), lambda: lambda s, u: 1 / 0).first()
    assert bad.text is None and "division" in bad.error


def test_logs(spark):
    lines = spark.createDataFrame([("2025-01-01 10:00:00,123 | INFO | run | Total papers: 20",), ("2025-01-01 10:00:05 | INFO | run | latency: 2.5 s",), ("noise",)], "value string")
    got = runlog.parse_lines(lines).collect()
    assert [(r.total, r.latency) for r in got] == [(20, None), (None, 2.5)] and got[0].level == "INFO"
    stats = runlog.latency_stats(spark.createDataFrame([(i, float(i)) for i in range(10)], "t int, x double"), "x", "t", last=3).first()
    assert stats.n == 10 and stats["last"] == [9.0, 8.0, 7.0][::-1] and stats.mean == 4.5
