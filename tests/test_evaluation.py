import json

import numpy as np
import pyarrow as pa
import pytest

from arglake.config import Settings
from arglake.functions import similarity
from arglake.operators import evaluation, extraction, hooks, inference, metrics, prompts, retrieval, runlog
from arglake.sources import discovery

NODES = "map_id string, pos int, id string, text string"
EDGES = "map_id string, pos int, src string, tgt string, type string"
MAP = {"ADUs": {"a": {"type": "Major Claim", "text": "first claim"}, "b": {"type": "Claim", "text": "other premise"}}, "relations": [{"src": "b", "tgt": "a", "type": "support"}]}


def gold(spark):
    nodes = spark.createDataFrame([("p1", 0, "x", "first claim"), ("p1", 1, "y", "other premise"), ("p2", 0, "x", "something else here")], NODES)
    return nodes, spark.createDataFrame([("p1", 0, "y", "x", "support")], EDGES)


def output(paper, text, strategy="standard", shot="zero-shot"):
    return {"id": paper, "text": text, "prompt_info": {"strategy": strategy, "shot_type": shot}}


def test_evaluate_folder(spark, tmp_path):
    good, bad = json.dumps(MAP), "no map at all"
    (tmp_path / "sub").mkdir()
    (tmp_path / "generation_outputs_1.json").write_text(json.dumps([output("p1", good), output("p1", bad)]))
    (tmp_path / "sub" / "checkpoint_1.json").write_text(json.dumps({"outputs": [output("p1", good, "cot", "few-shot"), output("nobody", good)]}))
    (tmp_path / "sub" / "individual_1.json").write_text(json.dumps(output("p2", good)))
    (tmp_path / "other.json").write_text("[]")
    nodes, edges = gold(spark)
    rows = evaluation.evaluate_folder(spark, f"file://{tmp_path}", nodes, edges, once=True).collect()
    by = {(r.paper_id, r.strategy, r.parse_success): r for r in rows}
    assert len(rows) == 5 and len({r.output for r in rows}) == 5
    # without an attack among the gold relations its F1 is 0, and the macro F1 a half
    assert by["p1", "standard", True].combined_score == by["p1", "cot", True].combined_score == (1 + 0.5 + 1 + 1) / 4
    assert by["p2", "standard", True].f1 == 0 and by["nobody", "standard", True].f1 is None
    assert by["p1", "standard", False].parse_error and by["p1", "standard", False].f1 is None
    twice = evaluation.evaluate_folder(spark, f"file://{tmp_path}", nodes, edges)
    t = evaluation.totals(twice).first()
    assert (t.total_papers, t.successful_parses, t.failed_parses) == (7, 5, 2)  # the folder's own file is found by both searches
    s = {(r.strategy, r.shot_type): r for r in evaluation.summary(twice).collect()}
    assert s["cot", None].avg_f1 == 1 and s[None, "few-shot"].n == 1 and s[None, None].n == 5
    assert s["standard", None].avg_f1 == 0.5  # a paper without gold counts as 0
    assert evaluation.printed(twice).first().line.startswith("papers 7, parsed 5")
    (tmp_path / "none").mkdir()
    empty = evaluation.totals(evaluation.evaluate_folder(spark, f"file://{tmp_path}/none", nodes, edges)).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_discovery(spark, tmp_path):
    for f in ("are/m/top.json", "are/m/run_pipeline2_x/a.json", "are/m/run_pipeline3_x/b.json", "adur/m/deep/er/c.json", "zero/z.json", "zero/z.txt", "few/checkpoints/f.json"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("[]")
    base = f"file://{tmp_path}"
    folders = {"are": [f"{base}/are/m"], "adur": [f"{base}/adur/m", f"{base}/not-there"]}
    assert names(discovery.pipeline_files(spark, folders, "pipeline2")) == ["a.json"]
    assert names(discovery.pipeline_files(spark, folders)) == ["a.json", "b.json", "c.json"]
    assert names(discovery.pipeline_files(spark, folders, "pipeline3")) == ["c.json"]
    shots = {"zero-shot": f"{base}/zero", "one-shot": f"{base}/nothing", "few-shot": f"{base}/few"}
    assert sorted((r.shot, r.name) for r in discovery.shot_files(spark, shots).collect()) == [("few-shot", "f.json"), ("zero-shot", "z.json")]
    with pytest.raises(FileNotFoundError):
        discovery.shot_files(spark, {}, "zero-shot")
    assert names(discovery.named_files(spark, folder=f"{base}/zero")) == ["z.json"]
    assert names(discovery.named_files(spark, ["/x/y.json"])) == ["y.json"] and names(discovery.named_files(spark)) == []
    with pytest.raises(FileNotFoundError):
        discovery.named_files(spark, folder=f"{base}/not-there")
    (tmp_path / "a" / "a").mkdir(parents=True)
    (tmp_path / "a" / "a" / "deep.json").write_text("[]")
    (tmp_path / "a" / "own.json").write_text("[]")
    assert names(discovery.listing(spark, f"{base}/a/")) == names(discovery.named_files(spark, folder=f"{tmp_path}/a")) == ["own.json"]
    (tmp_path / "ids_1.csv").write_text("identifier\nOLD\n")
    (tmp_path / "ids_2.csv").write_text("identifier,x\nA,1\n ,2\nB,3\n")
    found = discovery.input_list(spark, None, None, base)
    assert found.endswith("ids_2.csv") and discovery.input_list(spark, None, "/c.csv", base) == "/c.csv"
    assert sorted(r.identifier for r in discovery.identifiers(spark, found).collect()) == ["A", "B"]
    assert [r.identifier for r in discovery.identifiers(spark, found, ["Z"]).collect()] == ["Z"]


def test_prompt_folders(spark, tmp_path):
    def write(folder, **files):
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / f"{name}.txt").write_text(text)
        return f"file://{tmp_path}/{folder}"

    full = prompts.load_folder(spark, write("few-shot", system_prompt_2="s2", system_prompt_1="s1", user_prompt="u", user_prompt_2="v", notes="-")).collect()
    assert [(r.shot_type, r.variation, r.user_file, r.system, r.user) for r in full] == [("few-shot", v, f, s, u) for v, s in (("zs1", "s1"), ("zs2", "s2")) for f, u in (("user_prompt.txt", "u"), ("user_prompt_2.txt", "v"))]
    alone = prompts.load_folder(spark, write("zero-shot", user_prompt="u")).first()
    assert (alone.variation, alone.system, alone.system_file) == ("default", None, None)
    for folder, error in ((write("empty", system_prompt_1="s"), ValueError), (f"file://{tmp_path}/gone", FileNotFoundError)):
        with pytest.raises(error):
            prompts.load_folder(spark, folder)
    one = prompts.load_stepwise(spark, write("all_in_one", system_prompt="s", user_prompt_1="u1", user_prompt_2="u2")).first()
    assert (one.system, one.user, one.steps) == ("s", "u1", None)
    steps = lambda folder, **f: [tuple(x) for x in prompts.load_stepwise(spark, write(folder, **f)).first().steps]
    assert steps("system_stepwise", system_prompt_1="s1", system_prompt_2="s2", user_prompt_1="u1") == [(1, "s1", "u1")]
    assert steps("user_stepwise", system_prompt="s", user_prompt_1="u1", user_prompt_2="u2") == [(1, "s", "u1"), (2, "s", "u2")]
    for bad in (write("user_stepwise_x", user_prompt="u"), write("odd", system_prompt="s", user_prompt="u")):
        with pytest.raises(ValueError):
            prompts.load_stepwise(spark, bad)


def test_template_set():
    text = "# System Prompt\nYou. <rules>\n# User Prompt\nDo <step 1 formatting instructions>\n--- 2 ---\nDo more\n"
    got = prompts.template_set({"cot": text, "none": "", "blank": "no headings"}, {"rules": "Be kind."}, {1: "as JSON"})
    assert [(x["shot_type"], x["system"], x["user"]) for x in got] == [("cot", "You. Be kind.", "Do as JSON"), ("cot", "You. Be kind.", "Do more")]


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "One claim here. Another one there. And a third one."), (2, None)], "doc_id long, text string")
    spans = inference.stub_classifier(("claim", "claim", "O"))
    nodes, edges = extraction.extract_maps(docs, spans, inference.stub_classifier(("support", "attack", "no_relation")), major=True)
    n, e = nodes.collect(), edges.collect()
    assert n and {r.map_id for r in n} == {1} and sum(r.major for r in n) == 1
    assert {x for r in e for x in (r.src, r.tgt)} <= {r.id for r in n} and {r.type for r in e} <= {"support", "attack"}
    r = extraction.results(nodes, edges).first()
    assert (r.statistics.total_adus, r.statistics.total_relations) == (len(n), len(e)) == (len(r.adus), len(r.relations))
    gold_nodes, gold_edges = gold(spark)
    asked = spark.createDataFrame([("p1", "", "x")], "map_id string, system string, user string")
    answer = lambda: lambda system, user: {"text": "Here it is: " + json.dumps(MAP)}
    assert extraction.evaluate_generator(asked, answer, gold_nodes, gold_edges).where("map_id = 'p1'").first().combined_score == 0.875


def test_hooks_and_settings(spark, tmp_path):
    nodes, edges = gold(spark)
    count = lambda gn, ge, pn, pe: gn.groupBy("map_id").count()
    relations = lambda gn, ge, pn, pe: ge.groupBy("map_id").count()
    got = {r.map_id: (r.nodes_count, r.edges_count) for r in hooks.compute({"nodes": count, "edges": relations}, nodes, edges, nodes, edges).collect()}
    assert got == {"p1": (2, 1), "p2": (1, None)}
    papers = spark.createDataFrame([("p1", "t", "train"), ("p2", "t", "test")], "id string, text string, split string")
    part = hooks.DatasetAdapter(papers, nodes, edges).split("test")
    assert part.nodes.count() == 1 and part.edges.count() == 0 and [x["id"] for x in part.iterate()] == ["p2"]
    models = hooks.Models()
    models.register("spans", "stub", lambda labels=("O",): inference.stub_classifier(labels)(), lambda s: [] if s.get("labels") else ["no labels"])
    assert models.wrong("spans", "stub") == ["no labels"] and "stub" in models.wrong("spans", "x")[0]
    assert models.get("spans", "stub", labels=("claim",))()(["a"])[0][0] == "claim"
    with pytest.raises(ValueError):
        models.get("spans", "x")
    (tmp_path / "c.json").write_text('{"a": {"b": {"c": 1}, "n": null}}')
    s = Settings.load(f"{tmp_path}/c.json")
    assert (s.get("a.b.c"), s.get("a.x.c", 7), s.get("a.b.c.d"), s.get("a.n", 3)) == (1, 7, None, None)


def test_index_quotes_and_upsert(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = retrieval.VectorIndex(spark, f"file://{tmp_path}/index")
    index.add(frame((1, [0.0, 0.0]), (2, [1.0, 0.0])))
    index.add(frame((3, [0.0, 2.0]), (2, [9.0, 9.0])))
    asked = spark.createDataFrame([(100, [0.0, 1.5])], "query_id long, embedding array<float>")
    assert [r.id for r in index.search(asked, 3).orderBy("rank").collect()] == [3, 1, 2]
    assert retrieval.centroid(frame((1, [0.0, 2.0]), (2, [1.0, 4.0]), (3, None))).first().centroid == [0.5, 3.0]
    assert retrieval.centroid(frame((1, None))).collect() == []
    quotes = spark.createDataFrame([(1, "ab"), (2, "b"), (3, "ab"), (4, ""), (5, None)], "q long, quote string")
    docs = spark.createDataFrame([(10, "xxabx"), (11, "b"), (12, ""), (13, None)], "d long, text string")
    for most in (10**6, 1):
        got = sorted(tuple(r) for r in retrieval.contained(quotes, docs, "q", "d", most=most).collect())
        assert got == [(1, 10), (2, 10), (2, 11), (3, 10), (4, 10), (4, 11), (4, 12)]
    rows = lambda *x: spark.createDataFrame(x, "k string, n int, v string")
    merged = runlog.upsert(rows(("a", 0, "old"), ("b", 0, "kept")), rows(("a", 1, "x"), ("a", 2, "last"), ("c", 1, "new")), "k", "n")
    assert sorted((r.k, r.v) for r in merged.collect()) == [("a", "last"), ("b", "kept"), ("c", "new")]


def test_metrics_of_the_same_map_twice(spark):
    nodes, edges = gold(spark)
    outputs = spark.createDataFrame([("p1", json.dumps(MAP), None)] * 2, "id string, text string, prompt_info struct<strategy:string,shot_type:string>")
    got = evaluation.evaluate_outputs(outputs, nodes, edges, metrics.THRESHOLD).collect()
    assert len(got) == 2 and all(r.combined_score == 0.875 and r.strategy == "unknown" for r in got)


def test_report_and_saved_maps(spark, tmp_path):
    nodes, edges = gold(spark)
    told = [("p1", json.dumps(MAP), ("standard", "zero-shot")), ("p1", json.dumps(MAP), ("cot", "few-shot")), ("p1", "no map", ("cot", "zero-shot"))]
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string, prompt_info struct<strategy:string,shot_type:string>")
    saved = f"file://{tmp_path}/maps"
    first = evaluation.evaluate_outputs(frame(told), nodes, edges, saved_maps=saved)
    n = spark.read.parquet(saved).count()
    assert n == 3
    more = [*told, ("p2", json.dumps(MAP), ("cot", "zero-shot"))]
    again = evaluation.evaluate_outputs(frame(more), nodes, edges, saved_maps=saved)
    assert spark.read.parquet(saved).count() == 4  # only the new output was parsed
    plain = evaluation.evaluate_outputs(frame(more), nodes, edges)
    assert sorted(map(str, again.collect())) == sorted(map(str, plain.collect()))
    assert first.count() == 3
    evaluation.write_report(again, f"file://{tmp_path}/report")
    (told,) = spark.read.json(f"file://{tmp_path}/report/summary").collect()
    assert (told.total_papers, told.successful_parses, told.failed_parses, told.parse_success_rate) == (4, 3, 1, 0.75)
    assert told.aggregate.n == 3 and told.by_strategy.standard.avg_f1 == 1 and told.by_strategy.cot.n == 2 and told.by_shot_type["few-shot"].avg_f1 == 1
    assert spark.read.json(f"file://{tmp_path}/report/papers").count() == 4
    evaluation.write_report(again.where("false"), f"file://{tmp_path}/empty")
    assert spark.read.json(f"file://{tmp_path}/empty/summary").first().total_papers == 0


def test_flattened(spark):
    from arglake.operators import catalog

    df = spark.createDataFrame([(1, ["a", "b"], {"k": [1]}, None, [1.5, 2.0]), (2, ["a", None], None, "x", [])], "` id ` int, tags array<string>, m map<string,array<int>>, t string, x array<double>")
    assert [tuple(r) for r in catalog.flattened(df).collect()] == [("1", "a;b", '{"k":[1]}', "", "1.5;2.0"), ("2", '["a",null]', "", "x", "")]
    assert catalog.flattened(df).columns == ["id", "tags", "m", "t", "x"]


def random_maps(spark, seed):
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for m in range(40):
        ids = [f"a{i}" for i in range(int(rng.integers(1, 6)))]
        for pos, i in enumerate(ids):
            nodes.append((m, pos, i, ["red apples fall", "red apples fell ", "blue skies", "green hills", "red apples fall", "green hills", None, ""][rng.integers(8)], [None, "blue skies"][rng.integers(2)]))
        for pos in range(int(rng.integers(0, 14))):
            src, tgt = (str(rng.choice([*ids, "gone"])) for _ in range(2))
            edges.append((m, pos, src, tgt, ["support", "attack", "support", "Support", None][rng.integers(5)]))
    return spark.createDataFrame(nodes, "map_id long, pos int, id string, text string, quote string"), spark.createDataFrame(edges, "map_id long, pos int, src string, tgt string, type string")


def test_scores_of_a_pair_are_those_of_the_relational_operators(spark):
    (gold, gold_links), (pred, pred_links) = random_maps(spark, 1), random_maps(spark, 2)
    pred = pred.where("map_id <> 7")
    pred_links = gold_links.where("pos % 3 <> 0").unionByName(pred_links.selectExpr("map_id", "pos + 20 AS pos", "src", "tgt", "type"))
    got = {r["map_id"]: r for r in metrics.evaluate(gold, gold_links, pred, pred_links).collect()}
    scores = metrics.similarities(gold, pred, metrics.THRESHOLD)
    for r in metrics.node_f1(gold, pred, scores).collect():
        assert all(got[r["map_id"]][c] == pytest.approx(r[c]) for c in ("matched", "precision", "recall", "f1"))
    relations = {r["map_id"]: r for r in metrics.relation_f1(gold_links, pred_links, metrics.best_matches(scores)).collect()}
    assert any(r["support_f1"] for r in relations.values()) and any(r["attack_f1"] for r in relations.values())
    for m, r in got.items():
        assert all(r[c] == pytest.approx(relations[m][c] if m in relations else 0.0) for c in ("support_f1", "attack_f1", "macro_f1"))
    assert sorted(got) == list(range(40)) and got[7]["pred_adus"] == got[7]["matched"] == 0


def test_a_pair_goes_to_python_once(spark):
    (gold, gold_links), (pred, pred_links) = random_maps(spark, 1), random_maps(spark, 2)
    plan = metrics.evaluate(gold, gold_links, pred, pred_links)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("ArrowEvalPython", "MapInPandas", "Join"))


def test_equal_problems_are_solved_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(metrics, "edit_distance", lambda *a: calls.append(a) or (0, 0))
    metrics._distance.cache_clear(), metrics._edits.cache_clear()
    for ids in (["a", "b"], ["x", "y"], ["a", "b"]):
        links = [[ids[1], ids[0], "support"]]
        metrics._edits(json.dumps([ids, links, ids, links]), bytes([1, 0, 0, 1]), 10)
    assert len(calls) == 1
    metrics._distance.cache_clear(), metrics._edits.cache_clear()


def test_scores_of_lists():
    rows = [(["abc", None], ["abd", "abc", ""]), ([], ["x"]), (["q"], []), ([" abc "], ["abc"])]
    a, b = (pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in (0, 1))
    got = list(similarity.scores_of_lists(a, b))
    assert [x.tolist() for x in got] == [similarity.ratios([x for x in g for _ in p], [y for _ in g for y in p]).tolist() for g, p in rows]
    assert list(similarity.scores_of_lists(a, b, 0.7, strip=True))[3].tolist() == [1.0]
    assert [x.tolist() for x in similarity.scores_of_lists(a.slice(3), b.slice(3), strip=True)] == [[1.0]]
