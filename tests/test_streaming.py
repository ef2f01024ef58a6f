"""Keyed tables and generation jobs: replays, crashes, restarts."""

import os

import pytest
from pyspark.sql import functions as F

from arglake.streaming import generation, incremental
from arglake.streaming.keyed_table import KeyedTable


def held(table):
    return {r.k: (r.at, r.v) for r in table.read().collect()}


def test_keyed_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    table = KeyedTable(spark, f"file://{path}", "k", "at", shards=8)
    rows = lambda *x: spark.createDataFrame(x, "k string, at int, v string")
    with pytest.raises(FileNotFoundError):
        table.read()
    first = [(f"k{i}", 5, "first") for i in range(40)]
    assert table.upsert(rows(*first, ("k0", 6, "x"), (None, 1, "null key")), 0)
    assert len(held(table)) == 41 and held(table)["k0"] == (6, "x") and held(table)[None] == (1, "null key")
    before = {k for k, n in table.manifest(0)["shards"].items()}
    # a late row does not win, one of an equal place does; only the shards of the keys are written
    assert table.upsert(rows(("k1", 4, "late"), ("k2", 5, "equal"), ("new", 1, "new")), 1)
    assert held(table)["k1"] == (5, "first") and held(table)["k2"] == (5, "equal") and held(table)["new"] == (1, "new")
    shards = table.manifest(1)["shards"]
    assert {0, 1} == set(shards.values()) and before <= set(shards) and sum(n == 1 for n in shards.values()) <= 3
    # a replay changes nothing, whatever it holds
    assert not table.upsert(rows(("k1", 9, "replayed")), 1) and held(table)["k1"] == (5, "first")
    # a commit that broke off between its files and its manifest is not seen, and is written again
    rows(("k1", 99, "lost")).withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(f"file://{path}/data/commit=2")
    assert held(table)["k1"] == (5, "first") and KeyedTable(spark, f"file://{path}", "k", "at").upsert(rows(("k1", 7, "again")), 2)
    assert held(table)["k1"] == (7, "again") and len(held(table)) == 42
    # replaced files go once no recent manifest names them
    for n in range(3, 8):
        table.upsert(rows(*((k, n + 5, f"at {n}") for k, *_ in first)), n)
    assert table.commits() == [5, 6, 7] and held(table)["k39"] == (12, "at 7") and len(held(table)) == 42
    named = {str(c) for n in table.commits() for c in table.manifest(n)["shards"].values()}
    assert {d.removeprefix("commit=") for d in os.listdir(f"{path}/data")} <= named
    assert table.upsert(rows(), 8) and len(held(table)) == 42  # an empty batch


def test_upsert_stream_restarts(spark, tmp_path):
    src, up, cp = (f"file://{tmp_path}/{x}" for x in ("src", "up", "cp"))
    spark.range(30).select(F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), "id").repartition(5).write.parquet(src)
    run = lambda: incremental.upsert_each(incremental.stream_table(spark, src, 1), up, cp, "kind", "id", shards=4).awaitTermination()
    run()
    spark.createDataFrame([("k0", 1), ("k9", 50)], "kind string, id long").write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.kind, r.id) for r in incremental.latest(spark, up).collect()) == [("k0", 27), ("k1", 28), ("k2", 29), ("k9", 50)]


def counting_model(folder, fails):
    """Leaves a file for each call, and fails so often for a prompt that holds a word of ``fails``."""

    def factory():
        import os
        import uuid

        def model(system, user):
            open(os.path.join(folder, f"{user.replace(' ', '_')}-{uuid.uuid4().hex}"), "w").close()
            calls = sum(f.startswith(f"{user.replace(' ', '_')}-") for f in os.listdir(folder))
            for word, times in fails.items():
                if word in user and calls <= times:
                    raise ValueError("busy")
            return {"text": f"{system}|{user}"}

        return model

    return factory


def test_generation_job(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("requests", "out", "cp"))
    prompts = spark.createDataFrame([("p1", "sys", "say {text}"), ("p2", None, "ask {text}"), ("p3", "", "never")], "prompt_id string, system_prompt string, user_prompt string")
    from arglake.operators.prompts import PLACEHOLDER

    prompts = prompts.withColumn("user_prompt", F.replace("user_prompt", F.lit("{text}"), F.lit(PLACEHOLDER)))
    papers = spark.createDataFrame([(1, "one"), (2, "flaky"), (3, "broken"), (4, None), (5, "beyond")], "paper_id int, paper_text string")
    requests = generation.requests_of(prompts, papers, prompt_limit=2, paper_limit=4)
    assert sorted((r.prompt_id, r.paper_id, r.user_prompt) for r in requests.collect())[:2] == [("p1", "1", "say one"), ("p1", "2", "say flaky")]
    assert requests.count() == 6
    requests.coalesce(1).write.parquet(src)
    model = counting_model(str(calls), {"flaky": 1, "broken": 99})

    def job(wait):
        return generation.run_job(generation.request_stream(spark, src), out, cp, model, attempts=3, wait_seconds=wait)

    def finished():
        return {(r.prompt_id, r.paper_id): (r.status, r.attempt, r.text) for r in generation.outputs(spark, out).collect()}

    first = job(2)
    while not (first.lastProgress and first.lastProgress["numInputRows"] == 0):
        first.awaitTermination(0.1)
    first.stop()  # killed while requests wait for their next attempt
    assert finished().items() >= {("p1", "1"): ("done", 1, "sys|say one"), ("p2", "1"): ("done", 1, "|ask one")}.items()
    # started again: requests that come again are not asked again, attempts that are due are
    requests.where("paper_id <> '3'").union(spark.createDataFrame([("q", "9", "", "more")], generation.REQUEST)).coalesce(1).write.mode("append").parquet(src)
    generation.finish(job(0.1), spark, out)
    done = finished()
    assert done["p1", "2"] == ("done", 2, "sys|say flaky") and done["p2", "3"] == ("failed", 3, None) and done["q", "9"] == ("done", 1, "|more")
    generation.finish(job(0.1), spark, out)  # nothing is left to do
    assert len(done) == 7 and generation.outputs(spark, out).count() == 7  # a finished key has one output
    times = lambda word: sum(word in f for f in os.listdir(calls))
    assert (times("one"), times("flaky"), times("broken"), times("beyond"), times("never")) == (2, 4, 6, 0, 0)


def test_dry_run(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("requests", "out", "cp"))
    spark.createDataFrame([("p", "1", "s", "u"), ("p", "1", "s", "again")], generation.REQUEST).coalesce(1).write.parquet(src)

    def no_model():
        raise AssertionError("a dry run has no model")

    generation.finish(generation.run_job(generation.request_stream(spark, src), out, cp, no_model, dry_run=True), spark, out)
    (row,) = generation.outputs(spark, out).collect()
    assert (row.status, row.text, row.dry_run) == ("done", "", True)


def test_a_call_takes_many_requests(spark, tmp_path, monkeypatch):
    """Python is called for buckets, whose keys are told apart; nulls are keys too, and all rows come out once."""
    monkeypatch.setattr(generation, "BUCKETS", 3)
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("requests", "out", "cp"))
    rows = [(f"p{i % 2}", None if i < 2 else str(i), None, f"u{i}") for i in range(300)]
    spark.createDataFrame(rows + rows[:50], generation.REQUEST).repartition(2).write.parquet(src)
    calls = spark.sparkContext.accumulator(0)

    class Counted(generation._Job):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(generation, "_Job", Counted)
    for _ in range(2):
        generation.finish(generation.run_job(generation.request_stream(spark, src), out, cp, None, dry_run=True), spark, out)
    got = [(r.prompt_id, r.paper_id, r.user_prompt, r.status, r.attempt, r.text) for r in generation.outputs(spark, out).collect()]
    assert sorted(got, key=str) == sorted([(p, d, u, "done", 1, "") for p, d, _, u in rows], key=str)
    assert 0 < calls.value <= 3
