from collections import Counter

import pytest
import public_tokenizers

import corpus_pipeline
from arglake.llm import common, piece_coding, queries, toxicity
from tests.llm.test_dedup import brute_components, lone_pairs
from tests.llm.test_text import toxic_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = toxic_rows(200)
    rows = [(i, t, ["en", "fr", None][i % 3], s, len(t)) for i, t, _, s in docs]
    rows += [(1000 + i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(rows[:30])]  # exact copies
    rows += [(2000 + i, t + " tail", lang, s, n + 5) for i, (_, t, lang, s, n) in enumerate(rows[30:60])]  # near copies
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (3002, "", "en", "s", 0)]
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = common.table(spark, folder, "documents")
    names = docs.columns
    seen = [sorted((r.doc_id, r.text) for r in docs.collect())]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialise(stage(spark, docs, folder), "stage")
        if i < 4:
            assert docs.columns == names
            seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    start, clean, exact, near, mixed = seen
    lexicon = toxicity.learn(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"), toxicity.training_rows())
    m = lexicon.matcher()
    assert {d for d, _ in clean} == {d for d, t in start if m.score(t or "") < 0.3}
    first = {}
    for d, t in sorted(clean, key=lambda x: x[0]):
        first.setdefault(" ".join(common.words(t or "")) if t else "", d)
    assert {d for d, _ in exact} == set(first.values())
    assert {d for d, _ in near} == {d for d, _, c in brute_components(exact) if d == c}
    assert {d for d, _ in mixed} == {d for d, _ in near} and len(mixed) >= len(near)
    model = piece_coding.encoder(public_tokenizers.path("piece_bpe_32k.model")).model
    want = Counter((d, tuple(model.encode(t or "") + [2])) for d, t in mixed)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in docs.collect()) == want


def test_near_copies_go_across_the_shingle_spaces(spark):
    rows = lone_pairs()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _ in rows[::2]]


def test_run_and_registration(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 0
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {"pipeline", *queries.QUERIES} <= set(found)
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, tables):
    folder, _ = tables
    docs = common.table(spark, folder, "documents")
    wide = docs.where("doc_id < 40").selectExpr("*", "1 AS n", "2 AS key", "3 AS sha", "'x' AS kept", "4 AS rate", "5 AS row", "6 AS score", "7 AS component_id", "8 AS text_sha256", "9 AS bytes")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        nothing = stage(spark, docs.limit(0), folder)
        assert nothing.collect() == [] and (i == 4 or nothing.columns == docs.columns)
        got = stage(spark, wide, folder)
        assert got.count() > 0 and (i == 4 or got.columns == wide.columns)


def test_every_query_runs_on_the_small_tables(spark):
    for name, query in queries.QUERIES.items():
        table = "pages" if name.startswith("op3") else "documents"
        got = query(spark, "/root/testdata/sf0.001")
        assert got.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count(), name


def test_clean_up_removes_what_was_written(spark):
    made = common.materialise(spark.range(3).toDF("x"), "for-a-while")
    assert made.count() == 3
    common.clean_up(spark)
    made = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(common.shared_dir(spark)).where("path like '%for-a-while%'")
    assert made.count() == 0
