"""Token chunks and the vector index against brute force."""

import random

import numpy as np
import pytest

from arglake.operators import retrieval

VECTORS = "vec_id long, embedding array<double>"


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


def test_index_equals_the_full_scan(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8)) * 20
    vectors = [(i, (centres[i % 12] + r.normal(size=8)).tolist()) for i in range(600)]
    index = retrieval.VectorIndex(spark, f"file://{tmp_path}/index")
    queries = spark.createDataFrame(vectors[::40] + [(9999, [0.0] * 8)], VECTORS.replace("vec_id", "query_id"))
    assert index.search(queries, 5).collect() == [] and index.search_told(queries, 5)[1] == 0
    frame = lambda some: spark.createDataFrame(some, VECTORS)
    index.add(frame([(i, [x + 1000 for x in v]) for i, v in vectors[:300]] + [(700, [1.0] * 8)]))
    index.add(frame(vectors[:400]))  # replaces most of the first addition
    index.add(frame(vectors[400:] + [(800, vectors[7][1]), (801, vectors[7][1])]))  # equal vectors: ties by id
    everything = frame(vectors + [(700, [1.0] * 8), (800, vectors[7][1]), (801, vectors[7][1])])
    want = rows(retrieval.top_k(everything, queries, 5))
    assert sorted(index.vectors().collect()) == sorted(everything.collect())
    found, skipped = index.search_told(queries, 5, block=7)
    assert rows(found) == want and skipped > 0.5
    (tmp_path / "index" / "rows" / "segment=5" / "cell=0").mkdir(parents=True)  # an addition that broke off is not seen
    frame(vectors[:3]).write.mode("append").parquet(f"file://{tmp_path}/index/rows/segment=5/cell=0")
    assert rows(index.search(queries, 5)) == want
    index.compact()
    found, skipped = index.search_told(queries, 5)
    assert rows(found) == want and skipped > 0.5 and sorted(index.vectors().collect()) == sorted(everything.collect())
    assert rows(index.search(queries, 2000)) == rows(retrieval.top_k(everything, queries, 2000))  # more than there are


@pytest.mark.parametrize("encoder", ["words", "bytes"])
def test_token_chunks(spark, encoder):
    r = random.Random(2)
    texts = ["", None, "   ", "one", "  two words ", "é😀漢字 ünï " * 30, " ".join(r.choice(["alpha", "beta", "γάμμα", "\n", "d-e.f"]) for _ in range(300))]
    if encoder == "words":
        factory = retrieval.word_offsets
    else:
        public = pytest.importorskip("public_tokenizers")
        factory = retrieval.token_offsets(public.path("byte_bpe_50k.json"))
    offsets = factory()([t or "" for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((7, 2), (5, 0), (800, 120)):
        found = {}
        for c in retrieval.token_chunks(docs, factory, size=size, overlap=overlap).orderBy("id", "chunk_index").collect():
            found.setdefault(c.id, []).append(c)
        for i, (t, o) in enumerate(zip(texts, offsets)):
            own = found.get(i, [])
            starts = [s for k, s in enumerate(range(0, len(o), size - overlap)) if k == 0 or s + overlap < len(o)]
            assert [c.tokens for c in own] == [min(size, len(o) - s) for s in starts]
            if own:
                assert "".join(t[c.fresh : c.end] for c in own) == t and own[0].start == 0 and own[-1].end == len(t)
                for c, s in zip(own, starts):
                    assert c.text == t[c.start : c.end] and c.chunk_id == f"{i}-{c.chunk_index}"
                    # all tokens of the chunk that do not share a character with the next chunk's first are inside
                    assert s == 0 or c.start == o[s][0]
                    assert all(c.start <= a for a, _ in o[s : s + c.tokens]) and (s + c.tokens == len(o) or c.end == max(c.start, o[s + c.tokens][0]))


def test_contexts(spark):
    docs = spark.createDataFrame([(1, "cats purr softly at night"), (2, "stocks fell sharply on monday")], "doc_id int, text string")
    chunks = retrieval.token_chunks(docs, size=3, overlap=1)
    asked = spark.createDataFrame([("a", "cats purr softly"), ("b", "fell sharply on")], "question_id string, question string")
    got = {r.question_id: r for r in retrieval.contexts(chunks, asked, k=2).collect()}
    assert got["a"].chunks[0] == "1-0" and got["a"].context.startswith("cats purr softly \n\n") and got["b"].chunks[0] in ("2-0", "2-1") and len(got["b"].chunks) == 2
