import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from arglake.llm import piece_coding, token_blocks

EDGES = [None, "", " ", "a", "  lead", "tail  ", "two  spaces", "line\nbreak\t x", "é 日本 😀 ▁ x", "<|endoftext|> </s> <s>", "a" * 5000, " " * 300 + "x", " nb sp", "ab" * 3000 + " " + "word " * 4000]


def texts(n=300, seed=1):
    r = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "é", "日", "▁", "😀", "0", "-", ".", "'s", " of", "tion"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
@pytest.mark.parametrize("top", [1, 2, 200, 50_257, 2**32 - 1])
def test_file_round_trip(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    if n > 20:
        ids[::13] = r.integers(0, 2**32 - 1, len(ids[::13]))
    f = token_blocks.TokenFile(token_blocks.encode_file(ids, [3, None], np.array([n, 0])))
    assert f.ids().tolist() == ids.tolist()
    assert f.doc_ids.to_pylist() == [3, None] and f.lengths.tolist() == [n, 0]
    if n > 300:
        assert f.ids(2, 4).tolist() == ids[256:512].tolist()


def test_blocks_are_small_and_patched():
    ids = np.full(1280, 40_000, np.uint32)
    ids += np.arange(1280, dtype=np.uint32) % 16
    ids[5] = 2**31
    data = token_blocks.encode_file(ids, [1], np.array([1280]))
    assert len(data) < 1280 and token_blocks.TokenFile(data).ids().tolist() == ids.tolist()


def test_token_table(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 7 % 1000, t) for i, t in enumerate(EDGES + texts())] + [(-1, "minus one <|endoftext|> x"), (None, "null id"), (14, "repeated id"), (14, "repeated id")]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, start int, shard string")
    got = [r.asDict() for r in token_blocks.token_table(docs, path, keep_ids=True, file_ids=500).collect()]
    tokenizer = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc, text in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append({"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes()), "token_ids": ids})
        start += len(ids)
    assert sorted(got, key=lambda r: r["start"]) == want


def test_pieces_remembered_and_forgotten_do_not_change_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    some = [t or "" for t in EDGES] + texts(3000, 5) + ["a <|endoftext|> b", "<|endoftext|>", "x\u00a0 y", " \u2003z ", "end\n"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [7] for t in some]
    for known in (60, 1500, 10**6):
        e = token_blocks.ChunkEncoder(path, 7, known)
        for _ in range(2):
            for i in range(0, len(some), 100):
                ids, lengths = e(some[i : i + 100])
                assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want[i : i + 100]
        assert known > 10_000 or e.next < 10 * known + 5000


def test_token_files_export(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string")
    token_blocks.write_token_files(docs, f"file://{tmp_path}/files", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_blocks.export(spark, f"file://{tmp_path}/files", f"{tmp_path}/plain") >= 1
    n = sum(token_blocks.TokenFile(p.read_bytes()).n_ids for p in (tmp_path / "plain").iterdir())
    assert n == spark.read.parquet(f"file://{tmp_path}/files").agg({"n_ids": "sum"}).first()[0]


def test_token_table_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_blocks.token_table(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_pieces_equal_the_library():
    e = piece_coding.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert e.cuts
    for t in [x or "" for x in EDGES] + texts(2000, 2) + [" " * n + "a" + " " * n for n in range(40)]:
        assert e.encode(t) == e.model.encode(t) + [2], repr(t[:50])


def test_pieces_without_cuts():
    e = piece_coding.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    e.cuts = False
    for t in texts(200, 3):
        assert e.encode(t) == e.model.encode(t) + [2]


def test_backtracking_takes_pieces_back():
    """A toy vocabulary where the longest match first is wrong."""
    e = piece_coding.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(4)
    letters = "etaoinshr"
    for _ in range(3000):
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 24)))
        assert e.pieces("▁" + w) == piece_coding.merge(list("▁" + w), e.scores)


def test_encode_documents(spark):
    import hashlib

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = list(enumerate(EDGES)) + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, n_tokens string")
    got = sorted(piece_coding.encode_documents(docs, path, digests=True).collect(), key=str)
    model = piece_coding.encoder(path).model
    want = []
    for doc, t in rows:
        ids = model.encode(t or "") + [2]
        dec = model.decode(ids)
        want.append((doc, len(ids), ids, dec, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(want, key=lambda w: str(type(got[0])(*w)) if False else str(got[0].__class__(**dict(zip(got[0].__fields__, w)))))]
    assert piece_coding.encode_documents(docs.limit(0), path).collect() == []


def test_words_are_cut_and_remembered(monkeypatch):
    """Between letters and other characters, exactly, and each part is encoded once however it is joined."""
    e = piece_coding.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    seen = []
    whole = e.codes
    monkeypatch.setattr(e, "codes", lambda unit: (seen.append(unit), whole(unit))[1])
    for t in ["zuqat zuqat. zuqat,\nzuqat", "zuqat) (zuqat zuqat.\nzuqat"]:
        assert e.encode(t) == e.model.encode(t) + [2]
    assert e.parts and seen.count("▁zuqat") == 1 and seen.count("zuqat") == 1 and not any("zuqat" in u.strip("▁") != "zuqat" for u in seen)
    for units, compounds, pairs in [(6, 3, 5), (300, 50, 100)]:
        monkeypatch.setattr(piece_coding, "UNITS", units)
        monkeypatch.setattr(piece_coding, "COMPOUNDS", compounds)
        monkeypatch.setattr(piece_coding, "PAIRS", pairs)
        e = piece_coding.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
        for t in [x or "" for x in EDGES] + texts(1500, 6) + ["x².y ²x. ½a", "_a_ 1a2", "word,word.\nword"]:
            assert e.encode(t) == e.model.encode(t) + [2]
        assert len(e.words) + len(e.inner) + len(e.older_words) + len(e.older_inner) <= units + 2 and len(e.compounds) <= compounds
