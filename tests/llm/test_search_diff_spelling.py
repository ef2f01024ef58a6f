"""Nearest neighbours, snapshot difference and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arglake.llm import cross_polytope, snapshot_diff, spelling

# ---- nearest neighbours


def nearest(rows, k, every):
    """{(query id, rank): (id, score)} by comparing everything."""
    good = {(i, tuple(float(x) + 0.0 for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q % every == 0:
            scores = defaultdict(lambda: -np.inf)
            for i, u in good:
                if i != q and len(u) == len(v):
                    scores[i] = max(scores[i], sum(a * b for a, b in zip(u, v)))
            for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1):
                out[q, r] = i, s
    return out


def searched(df, **options):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in cross_polytope.search(df, **options).collect()}


def same(found, want):
    assert found.keys() == want.keys()
    for k, (i, s) in want.items():
        assert found[k][0] == i and found[k][1] == pytest.approx(s, abs=1e-9), k


def test_all_buckets_give_the_exact_answer(spark):
    """With a target of 1 over all queries the probes reach every true neighbour; lengths differ, so vectors are lifted."""
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) * (1 + i % 3) for _ in range(6)]) for i in range(120)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # a vector of many ids, queries among them
    rows += [(7, rows[7][1]), (None, rows[0][1]), (200, None), (220, []), (240, [0.0] * 6), (260, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (280, [float("nan")] * 6), (300, [float("inf")] * 6)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [-0.0, 1.0])]  # another width, fewer than k
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, class string, rank int")
    want = nearest(rows, 5, 20)
    assert {q for q, _ in want} >= {0, 20, 400, 1000, 1020}
    same(searched(df, k=5, every=20, tables=4, sample=1000, target=1.0, slice_rows=16), want)


def test_short_answers_are_filled_by_a_scan(spark):
    """One probe finds too little; a query then visits all rows.  More turns in a hash, too."""
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = nearest([(r["vec_id"], list(r["embedding"])) for r in df.collect()], 59, 20)
    same(searched(df, k=80, every=20, tables=2, sample=1, target=0.0, bucket_rows=2), exact)


def test_recall(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(16)]) for i in range(1500)]
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = searched(df, k=10, every=50), nearest(rows, 10, 50)
    of = lambda x: {(q, i) for (q, _), (i, _) in x.items()}
    assert len(of(found) & of(want)) >= 0.9 * len(want)


def test_hash_parts():
    x = np.random.default_rng(1).normal(size=(5, 8))
    turned = cross_polytope.hadamard(cross_polytope.hadamard(x))
    assert np.allclose(turned, x) and np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert cross_polytope.axes_for(1000, 64) == (64,) and len(cross_polytope.axes_for(10**9, 64)) == 3
    h = cross_polytope.Hash(8, (8, 2), 3.0, tables=2)
    units = h.unit(x, False)
    assert np.allclose(np.linalg.norm(units, axis=1), 1)
    assert (h.probes(units, 5)[:, :1] == h.codes(units)).any(axis=1).all()  # its own bucket is a vector's best


def test_no_vectors(spark):
    assert cross_polytope.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# ---- snapshot difference


def diff(old, new):
    """Brute force over (key, text, lang, source)."""
    h = lambda r: tuple((x is None, x or "") for x in r[1:])
    out, left, right = [], [], []
    for key in {r[0] for r in old + new}:
        a, b = ([r for r in s if r[0] == key] for s in (old, new))
        out += [("key", x, y) for x, y in zip(a, b)]
        left, right = left + a[len(b) :], right + b[len(a) :]
    for content in {r[1:3] for r in left + right}:
        up = lambda r: (r[0] is None, r[0] or 0)
        down = lambda r: (r[0] is None, -(r[0] or 0))
        a, b = sorted((r for r in left if r[1:3] == content), key=up), sorted((r for r in right if r[1:3] == content), key=down)
        n = min(len(a), len(b))
        out += [("content", x, y) for x, y in zip(a, b)] + [("delete", x, None) for x in a[n:]] + [("insert", None, y) for y in b[n:]]
    done = Counter()
    for how, a, b in out:
        changed = ",".join(c for c, x, y in zip(("text", "lang", "source"), a[1:], b[1:]) if x != y) if a and b else ""
        op = {"key": "update" if changed else "same", "content": "rekey"}.get(how, how)
        done[b[0] if b else a[0], a[0] if a else None, op, changed] += 1
    return done


def told(spark, old, new, **options):
    schema = "doc_id long, text string, lang string, source string, key string, part int, block int"
    frames = [spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema) for rows in (old, new)]
    found = snapshot_diff.snapshot_diff(*frames, "doc_id", ["text", "lang", "source"], ["text", "lang"], **options).collect()
    assert all((r["row_digest"] is None) == (r["op"] == "delete") for r in found)
    return Counter((r["key"], r["old_key"], r["op"], r["changed"]) for r in found)


def test_diff_with_a_hot_text(spark):
    random.seed(4)
    hot = [(i, "same", "en", "a") for i in random.sample(range(1000), 90)]
    rest = [(1000 + i, random.choice(["t", "u", None, ""]), random.choice(["en", None]), random.choice("ab")) for i in range(80)]
    old = hot + rest + [(None, "n", "en", "a"), (5000, None, None, None)]
    new = [(-1 - k if k % 3 else k, t, l, s if k % 5 else None) for k, t, l, s in hot[:70]] + [(k + (k % 2) * 500, t, l, "c") for k, t, l, s in rest] + [(None, "n", "en", "b"), (6000, None, None, None)]
    assert told(spark, old, new, part_rows=40, least_block=4) == diff(old, new)


def test_diff_repeated_keys_and_empty_snapshots(spark):
    rows = [(1, "a", "en", "x")] * 5 + [(2, "a", "en", "x"), (3, "b", None, None)]
    fewer = rows[:3] + rows[6:] + [(9, "a", "en", "x")]
    assert told(spark, rows, fewer) == diff(rows, fewer)
    assert told(spark, rows, rows) == Counter({(1, 1, "same", ""): 5, (2, 2, "same", ""): 1, (3, 3, "same", ""): 1})
    assert set(k[2] for k in told(spark, [], rows)) == {"insert"} and set(k[2] for k in told(spark, rows, [])) == {"delete"}
    assert told(spark, [], []) == Counter()


# ---- spelling variants


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters, out = sorted({c for w in counts for c in w}), {}
    for w, n in counts.items():
        near = sorted({x for x in edits(w, letters) if x in counts} - {w}, key=lambda x: (-counts[x], x))
        form = near[0] if near and counts[near[0]] >= 2 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def grouped(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df, **options).collect()}


@pytest.mark.parametrize("region_rows", [20_000, 3])
def test_spelling(spark, region_rows):
    random.seed(5)
    base = ["".join(random.choices("abé", k=random.randint(5, 8))) for _ in range(120)] + ["x" * 70 + c for c in "abc"] + ["aaaaa", "aaaaaa", "aabaa", "Äpfel", "äpfel", "ba" * 150]
    rows = [(i, " ".join(random.choices(base, weights=[1 + 40 * (j % 17 == 0) for j in range(len(base))], k=60)).replace("ab", "AB")) for i in range(60)]
    rows += [(1, None), (2, ""), (None, "aaaaa aaaaa"), (3, "12 ; -"), rows[0]]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 10
    assert grouped(df, region_rows=region_rows) == want


def test_one_edit():
    for a, b, yes in (("abc", "abd", True), ("abc", "abcd", True), ("abc", "xabc", True), ("abc", "acb", False), ("abc", "abdd", False), ("", "a", True), ("aab", "ab", None)):
        if yes is not None:
            assert spelling.one_edit(a, b) == yes


def test_no_words(spark):
    assert grouped(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert grouped(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")) == {}
