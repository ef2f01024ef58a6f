import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arglake.llm import common, exact_dedup, jaccard_join, suffix_dedup

SCHEMA = "doc_id long, text string, key string, n int, row string, keep_id string"


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(a, b, "k", 1, "r", "x") for a, b in rows], SCHEMA)


def exact_rows():
    r = random.Random(1)
    base = ["a b", "a  b", "a\tb\n", "", None, "  ", "\n", "x" * 20_000, "é ü", "É ü"] + [f"text {i}" for i in range(20)]
    rows = [(i, r.choice(base)) for i in range(300)] + [(5, "same row")] * 3 + [(7, "text 1")] * 2 + [(None, "a b"), (None, "only null"), (None, "only null")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, bits):
    rows = exact_rows()
    got = exact_dedup.exact_duplicates(frame(spark, rows), key_bits=bits, capacity=8).collect()
    groups = defaultdict(list)
    for doc, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(doc)
    want = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            first = i == least and not kept
            kept |= first
            want[(i, least, len(ids), first, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_rows_and_empty(spark):
    docs = frame(spark, exact_rows())
    kept = exact_dedup.distinct_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_dedup.exact_duplicates(docs).where("kept").count()
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_directory_doubles_where_buckets_are_full():
    counts = {(16, 0): 10, (16, 1): 10, (16, 1 << 15): 3}
    depth, entries = exact_dedup.build_directory(counts, 12)
    assert depth == 16 and len(entries) == 1 << 16
    assert entries[0][0] != entries[1][0] and entries[-1] == entries[1 << 15] and entries[-1][1] == 1
    assert exact_dedup.build_directory({(2, 1): 10**9}, 12)[0] == 2  # equal keys cannot be split: they chain
    assert exact_dedup.build_directory({}, 12) == (0, [(0, 0)])


def test_directory_is_counted_as_deep_as_needed_over_distinct_keys(spark):
    close = [(1 << 40) + (i << 20) for i in range(40)]  # alike in their first 23 bits
    keys = spark.createDataFrame([(k,) for k in close * 3 + [-(2**62)] * 500], "key long")
    counts, capacity = exact_dedup._prefix_counts(keys, 8, 64)
    assert sum(counts.values()) == 41 and max(counts.values()) <= 8 == capacity
    depth, entries = exact_dedup.build_directory({(d - 20, k & ((1 << (d - 20)) - 1)): n for (d, k), n in counts.items() if d > 20}, 8)
    assert len(entries) == 1 << depth


def test_large_groups_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    test_exact_dedup(spark, 64)


# --- suffixes ---------------------------------------------------------------------------------------


def brute_repeats(rows, length=suffix_dedup.LENGTH):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for doc, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[(doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def suffix_rows(seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [text(80) for _ in range(6)]
    rows = []
    for i in range(120):
        t = text(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            p, j = r.choice(passages), r.randint(0, len(t))
            k = r.randint(0, len(p) // 2)
            t = t[:j] + p[k : k + r.randint(100, 600)] + t[j:]
        if r.random() < 0.1:
            t = r.choice(["ab", "a", "zyx"]) * r.randint(50, 400)
        rows.append((i, t))
    long = text(60_000)
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, rows[4][1] + "x"), (203, None), (204, ""), (204, ""), (205, rows[7][1]), (205, rows[7][1]), (None, rows[9][1]), (None, rows[10][1]), (-1, rows[11][1]), (300, "\0" * 500), (301, "q\0" * 300), (302, long), (303, long[150_000:152_000])]
    return rows


def test_suffix_dedup_of_one_row_many_times(spark):
    row = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(i) for i in range(600))
    docs = frame(spark, [(1, row)] * 1500 + [(2, "other " * 100)])
    begun = time.time()
    got = suffix_dedup.remove_repeats(docs).collect()
    assert time.time() - begun < 30
    assert sum(r.n_bytes == r.n_removed == len(row) for r in got) == 1500 and len(got) == 1501


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_BUFFER", 256 if hot > 3 else 3)
    rows = suffix_rows()
    got = suffix_dedup.remove_repeats(frame(spark, rows))
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute_repeats(rows)
    one = got.where("n_removed > 0 and doc_id = 202").first()
    assert hashlib.sha256(one.kept).hexdigest() == one.kept_sha256 and sum(s.end - s.start for s in one.spans) == one.n_removed


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, []).limit(0)).collect() == []
    assert suffix_dedup.remove_repeats(frame(spark, [(1, "short"), (2, None)])).select("n_removed").collect() == [(0,), (0,)]


@pytest.mark.parametrize("seed", range(12))
def test_two_stage_sorting(seed):
    r = random.Random(seed)
    contexts = {bytes(r.choice(b"ab" if seed % 2 else b"abcdxyz") for _ in range(r.randint(200, 420))) for _ in range(8)}
    some = next(iter(contexts))
    contexts |= {some[:-1] + b"!", b"?" + some[1:], b"a" * 260, b"a" * 261, b"zyxw" * 60, b"yxwz" * 60}
    contexts = sorted(contexts, key=lambda c: r.random())
    windows = Counter(c[i : i + 200] for c in contexts for i in range(len(c) - 199))
    for c, flags in zip(contexts, suffix_dedup.repeated(contexts)):
        assert flags.tolist() == [windows[c[i : i + 200]] > 1 for i in range(len(c) - 199)]


# --- Jaccard ----------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = common.words(common.lower_ascii(t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return Counter((doc, len(sets[i]), min(least[root(i)])) for i, (doc, _) in enumerate(rows))


def near_rows(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 30, 120, 300, 330, 900]))]
        for _ in range(r.choice([1, 2, 5, 20])):
            x = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            if r.random() < 0.3:
                x += [r.choice(vocabulary) for _ in range(int(len(x) * r.random() * 0.4))]
            rows.append((len(rows) * 3 % 1009, ("  ".join(x)).upper() if r.random() < 0.2 else " ".join(x)))
    return rows + [(5001, None), (5002, ""), (5003, "  "), (5004, "a"), (5005, "A"), (5006, "a b"), (12, rows[0][1])]


@pytest.mark.parametrize("way", [{}, {"cell_sets": 1}, {"cell_sets": 2, "pivots": 3, "joined": 2}, {"cell_sets": 3, "pivots": 2, "joined": 1, "levels": 1}])
@pytest.mark.parametrize("slice_", [256, 2])
def test_jaccard_join(spark, monkeypatch, way, slice_):
    monkeypatch.setattr(jaccard_join, "SLICE", slice_)
    monkeypatch.setattr(jaccard_join, "VISITORS", slice_)
    monkeypatch.setattr(jaccard_join, "HOT", 64 if slice_ > 2 else 3)
    rows = near_rows()
    got = jaccard_join.link_components(frame(spark, rows), **way).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def dense_sets(seed, n=60):
    """Sets around a few centres, at distances on either side of the threshold, some of them far from all others."""
    r = random.Random(seed)
    out = []
    for c in range(4):
        centre = [c * 10_000 + i for i in range(60)] + list(range(5, 20))
        for _ in range(n // 4):
            x = list(centre)
            for _ in range(r.choice([1, 3, 5, 7, 9, 12, 20, 40])):
                x[r.randrange(len(x))] = r.randrange(100_000, 100_400)
            out.append(np.unique(np.array(x, np.uint64)))
    return list({x.tobytes(): x for x in out}.values())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("way", [(200, 256, 512, 6), (4, 256, 512, 6), (1, 256, 8, 6), (3, 4, 4, 2), (8, 8, 3, 1)])
def test_voronoi_cells_lose_no_link(spark, monkeypatch, seed, way):
    """Sets of one region, whatever the number of pivots, the recursion, or blocks at its end."""
    monkeypatch.setattr(jaccard_join, "SLICE", 16)
    sets = dense_sets(seed)
    members = spark.createDataFrame([(7, True, False, i, bytearray(x.tobytes())) for i, x in enumerate(sets)], jaccard_join._MEMBERS)
    links = [(r.a, r.b) for r in jaccard_join._region_links(members, *way).collect()]
    similar = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    want, got = jaccard_join.Classes(len(sets)), jaccard_join.Classes(len(sets))
    for a, b in links:
        got.unite(a, b)
    for i, x in enumerate(sets):
        for j in range(i):
            if similar(x, sets[j]):
                want.unite(i, j)
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]
    assert len({want.root(i) for i in range(len(sets))}) > 5


#: Shingles of lone pairs whose sizes lie on either side of PART_FROM or FULL, or between them.
ACROSS = [(300, 330), (316, 336), (319, 320), (252, 296), (255, 256), (250, 310), (260, 315), (256, 319)]


def lone_pairs(start=0):
    """Near copies, one text a beginning of the other, that share no shingle with any third text."""
    rows = []
    for i, sizes in enumerate(ACROSS):
        w = [f"p{start + i}x{j}" for j in range(400)]
        rows += [(start + 2 * i + k, " ".join(w[: n + 4])) for k, n in enumerate(sizes)]
    return rows


def test_jaccard_links_lone_pairs_across_the_spaces(spark):
    rows = lone_pairs()
    got = Counter(tuple(r) for r in jaccard_join.link_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    assert {c for _, _, c in got} == {2 * i for i in range(len(ACROSS))}


def test_pivots_keep_links_of_sets_that_touch_different_pivots():
    both, x_own, y_own = range(80), range(100, 110), range(200, 210)
    first, second, x, y = (np.array(sorted(s), np.uint64) for s in ([*y_own], [*x_own, *range(10)], [*both, *x_own], [*both, *y_own]))
    found = jaccard_join.Pivots([1, 2], [first, second])
    cells = [{c for c, *_ in found.place(key, s, True)[0]} for key, s in ((3, x), (4, y))]
    assert cells[0] & cells[1]


def test_jaccard_counts_everything_if_the_part_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 0.01)
    rows = near_rows(4)
    assert Counter(tuple(r) for r in jaccard_join.link_components(frame(spark, rows)).collect()) == brute_components(rows)


def test_jaccard_edges(spark):
    assert jaccard_join.link_components(frame(spark, []).limit(0)).collect() == []
    got = jaccard_join.link_components(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None)])).collect()
    assert Counter(tuple(r) for r in got) == Counter([(None, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)])
    docs = frame(spark, near_rows())
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components(near_rows())
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in want if d == c}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.label for x in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
