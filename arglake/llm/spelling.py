"""Grouping of spelling variants: words that are one insertion, deletion or replacement apart, by positional q-grams.

1. *Words.*  Runs of letters are coded by a dictionary of the task and counted in arrays; a task passes on its counts, so that
   a word of all texts reaches the sum once a task.
2. *Regions.*  Cut the shorter of two near words (or either, at equal lengths) in two: one edit leaves one half as it was, at
   the front or at the end.  Words meet in the region of a shared half, the other half being the segment that differs.  A
   region with more than REGION_ROWS entries is cut again, by the halves of its segments, until a segment is one code
   point long, where the alphabet bounds a region.  A pair that shares both halves counts in the first region only.
3. *Index.*  In a region segments are padded and indexed by their positional bigrams: (position, bigram) has a posting list of
   entries in order.  A probe merges the lists of its own bigrams through a heap, under the length and position limits that
   one edit allows, and keeps entries that share at least as many as an edit must leave (it destroys at most Q); these are verified.
4. *Forms.*  Each region gives a word's near count and best form; they are added up by word.  Roots spread from words without a
   form to the words that have them as form, a level at a time; counts double at each step, so there are few.

Edge cases: a null text has no words; an empty table, or one in which no word is frequent enough, gives an empty result; a deletion
may make a run empty or shorter than five, it then counts as no word; rows with the same id and text count
twice; a null id is written as an empty string in the hash; very long words are words like others.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.llm.common import lower_ascii, materialise, release

#: Length of a gram; an edit changes at most so many of a word's grams.
Q = 2
#: Least code points and occurrences of a word; a form has so many times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in so many loses a code point.
DAMAGE = 97
#: Entries of a region before it is cut; regions that are cut at once, at most (beyond, the former grows).
REGION_ROWS, CUT_REGIONS = 20_000, 1 << 16
#: Words that a task's dictionary holds before its counts are passed on.
DICTIONARY = 300_000

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


class _Counter:
    """Counts words of texts by codes in arrays."""

    def __init__(self):
        self.begin()

    def begin(self) -> None:
        self.code: dict[str, int] = {}
        self.crc, self.bytes, self.chars = [], [], []
        self.arrays = np.empty((3, 0), np.int64)
        self.total = np.zeros(0, np.int64)
        self.damaged: dict[str, int] = {}

    def codes(self, runs: list[str]) -> np.ndarray:
        known = self.code
        try:
            return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))
        except KeyError:
            for run in runs:
                if run not in known:
                    raw = run.encode()
                    known[run] = len(known)
                    self.crc.append(zlib.crc32(raw))
                    self.bytes.append(len(raw))
                    self.chars.append(len(run))
        return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))

    def properties(self) -> np.ndarray:
        """crc32, bytes and code points by code."""
        if self.crc:
            self.arrays = np.concatenate([self.arrays, np.array([self.crc, self.bytes, self.chars], np.int64)], 1)
            self.crc, self.bytes, self.chars = [], [], []
        return self.arrays

    def add(self, texts: list[tuple[str, str]]) -> None:
        """Count the texts of some (id, text)."""
        found = [(doc, self.codes(runs)) for doc, text in texts if (runs := _RUNS.findall(lower_ascii(text)))]
        crcs, sizes, chars = self.properties()
        names, whole = None, []
        for doc, codes in found:
            # crc32(a + b) is a's crc moved by the bytes of b, which depends on their number only, xor that of b
            start, lengths = zlib.crc32(f"{doc}:".encode()), sizes[codes]
            if (most := int(lengths.max())) < 200:
                moved = np.array([zlib.crc32(_ZEROS[:k], start) ^ _ZERO_CRC[k] for k in range(most + 1)], np.int64)[lengths]
            else:
                some, at = np.unique(lengths, return_inverse=True)
                moved = np.array([zlib.crc32(z, start) ^ zlib.crc32(z) for z in map(bytes, some.tolist())], np.int64)[at]
            h = moved ^ crcs[codes]
            hit = h % DAMAGE == 0
            if hit.any():
                names = names or list(self.code)
                for code, place in zip(codes[hit].tolist(), (h[hit] % chars[codes[hit]]).tolist()):
                    run = names[code]
                    run = run[:place] + run[place + 1 :]
                    if len(run) >= LEAST_LENGTH:
                        self.damaged[run] = self.damaged.get(run, 0) + 1
                codes = codes[~hit]
            whole.append(codes)
        if whole:
            counts = np.bincount(np.concatenate(whole), minlength=len(self.code))
            counts[: len(self.total)] += self.total
            self.total = counts

    def give(self) -> Iterator[pa.RecordBatch]:
        counts = self.total.tolist()
        rows = [(w, n) for w, n in zip(self.code, counts) if n] + list(self.damaged.items())
        self.begin()
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 20_000]), _COUNTS)], schema=_COUNTS)


_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)  # shorter runs never make a word
_ZEROS = bytes(200)
_ZERO_CRC = [zlib.crc32(_ZEROS[:k]) for k in range(200)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            counter.add([("" if d is None else d, t or "") for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
            if len(counter.code) + len(counter.damaged) > DICTIONARY:
                yield from counter.give()
    yield from counter.give()
    release()


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): damaged runs of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    rows = docs.select(F.col(id_column).cast("string").alias("doc"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _cut(entries: DataFrame) -> DataFrame:
    """Each entry in two regions: that of its segment's front half, and that of its end half (``tail``)."""
    front, long = F.floor(F.col("size") / 2).cast("int"), F.length("segment")
    end = F.col("size") - front

    def region(mark: int, shared):
        return F.xxhash64("region", F.lit(mark), "size", shared)

    pieces = F.array(
        F.struct(region(0, F.substring("segment", F.lit(1), front)).alias("region"), end.alias("size"), F.col("tail"), F.substring("segment", front + 1, long).alias("segment")),
        F.struct(region(1, F.substring("segment", long - end + 1, end)).alias("region"), front.alias("size"), F.lit(True).alias("tail"), F.substring("segment", F.lit(1), long - end).alias("segment")),
    )
    return entries.select(F.explode(pieces).alias("p"), "longer", "word", "n").select("p.*", "longer", "word", "n")


def regions(words: DataFrame, region_rows: int = REGION_ROWS) -> DataFrame:
    """(region, size, tail, segment, longer, word, n): every two near words meet in a region, with segments that are one edit
    apart; ``size`` is the length of the shorter segment, and entries with ``longer`` are probed only."""
    size = F.length("word")
    entries = words.select(F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer")))).alias("e"), "word", "n")
    entries = entries.select(F.lit(0).cast("long").alias("region"), "e.size", F.lit(False).alias("tail"), F.col("word").alias("segment"), "e.longer", "word", "n").where(F.col("size") >= LEAST_LENGTH)
    entries, done = materialise(_cut(entries), "spelling-entries"), []
    most = max(region_rows, entries.count() // CUT_REGIONS)
    while True:
        large = materialise(entries.groupBy("region", "size").count().where((F.col("count") > most) & (F.col("size") > 1)).select("region", "size"), "spelling-large")
        if large.isEmpty():
            break
        large = F.broadcast(large)  # of CUT_REGIONS rows at most
        done.append(entries.join(large, ["region", "size"], "left_anti"))
        entries = materialise(_cut(entries.join(large, ["region", "size"], "left_semi").select(entries.columns)), "spelling-entries")
    for d in done:
        entries = entries.unionByName(d)
    return entries


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, no shorter than ``a`` and not equal to it, is one insertion or replacement away."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) > n else a[i + 1 :] == b[i + 1 :]


class _Region:
    """Positional bigram index of a region's segments."""

    def __init__(self):
        self.postings: dict[tuple[int, str], list[int]] = {}
        self.entries: list[list] = []  # [word, n, segment, near words, best count, best word]

    def grams(self, segment: str) -> list[tuple[int, str]]:
        padded = f"\0{segment}\0"
        return [(i, padded[i : i + Q]) for i in range(len(padded) - Q + 1)]

    def candidates(self, grams: list[tuple[int, str]], longer: bool) -> Iterator[int]:
        """Entries that share so many grams, at the same place or (if the probe is one longer) one before, as one edit must leave."""
        least = len(grams) - Q
        if least <= 0:  # segments of one code point: the alphabet bounds them
            yield from range(len(self.entries))
            return
        get = self.postings.get
        lists = [p for g in grams if (p := get(g))]
        if longer:
            lists += [p for i, g in grams if (p := get((i - 1, g)))]
        if len(lists) < least:
            return
        last, n = -1, 0
        for i in heapq.merge(*lists):
            if i != last:
                last, n = i, 0
            n += 1
            if n == least:
                yield i

    def probe(self, word: str, n: int, segment: str, longer: bool, tail: bool) -> list:
        """The probe's entry [word, n, segment, near words, best count, best word], the others' being brought up to date."""
        grams, own = self.grams(segment), [word, n, segment, 0, 0, None]
        for i in self.candidates(grams, longer):
            e = self.entries[i]
            # segments of which one begins with the other also meet in the region of the shared front half
            if one_edit(e[2], segment) and not (tail and longer and segment.startswith(e[2])):
                for x, y in ((own, e), (e, own)):
                    x[3] += 1
                    if y[1] > x[4] or y[1] == x[4] and y[0] < x[5]:
                        x[4], x[5] = y[1], y[0]
        if not longer:
            for g in grams:
                self.postings.setdefault(g, []).append(len(self.entries))
            self.entries.append(own)
        return own


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by region, the shorter segments first."""
    at, region, done = None, _Region(), []

    def given(least: int):
        if len(done) >= least:
            columns = list(zip(*done))
            done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)

    for b in batches:
        for key, size, tail, segment, longer, word, n in zip(*(c.to_pylist() for c in b.columns)):
            if (key, size) != at:
                done.extend((e[0], *e[3:]) for e in region.entries if e[3])
                yield from given(5000)
                at, region = (key, size), _Region()
            own = region.probe(word, n, segment, longer, tail)
            if longer and own[3]:
                done.append((own[0], *own[3:]))
    done.extend((e[0], *e[3:]) for e in region.entries if e[3])
    yield from given(1)
    release()


def near_words(words: DataFrame, region_rows: int = REGION_ROWS) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near words; ``form`` is the one of most occurrences, the smallest of equals."""
    entries = regions(words, region_rows)
    dealt = entries.repartition("region", "size").sortWithinPartitions("region", "size", "longer", "word")
    found = dealt.select("region", "size", "tail", "segment", "longer", "word", "n").mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): from the words without a form down, a level at a time."""
    frontier = forms.where("form IS NULL").select("word", F.col("word").alias("root"))
    rest = forms.where("form IS NOT NULL").select("word", "form")
    levels = [frontier]
    while True:
        frontier = materialise(rest.join(frontier.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "spelling-roots")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", region_rows: int = REGION_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    words = materialise(word_counts(docs, id_column, text_column), "spelling-words")
    near = near_words(words, region_rows)
    formed = F.col("form_n") >= TIMES * F.col("n")
    known = words.join(near, "word", "left").select("word", F.when(formed, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"))
    known = materialise(known, "spelling-forms")
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
occ AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))) AS h FROM occ),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM pairs GROUP BY word),
f AS (SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM w LEFT JOIN near USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""
