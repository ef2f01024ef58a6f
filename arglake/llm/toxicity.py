"""Toxicity by a weighted lexicon.

Text is folded character by character (lower case, homoglyphs of other scripts, digits and signs that
stand for letters), so places in the folded text are places in the text.  One Aho-Corasick pass finds
the lexicon's terms: whole words, or word beginnings (for languages that compound).  Matches inside an
exception phrase do not count.  The score is a logistic function of the matched weight and of that
weight per word.

Terms, weights, exceptions and the logistic function are learned from labelled rows: a term must be
found almost only in toxic texts and often enough that chance does not explain it.  At most about
MAX_LABELLED labelled rows are used, chosen by a hash of their id; everything else covers all rows.

Edge cases: null counts as empty, and an empty text gets the score of no match; rows without a label
(or a null one) are not learned from; no terms are built in, so without labelled rows only
a caller's own terms count and nothing is found if there are none; an empty table gives an empty result; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.llm.common import crc_of_id, strings, words

#: Labelled rows that are learned from, about.
MAX_LABELLED = 20_000
#: Share of a term's texts that must be toxic, the share at which longer terms are not looked for, and how unlikely so many
#: toxic texts must be by chance (natural logarithm).
PRECISION, SURE, CHANCE = 0.6, 0.9, 14.0
#: Word beginnings that may become terms.
BEGINNINGS = range(3, 9)

# Look-alike letters of other scripts, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ł": "l", "ø": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "+": "t"}
#: One letter stands for both where a digit may mean either.
SAME = {"l": "i"}


def _table() -> dict[int, str]:
    table = {}
    for a, b in HOMOGLYPHS.items():
        for x in {a, a.upper()}:
            if len(x) == 1:
                table[ord(x)] = b
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        table[c] = chr(c - 0xFEE0).lower()
    for c in range(65, 91):
        table[c] = chr(c + 32)
    for c in [*range(0xC0, 0xDF), *range(0x100, 0x250), *range(0x370, 0x530)]:
        low = chr(c).lower()
        if len(low) == 1 and low != chr(c):
            table.setdefault(c, HOMOGLYPHS.get(low, low))
    table[0x130] = "i"
    table |= {ord(a): b for a, b in SIGNS.items()}
    for c, b in [*table.items()]:
        table[c] = SAME.get(b, b)
    table |= {ord(a): b for a, b in SAME.items()}
    return table


_FOLD = _table()


def fold(text: str) -> str:
    """As long as ``text``, letter for letter."""
    return text.translate(_FOLD)


_EDGES = re.compile(r"^\W+|\W+$")


def _word_forms(text: str) -> set[str]:
    """Folded words without the signs at their ends."""
    return {fold(w) for w in {_EDGES.sub("", w) for w in set(words(text))} if w}


@dataclass
class Lexicon:
    """Weighted terms: ``word`` terms are whole words, ``start`` terms are word beginnings; all folded."""

    word: dict[str, float] = field(default_factory=dict)
    start: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: score = logistic(bias + a * log1p(weight) + b * log1p(100 * weight / words))
    curve: tuple[float, float, float] = (-3.0, 2.0, 0.5)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        terms: dict[str, list] = {}
        for kind, source in (("w", lexicon.word), ("s", lexicon.start)):
            for t, weight in source.items():
                terms.setdefault(t, []).append((kind, weight))
        for t in lexicon.exceptions:
            terms.setdefault(fold(t), []).append(("x", 0.0))
        self.automaton = ahocorasick.Automaton()
        for t, kinds in terms.items():
            self.automaton.add_word(t, (len(t), kinds))
        if terms:
            self.automaton.make_automaton()
        self.empty = not terms

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms that count; at one start the longest."""
        if self.empty:
            return []
        n, found, spared = len(text), {}, []
        for last, (length, kinds) in self.automaton.iter(fold(text)):
            start, end = last - length + 1, last + 1
            if start and text[start - 1].isalnum():
                continue
            for kind, weight in kinds:
                if kind == "s" or end == n or not text[end].isalpha():
                    if kind == "x":
                        spared.append((start, end))
                    elif start not in found or found[start][0] < end:
                        found[start] = (end, weight)
        if spared:
            found = {s: (e, w) for s, (e, w) in found.items() if not any(a <= s and e <= z for a, z in spared)}
        return [(s, e, w) for s, (e, w) in found.items()]

    def features(self, text: str) -> tuple[float, float]:
        weight = sum(w for _, _, w in self.matches(text))
        if not weight:
            return 0.0, 0.0
        return math.log1p(weight), math.log1p(100 * weight / max(1, len(words(text))))

    def score(self, text: str) -> float:
        x, y = self.features(text)
        bias, a, b = self.lexicon.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * x + b * y))))


# --- learning -------------------------------------------------------------------------------------


def labelled_rows(docs: DataFrame, labels: DataFrame, training, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, toxic of about ``most`` labelled rows for which ``training`` holds (by a hash of the id)."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > most:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # labels: at most about ``most`` rows


def _counted(rows: DataFrame, forms) -> DataFrame:
    """(term, n): in how many rows each term is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in strings(b.column(0)):
                n.update(forms(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _terms_of(text: str) -> set[str]:
    """Whole words end in a blank, word beginnings in a hyphen."""
    out = set()
    for w in _word_forms(text):
        if len(w) > 2:
            out.add(w + " ")
            out.update(w[:k] + "-" for k in BEGINNINGS if k < len(w))
    return out


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms with weights (log odds).

    A term that is SURE stands for all longer ones, but is lengthened while a longer one has nearly all of its
    texts; a less precise one stands beside the longer ones, of which the longest that matches counts.
    """
    base = n_toxic / max(1, n_toxic + n_clean)

    def unlikely(n1: int, n: int) -> bool:
        """Chernoff bound of n1 or more toxic texts of n."""
        share = n1 / n
        if not 0 < base < share:
            return False
        far = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)
        return n * far >= CHANCE

    precision = {t: n / (n + clean.get(t, 0)) for t, n in toxic.items()}
    good = {t for t, n in toxic.items() if precision[t] >= PRECISION and unlikely(n, n + clean.get(t, 0))}
    children: dict[str, list[str]] = {}
    for t in good:
        body = t[:-1]
        parent = next((p for k in reversed(BEGINNINGS) if k < len(body) + (t[-1] == " ") and (p := body[:k] + "-") in good and p != t), "")
        children.setdefault(parent, []).append(t)
    out: dict[str, float] = {}
    queue = list(children.get("", []))
    while queue:
        t = queue.pop()
        while t[-1] == "-" and (longer := max(children.get(t, []), key=lambda x: (toxic[x], x[-1] == " ", x), default=None)) and toxic[longer] >= 0.95 * toxic[t]:
            t = longer
        n1, n0 = toxic[t], clean.get(t, 0)
        weight = math.log(((n1 + 0.5) / (n_toxic + 1)) / ((n0 + 0.5) / (n_clean + 1)))
        out[t] = min(6.0, max(0.5, weight))
        if precision[t] < SURE:
            queue += children.get(t, [])
    return out


def _may_be_chosen(n_toxic: int, n_clean: int):
    """PRECISION and CHANCE of ``choose_terms`` as a condition on n (toxic) and n0 (clean) texts, a little wider for rounding."""
    base = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < base < 1:
        return F.lit(False)
    n = F.col("n") + F.col("n0")
    share = F.col("n") / n
    far = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return (share >= PRECISION - 1e-9) & (share > base) & (n * far >= CHANCE - 1e-6)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.array([-3.0, 2.0, 0.5])
    prior = w.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * (w - prior)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, training, most: int = MAX_LABELLED, terms: dict[str, float] | None = None, exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon learned from the labelled rows for which ``training`` (a column of ``labels``) holds; a caller's own ``terms`` (whole
    words and their weights) and ``exceptions`` (phrases) come before it.  None are built in."""
    rows = labelled_rows(docs, labels, training, most)
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    frequent = _counted(rows.where("toxic = 1"), _terms_of).where(F.col("n") >= 5)
    counts = frequent.join(_counted(rows.where("toxic = 0"), _terms_of).select("term", F.col("n").alias("n0")), "term", "left")
    found = counts.select("term", "n", F.coalesce("n0", F.lit(0)).alias("n0")).where(_may_be_chosen(n_toxic, n_clean)).collect()
    chosen = choose_terms({r.term: r.n for r in found}, {r.term: r.n0 for r in found}, n_toxic, n_clean)
    words_ = {fold(t): w for t, w in (terms or {}).items()} | {t[:-1]: w for t, w in chosen.items() if t[-1] == " "}
    lexicon = Lexicon(words_, {t[:-1]: w for t, w in chosen.items() if t[-1] == "-"}, tuple(exceptions))
    lexicon.exceptions += tuple(_learned_exceptions(rows, lexicon))
    sample = rows.select("toxic", "text").mapInArrow(_featured(lexicon), "x double, y double, toxic int").collect()  # numbers of at most about ``most`` rows
    if n_toxic >= 5 and n_clean >= 5:
        lexicon.curve = _fit_curve(np.array([[r[0], r[1]] for r in sample]), np.array([r[2] for r in sample], float))
    return lexicon


def _featured(lexicon: Lexicon):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for b in batches:
            f = [m.features(t) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64()), b.column(0).cast(pa.int32())], names=["x", "y", "toxic"])

    return work


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of a term and its neighbour that are found in at least 5 clean texts and hardly in toxic ones."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        n: Counter = Counter()
        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                seen = set()
                for s, e, _ in m.matches(t):
                    end = next((i for i in range(e, min(len(t), e + 40)) if not t[i].isalnum()), e)
                    before, after = words(t[max(0, s - 40) : s])[-1:], words(t[end : end + 40])[:1]
                    term = fold(t[s:end])
                    if before:
                        seen.add(fold(before[0]) + " " + term)
                    if after:
                        seen.add(term + " " + fold(_EDGES.sub("", after[0])))
                for p in seen:
                    n[p, toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([t for _, t in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["pair", "toxic", "n"])

    found = rows.select("toxic", "text").mapInArrow(pairs, "pair string, toxic int, n long").groupBy("pair").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("n").alias("all"))
    return [r[0] for r in found.where("clean >= 5 AND clean >= 0.8 * all").orderBy(F.desc("clean"), "pair").collect()]


def score(docs: DataFrame, lexicon: Lexicon, spans: bool = True) -> DataFrame:
    """doc_id, score and, if ``spans``, the matched places as an array of (start, end, weight)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())] + [("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])))] * spans)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for b in batches:
            texts = strings(b.column(1))
            columns = [b.column(0), pa.array([m.score(t) for t in texts], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": s, "end": e, "weight": w} for s, e, w in m.matches(t)] for t in texts], schema.field("spans").type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, score double" + ", spans array<struct<start:int,end:int,weight:double>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ddl)


def clean_rows(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; one pass without a shuffle."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = lexicon.matcher()
        for t in texts:
            yield pd.Series([m.score(x or "") for x in t], dtype="float64")

    return docs.where(scores(F.col("text")) < threshold)


def training_rows(folds: int = 4, held: int = 2):
    """Whether a row's labels may be learned: crc32(doc_id as text) mod ``folds`` is not ``held``."""
    return F.pmod(crc_of_id(), F.lit(folds)) != held


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only from rows that are not held out."""
    fold_of = F.pmod(crc_of_id(), F.lit(folds))
    lexicon = learn(docs, labels, training_rows(folds, held))
    out = score(docs, lexicon, spans=False)
    return out.select("doc_id", F.coalesce(fold_of == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
