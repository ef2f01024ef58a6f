"""Quality rules with thresholds adapted to each language and source.

Every document gets counts (``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
``n_repeat_words``) and ratios made of them.  For each language and source a mergeable sketch of each
ratio is built over the documents that pass the base rule: the value's bucket on a logarithmic scale
(relative width 2 * ALPHA) and the number of documents in it.  Sketches merge by adding counts, so they
are built map-side, do not depend on the order of rows and hold a bounded number of buckets; a language's
sketch is the sum of its groups', the corpus' that of all.

Quartiles of a sketch give the group's fences, REACH spreads beyond them; a document outside any fence
of its group is not kept.  The spread is the distance of the quartiles, and for shares at least what
UNIT occurrences make in a short text of the group (the upper quartile of an occurrence over the denominator): less than
that cannot be told from chance.  A share is at most 1, so its fence bends: of the room between the quartile and 1 it takes
reach / sqrt(room^2 + reach^2), which is nearly the reach itself where that is small and never all of the room.  No cutoff is fixed.  Small groups lean on their language and languages on the corpus:
quartiles are averaged with those of the coarser sketch, which counts as PRIOR documents.

Edge cases: a null or empty text has no words and fails the base rule; null ``lang`` or ``source`` is a
group of its own; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arglake.llm.common import materialise, strings, words

#: Relative error of a sketch's quantiles.
ALPHA = 0.01
#: Values below this count as zero; values above the largest bucket fall into it.
TINY, LARGEST = 1e-4, 1e4
#: A fence lies so many spreads beyond the quartile.
REACH = 6.0
#: Occurrences in a short text that are within a spread.
UNIT = 2.0
#: Weight, in documents, of the language's quartiles in a group's, and of the corpus' in a language's.
PRIOR = 20.0
#: Groups up to which fences are broadcast to the documents.
BROADCAST_ROWS = 200_000
#: ratio: (numerator, denominator, what one occurrence adds to the numerator, 0 if the ratio is no share: then low values are fenced too)
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words", 0),
    "symbol_share": ("n_symbols", "word_chars", 1),
    "dup_line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", 6),  # a window that comes again
}
#: What is sketched: the ratios, and for shares the value of one occurrence.
SKETCHED = [*RATIOS, *(f"{r}_unit" for r, (_, _, step) in RATIOS.items() if step)]
_SYMBOL = re.compile(r"[#*$%&|<>]")
_COUNTS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_lines", pa.int64()), ("n_repeat_words", pa.int64())])


def repeat_words(found: list[str]) -> int:
    """Words inside a 3-word window that is found twice or more."""
    n = len(found) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    base = len(number)
    pair = ids[:-2] * base + ids[1:-1]
    if base >= 1 << 20:  # three numbers do not fit 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * base + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words."""
    found = words(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(found), sum(map(len, found)), len(_SYMBOL.findall(text)), dup, lines, repeat_words(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [counts(t) for t in strings(b.column(3))]
        n, chars, symbols, dup, lines, repeats = zip(*got) if got else ((),) * 6
        columns = [b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in (n, chars, symbols, dup, lines, repeats))]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def with_ratios(c: DataFrame) -> DataFrame:
    def share(a, b):
        return F.coalesce(a / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))

    ratios = [share(F.col(a), b).alias(r) for r, (a, b, _) in RATIOS.items()]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return c.select("*", *ratios, *(share(F.lit(step), b).alias(f"{r}_unit") for r, (_, b, step) in RATIOS.items() if step), base.alias("base_failed"))


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of all ratios for each group: keys, ratio, bucket, n."""
    gamma = (1 + ALPHA) / (1 - ALPHA)
    long = rows.select(*keys, F.stack(F.lit(len(SKETCHED)), *(x for r in SKETCHED for x in (F.lit(r), F.col(r)))).alias("ratio", "value"))
    bucket = F.when(F.col("value") < TINY, F.lit(-1_000_000)).otherwise(F.ceil(F.log(F.least("value", F.lit(LARGEST))) / float(np.log(gamma))))
    return long.groupBy(*keys, "ratio", bucket.cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles of each sketch: keys, ratio, a column for each entry of ``at``, and the documents in it (total)."""
    gamma = (1 + ALPHA) / (1 - ALPHA)
    group = Window.partitionBy(*keys, "ratio")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bucket") == -1_000_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    ranked = sketches.select(*keys, "ratio", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("total"))
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= q * F.col("total") - 1e-9, F.col("value"))).alias(name) for name, q in at.items()))


def thresholds(rows: DataFrame) -> DataFrame:
    """Fences of each (lang, source) of ``rows``: lang, source, then <ratio>_low and <ratio>_high.

    Tables here have a row for each group and ratio at most; only the sketches have their buckets beside.
    """
    own = materialise(sketch(rows, ["lang", "source"]), "quality-sketches")
    at = {"q1": 0.25, "q3": 0.75}

    def leaning(fine: DataFrame, coarse: DataFrame, on) -> DataFrame:
        weight = F.col("total") + PRIOR
        mixed = [((F.col("total") * F.col(q) + PRIOR * F.col(f"c_{q}")) / weight).alias(q) for q in at]
        coarse = coarse.select(*[F.col(c).alias(f"c_{c}") for c in coarse.columns])
        return fine.join(coarse, on).select(*[c for c in fine.columns if c not in at], *mixed)

    whole = quantiles(merged(own, []), [], at)
    of_lang = leaning(quantiles(merged(own, ["lang"]), ["lang"], at), whole, F.col("ratio") == F.col("c_ratio"))
    of_group = leaning(quantiles(own, ["lang", "source"], at), of_lang, (F.col("ratio") == F.col("c_ratio")) & F.col("lang").eqNullSafe(F.col("c_lang")))
    value = {x: {q: F.max(F.when(F.col("ratio") == x, F.col(q))) for q in at} for x in SKETCHED}
    fences = []
    for r, (_, _, step) in RATIOS.items():
        spread = value[r]["q3"] - value[r]["q1"]
        if not step:
            fences.append((value[r]["q1"] - REACH * spread).alias(f"{r}_low"))
            fences.append((value[r]["q3"] + REACH * spread).alias(f"{r}_high"))
        else:
            reach = REACH * F.greatest(spread, UNIT * value[f"{r}_unit"]["q3"])
            room = 1 - value[r]["q3"]
            fences.append((value[r]["q3"] + room * reach / F.sqrt(room * room + reach * reach)).alias(f"{r}_high"))
    return of_group.groupBy("lang", "source").agg(*fences)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ratios, fences and the verdict for each document (a group without a document that passes the base rule has no fences)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(_count, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long")
    rows = with_ratios(materialise(rows, "quality-counts"))
    fences = materialise(thresholds(rows.where("not base_failed")).withColumnsRenamed({"lang": "l", "source": "s"}), "quality-fences")
    if fences.count() <= BROADCAST_ROWS:  # a row a group: a hot group is not shuffled
        fences = F.broadcast(fences)
    out = rows.join(fences, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    failed = F.lit(False)
    for name, (_, _, step) in RATIOS.items():
        if not step:
            failed = failed | (F.col(name) < F.col(f"{name}_low"))
        failed = failed | (F.col(name) > F.col(f"{name}_high"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(failed, F.lit(False)))
