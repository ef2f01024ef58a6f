"""Text functions: words, corpus cleaning, spans, similarity."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arglake.functions import similarity
from arglake.functions.mojibake import repaired
from arglake.functions.similarity import fuzzy_span
from arglake.session import arrow_function

WORD = r"[\p{L}\p{N}_]+"
SPACES = r"(?U)\s"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- counting and small transforms ----------------------------------------------------------------


def word_count(c) -> Column:
    """Unicode words; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def token_count(c) -> Column:
    """White-space tokens; null and blank texts have none."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def multi_values(c, separator: str = ";") -> Column:
    """Trimmed, non-blank parts of a delimited text; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def value_set(c, separator: str = ";") -> Column:
    return F.array_distinct(multi_values(c, separator))


def multi_value_count(c, separator: str = ";") -> Column:
    """Parts including blank ones: 1 for an empty text, 0 for null."""
    return F.when(col(c).isNull(), 0).otherwise(F.size(F.split(col(c), separator, -1))).cast("long")


def first_value(c, separator: str = ";") -> Column:
    return F.trim(F.get(F.split(col(c), separator), 0))


def collapse_values(c) -> Column:
    """Array of texts to one ';'-joined text of the trimmed parts; an empty array is missing."""
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.trim(x)), ";"))


def last_segment(c, separator: str = "/") -> Column:
    return F.substring_index(col(c), separator, -1)


def extract_id(c, pattern: str) -> Column:
    """First group of ``pattern``, the raw value where it does not match."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, 1)).otherwise(col(c))


def year_word(c, newest: int = 2026) -> Column:
    """First number of 1-4 digits that stands alone, if it is in 1..newest; later numbers are not tried."""
    y = F.regexp_extract(col(c), r"\b(\d{1,4})\b", 1).try_cast("int")
    return F.when(y.between(1, newest), y)


def year_digits(c, oldest: int = 1500, newest: int = 2035) -> Column:
    """First four of all digits (three at least), if in oldest..newest."""
    d = F.regexp_replace(col(c), r"[^0-9]", "")
    y = F.substring(d, 1, 4).try_cast("int")
    return F.when((F.length(d) >= 3) & y.between(oldest, newest), y)


def year_number(c) -> Column:
    return F.trim(col(c)).try_cast("double").try_cast("int")


def hms(seconds) -> Column:
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def normalise_lines(c) -> Column:
    """Lines stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def normalise_paragraphs(c) -> Column:
    """White space inside each paragraph becomes one space; blank paragraphs go."""
    squeezed = F.transform(F.split(col(c), r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(squeezed, lambda x: x != ""), "\n\n")


def strip_code_fence(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def source_name(source, temperature, max_tokens, default_temperature: float = 0.0, default_tokens: int = 4096) -> Column:
    """``source (T:0.10, MT:4000)``, or just the source at default settings."""
    plain = (col(temperature) == default_temperature) & (col(max_tokens) == default_tokens)
    return F.when(plain, col(source)).otherwise(F.format_string("%s (T:%.2f, MT:%d)", col(source), col(temperature), col(max_tokens)))


# --- cleaning -------------------------------------------------------------------------------------


def dehyphenate(c) -> Column:
    broken = F.regexp_replace(col(c), r"(?U)-[?\s]\n{1,2}(\w+ *)", "$1\n")
    return F.regexp_replace(broken, r"(?U)-\s{1,2}(\w+ *)", "$1")


def newlines_to_spaces(c) -> Column:
    return F.regexp_replace(col(c), "\n", " ")


def stripped(c) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


_YEAR = r"[1-3][0-9]{3}"


def _heads(t: Column) -> Column:
    tokens = F.split(t, " ")
    dated = F.coalesce(F.get(tokens, 1), F.lit("")).rlike(_YEAR)
    return t.startswith("©") | ((t.startswith("r") | (F.get(tokens, 0) == "copyright")) & dated)


def drop_header(c) -> Column:
    """Lines of under 50 characters become empty if they begin with a copyright sign, or with ``r...`` or the word
    ``copyright`` (as written) before a token that holds four digits like a year's."""
    return F.when((F.length(col(c)) < 50) & _heads(stripped(c)), F.lit("")).otherwise(col(c))


def squeeze_spaces(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s\s+", " ")


CID = r"\(cid:[0-9]+\)"


def cid_share(c) -> Column:
    return F.when(F.length(col(c)) > 0, F.regexp_count(col(c), F.lit(CID)) * 8 / F.length(col(c))).otherwise(0.0)


def letter_share(c) -> Column:
    return F.when(F.length(col(c)) > 0, F.length(F.regexp_replace(col(c), "[^A-Za-z]", "")) / F.length(col(c))).otherwise(0.0)


def strip_edge_digits(c) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(c), r"(?U)^\d+", ""), r"(?U)\d+$", ""))


def remove_cids(c) -> Column:
    return F.regexp_replace(col(c), CID, "")


# Characters and what replaces them before normalisation.
PLAIN = {"\u00a0": " ", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00ad": "-", "\u2014": "-", "\u00b7": "*"}


def plain_characters(c) -> Column:
    out = F.regexp_replace(col(c), r"(?U)\Bß", "ss")
    return F.translate(out, "".join(PLAIN), "".join(PLAIN.values()))


@arrow_function("string")
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition (no built-in function has it)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t), na_action="ignore")


# Letters with the accent that conversion leaves behind them, and the letters they make.
ACCENTS = {
    "a\u00b4": "á", "e\u00b4": "é", "i\u00b4": "í", "o\u00b4": "ó", "u\u00b4": "ú", "A\u00b4": "Á", "E\u00b4": "É", "I\u00b4": "Í", "O\u00b4": "Ó", "U\u00b4": "Ú",
    "a\u00a8": "ä", "e\u00a8": "ë", "i\u00a8": "ï", "o\u00a8": "ö", "u\u00a8": "ü", "A\u00a8": "Ä", "E\u00a8": "Ë", "I\u00a8": "Ï", "O\u00a8": "Ö", "U\u00a8": "Ü",
    "a^": "â", "e^": "ê", "i^": "î", "o^": "ô", "u^": "û", "A^": "Â", "E^": "Ê", "I^": "Î", "O^": "Ô", "U^": "Û",
    "a`": "à", "e`": "è", "i`": "ì", "o`": "ò", "u`": "ù", "A`": "À", "E`": "È", "I`": "Ì", "O`": "Ò", "U`": "Ù",
    "a~": "ã", "o~": "õ", "n~": "ñ", "A~": "Ã", "O~": "Õ", "N~": "Ñ",
}
_LONE = re.compile("|".join(re.escape(x) for x in ACCENTS))
_MARKS = re.compile("[\u0300-\u036f\u00a8\u02c0-\u02df]")


def compose_accents(text: str) -> str:
    """A letter and the accent behind it become one letter; combining marks and spacing modifiers that are left go."""
    return _MARKS.sub("", _LONE.sub(lambda m: ACCENTS[m[0]], text))


@arrow_function("string")
def drop_diacritics(texts: pd.Series) -> pd.Series:
    return texts.map(compose_accents, na_action="ignore")


@arrow_function("string")
def _normalised(texts: pd.Series) -> pd.Series:
    """``nfkc`` and ``drop_diacritics`` at once."""
    return texts.map(lambda t: compose_accents(unicodedata.normalize("NFKC", t)), na_action="ignore")


def clean_paragraphs(paragraphs) -> Column:
    """T2-T4 of each paragraph of an array, T5-T7 drop some, T8 and T9 of the others.

    Each step is an array of its own: inside one function of an element nothing is shared, so that what a later step names
    twice would be computed twice.
    """
    lines = F.transform(col(paragraphs), lambda p: newlines_to_spaces(p))
    bare = F.transform(lines, lambda p: F.struct(p.alias("p"), F.when(F.length(p) < 50, stripped(p)).alias("t")))
    squeezed = F.transform(bare, lambda x: squeeze_spaces(F.when(_heads(x["t"]), F.lit("")).otherwise(x["p"])))
    kept = F.filter(squeezed, lambda t: (F.length(t) >= 2) & (cid_share(t) <= 0.1) & (letter_share(t) >= 0.4))
    return F.transform(kept, lambda t: remove_cids(strip_edge_digits(t)))


def clean_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", separator: str = "\n\n") -> DataFrame:
    """(id, text): the cleaned text, paragraphs joined by blank lines; one Arrow function (NFKC and accents) for each document, the rest built in."""
    paragraphs = clean_paragraphs(F.split(dehyphenate(F.coalesce(F.col(text_column), F.lit(""))), separator))
    joined = F.array_join(F.transform(paragraphs, lambda p: plain_characters(p)), "\n\n")
    cleaned = docs.select(F.col(id_column), _normalised(joined).alias("text"))
    return cleaned.select(id_column, F.array_join(F.filter(F.split("text", "\n\n"), lambda p: p != ""), "\n\n").alias("text"))


# --- mojibake -------------------------------------------------------------------------------------


@arrow_function("string")
def fix_mojibake(texts: pd.Series) -> pd.Series:
    """Texts in which UTF-8 was read by a one-byte code, in parts or several times, as they were."""
    return texts.map(repaired, na_action="ignore")


# --- spans and similarity -------------------------------------------------------------------------

SENTENCES = "array<struct<start:int,end:int,text:string>>"


def sentence_spans(text: str | None) -> list[dict]:
    """Sentences of each line with their half-open offsets."""
    out, cursor = [], 0
    for line in (text or "").splitlines():
        for s in re.split(r"(?<=[.?!])\s+", line.strip()):
            if s:
                start = text.find(s, cursor)
                cursor = start + len(s)
                out.append({"start": start, "end": cursor, "text": s})
    return out


@arrow_function(SENTENCES)
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(sentence_spans)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """2 * LCS / (len a + len b); 0 if either is blank."""
    if not a or not b or not a.strip() or not b.strip():
        return 0.0
    return 1.0 if a == b else 2 * lcs_length(a, b) / (len(a) + len(b))


@arrow_function("double")
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(similarity.ratios(a.tolist(), b.tolist()))


def fuzzy_ratio_from(least: float):
    """``fuzzy_ratio`` for a filter: ratios under ``least`` may come out as 0."""

    @arrow_function("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(similarity.ratios(a.tolist(), b.tolist(), least))

    return ratio


def ratio_bound(a, b) -> Column:
    """An upper bound of the ratio from the lengths alone, to filter before the exact function."""
    la, lb = F.length(a), F.length(b)
    return F.try_divide(2 * F.least(la, lb), la + lb)


def exact_spans(text: str, document: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(re.escape(text), document)] if text else []


@arrow_function("array<struct<start:int,end:int>>")
def resolve_spans(texts: pd.Series, documents: pd.Series) -> pd.Series:
    """Places of a text in a document: all exact ones, else the best fuzzy one."""

    def find(t, d):
        if not t or not d:
            return []
        spans = exact_spans(t, d) or [s for s in [fuzzy_span(t, d)] if s]
        return [{"start": a, "end": z} for a, z in spans]

    return pd.Series([find(t, d) for t, d in zip(texts, documents)])


def joined_spans(document, spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.substring(col(document), s.start + 1, s.end - s.start)), " ... ")


def contains_any(c, stems: list[str]) -> Column:
    return F.lower(col(c)).rlike("|".join(map(re.escape, stems)))


def matched_terms(c, stems: list[str]) -> Column:
    """Distinct stems in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("(" + "|".join(stems) + ")"), F.lit(1)))


def in_source(text, source) -> Column:
    """Whether a quote is in its source, white space squeezed, or without white space and case."""
    squeeze = lambda x: F.regexp_replace(col(x), r"\s+", " ")
    bare = lambda x: F.lower(F.regexp_replace(col(x), r"\s+", ""))
    return F.contains(squeeze(source), F.trim(squeeze(text))) | F.contains(bare(source), bare(text))


def replace_all(c, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), col(c))
