import random

import pytest
from pyspark.sql import functions as F

from arglake.functions import similarity
from arglake.functions import text as T
from arglake.functions.mojibake import repaired


def one(spark, value, f, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(f("x")).first()[0]


@pytest.mark.parametrize(("value", "a", "b", "c"), [("2004", 2004, 2004, 2004), ("2004.0", 2004, 2004, 2004), ("forthcoming", None, None, None), ("c. 350 BCE", 350, None, None), ("0 or 1999", None, None, None), ("", None, None, None), (None, None, None, None)])
def test_years(spark, value, a, b, c):
    assert one(spark, value, T.year_word) == a
    assert one(spark, value, T.year_digits) == b
    assert one(spark, value, T.year_number) == c


@pytest.mark.parametrize(("value", "count", "values"), [(None, 0, []), ("", 1, []), ("A", 1, ["A"]), ("A; B", 2, ["A", "B"]), ("A;;B", 3, ["A", "B"]), ("A;", 2, ["A"])])
def test_multi_values(spark, value, count, values):
    assert one(spark, value, T.multi_value_count) == count
    assert one(spark, value, T.multi_values) == values


def test_cleaning(spark):
    assert one(spark, "well-\nknown fact", T.dehyphenate) == "wellknown fact"
    for head in ("© 2010 Someone", "r 1999", "copyright 2004 x"):
        assert one(spark, head, T.drop_header) == ""
    assert one(spark, "r text 1999", T.drop_header) == "r text 1999"
    assert one(spark, "12 text 34", T.strip_edge_digits) == "text"
    assert one(spark, "a (cid:12) b", T.remove_cids) == "a  b"
    assert one(spark, "(cid:1)(cid:2)", T.cid_share) > 0.1
    assert one(spark, "ab12345678", T.letter_share) == pytest.approx(0.2)
    assert one(spark, "Straße “x” y", T.plain_characters) == 'Strasse "x" y'
    assert one(spark, "a^ e\u0301", T.drop_diacritics) == "â e"
    assert one(spark, "e` a^ n~ x^2 b~c O\u00b4 U\u00a8 z\u00a8", T.drop_diacritics) == "è â ñ x^2 b~c Ó Ü z"
    for kept in ("Copyright 2004 x", "r text 1999", "copyright x 2004", "a 2004", "©" + "x" * 50):
        assert one(spark, kept, T.drop_header) == kept
    for gone in ("copyright 12004 x", "  © me", "r2d2 x1999y z", "run 2004"):
        assert one(spark, gone, T.drop_header) == ""
    assert one(spark, "ﬁx", lambda c: T.nfkc(F.col(c))) == "fix"


def test_clean_documents(spark):
    text = "Proper para-\ngraph of text here.\n\n© 2010 Someone\n\n1234567890 a\n\n(cid:1)(cid:2)(cid:3)\n\n\n\n12 Another ﬁne paragraph 7\n\n3 (cid:9) voila` un pin~on with a long enough tail of letters and a few more words behind"
    got = {r.doc_id: r.text for r in T.clean_documents(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert got == {1: "Proper paragraph of text here.\n\nAnother fine paragraph\n\n voilà un piñon with a long enough tail of letters and a few more words behind", 2: "", 3: ""}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 70))) for _ in range(2))
        assert T.lcs_length(a, b) == lcs(a, b)
        x = T.indel_ratio(a, b)
        assert 0 <= x <= 1 and x == T.indel_ratio(b, a) and (x == 1) == (a == b and bool(a))
    assert T.indel_ratio("", "a") == T.indel_ratio(" ", "a") == T.indel_ratio(None, "a") == 0


def test_spans():
    doc = "The cat sat. The cat sat on a mat! Why?\nNew line here."
    for s in T.sentence_spans(doc):
        assert doc[s["start"] : s["end"]] == s["text"]
    assert [s["text"] for s in T.sentence_spans(doc)] == ["The cat sat.", "The cat sat on a mat!", "Why?", "New line here."]
    assert T.exact_spans("The cat", doc) == [(0, 7), (13, 20)]
    start, end = T.fuzzy_span("a mut! Why", doc)
    assert T.indel_ratio("a mut! Why", doc[start:end]) >= 0.85
    assert T.fuzzy_span("zzzz", doc) is None


def test_spans_by_brute_force():
    r = random.Random(2)
    for _ in range(100):
        doc = "".join(r.choice("abc ") for _ in range(60))
        text = "".join(r.choice("abc ") for _ in range(8))
        best = max(((T.indel_ratio(text, doc[i : i + 8]), -i) for i in range(53)), default=(0, 0))
        got = T.fuzzy_span(text, doc, 0.7)
        assert (got is None) == (best[0] < 0.7)
        if got:
            assert got[0] == -best[1]


def sliding(text, document, threshold):
    best, where = threshold, None
    for i in range(max(1, len(document) - len(text) + 1)):
        ratio = T.indel_ratio(text, document[i : i + len(text)])
        if ratio > best or where is None and ratio >= best:
            best, where = ratio, (i, i + len(document[i : i + len(text)]))
    return where if text and document else None


def test_seeded_span_is_that_of_the_sliding_window():
    r = random.Random(4)
    for _ in range(250):
        doc = "".join(r.choices("abcdefgh ", k=r.randint(0, 120)))
        start, n = r.randint(0, 100), r.randint(1, 60)
        text = list(doc[start : start + n])
        for _ in range(r.randint(0, 5)):
            place = r.randint(0, len(text))
            text[place : place + r.randint(0, 1)] = r.choice(["", "x", "a"])
        text = "".join(text)
        for threshold in (0.7, 0.85, 0.95, 1.0):
            assert T.fuzzy_span(text, doc, threshold) == sliding(text, doc, threshold), (text, doc, threshold)
    assert T.fuzzy_span("  ", "a  b") is None and T.fuzzy_span("a" * 40, "a" * 300) == (0, 40)


def test_batched_ratios():
    r = random.Random(5)
    lengths = (0, 1, 5, 30, 63, 64, 65, 128, 200)
    a, b = (["".join(r.choices("abcdé 😀", k=r.choice(lengths))) for _ in range(300)] for _ in range(2))
    exact = [T.indel_ratio(x, y) for x, y in zip(a, b)]
    assert similarity.lcs_lengths(a, b).tolist() == [T.lcs_length(x, y) for x, y in zip(a, b)]
    assert similarity.ratios([*a, None, "x"], [*b, "x", None]).tolist() == [*exact, 0, 0]
    for least in (0.3, 0.7, 0.9):
        assert all(x == y or (x == 0 and y < least) for x, y in zip(similarity.ratios(a, b, least), exact))
    many = [chr(0x4E00 + i) for i in range(400)]  # more letters than a byte holds
    assert similarity.lcs_lengths(["".join(many)], ["".join(many[::2])]).tolist() == [200]


def test_mojibake():
    def garbled(text, code, times):
        undefined = {b for b in range(128, 256) if not bytes([b]).decode(code, "ignore")}
        for _ in range(times):
            text = "".join(chr(b) if b in undefined else bytes([b]).decode(code) for b in text.encode())
        return text

    good = ["Schön", "naïve café", "“quoted” – it’s", "漢字テスト", "Ελληνικά", "emoji 😀 here", "Mañana señor ção", "à la carte", "Łódź żółć", "plain", "É ê ë", "±5°C × 2 ÷ 3 © § ¶", "√2 ≤ π", "L’Âge d’or", "SÃO PAULO – Ã", "MAÇÃ” e"]
    for text in good:
        assert repaired(text) == text
    for text in good[:11]:
        for code in ("latin-1", "cp1252", "cp1250", "mac-roman"):
            for times in (1, 2, 3):
                assert repaired(garbled(text, code, times)) == text, (text, code, times)
        assert repaired(garbled("Schön", "cp1252", 1) + " und " + text) == "Schön und " + text  # mixed
    assert repaired("Ã la carte") == "à la carte"  # the no-break space was lost
    assert repaired("SchÃ¶n \ufffd Ã©tÃ©") == "Schön \ufffd été" and repaired("x Ã¶ ÃƒÂ¶") == "x ö ö"
    assert repaired(None) is None and repaired("") == ""


def test_small_functions(spark):
    assert one(spark, 3725.5, T.hms, "x double") == "1h 2m 5s"
    assert one(spark, "```json\n{}\n```", T.strip_code_fence) == "{}"
    assert one(spark, "été naïve x", T.word_count) == 3
    assert one(spark, " a b  c ", T.token_count) == 3
    assert one(spark, "Moral ethics of morality", lambda c: T.matched_terms(c, ["ethic", "moral"])) == ["moral", "ethic"]
    assert one(spark, "SchÃ¶n", lambda c: T.fix_mojibake(F.col(c))) == "Schön"
    assert one(spark, None, T.word_count) == 0
