import itertools
import time
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arglake.llm import main_text, maxent_lm, mixing, quality_rules, toxicity

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header id="top"><a href=/>Site name</a></header><div class="cookie-notice">We use cookies. Accept them all, or read our long policy about it.</div>
<nav class=menu><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></nav><!-- <p>hidden</p> -->
<div id="content"><h1>Title &amp; more</h1><p>First paragraph with <a href=x>a link</a> inside,
  and enough words to be content.<br>Second line.<p>Unclosed paragraph, with text.
<ul><li>One item.<li>Two items.</ul><div class="ad-box"><p>Buy this now, it is great and cheap, friend.</p></div><p>Last one.</p></div>
<aside><h3>Related</h3><p>Some related story that is long, with text, and punctuation.</p></aside>
<section id="comments"><h2>Comments</h2><p>Great article, I liked it very much, thanks for writing it!</p></section>
<form><label>Email</label><input><select><option>x</select></form><footer><p>&copy; 2020 Site. All rights reserved.</p></footer>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "Title & more\nFirst paragraph with a link inside, and enough words to be content. Second line.\nUnclosed paragraph, with text.\nOne item.\nTwo items.\nLast one."
    assert main_text.main_text(PAGE[: PAGE.index("Two items")]).endswith("One item.")
    for broken in ("", "<", "<p", "</p></div>", "<nav><a>x</a></nav>", "<script>", "<!--", "&", "<p>&#x41;&bogus;</p>"):
        assert isinstance(main_text.main_text(broken), str)
    assert main_text.main_text("<nav><a href=x>menu</a></nav><footer>end</footer>") == ""
    long = "<article>" + "<p>" + "A sentence, and more. " * 20_000 + "</p></article>"
    assert len(main_text.main_text(long)) == len("A sentence, and more. ") * 20_000 - 1


@pytest.mark.parametrize("seed", range(20))
def test_minimum_cut_is_minimal(seed):
    r = random.Random(seed)
    n = 8
    odds = [r.uniform(-3, 3) for _ in range(n)]
    edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.4]

    def cost(labels):
        return sum(max(0, o) if not x else max(0, -o) for o, x in zip(odds, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])

    best = min(cost(x) for x in itertools.product([False, True], repeat=n))
    assert math.isclose(cost(main_text.minimum_cut(odds, edges)), best, abs_tol=1e-9)


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", None), (None, "w", PAGE, "x"), (1, "u", PAGE, "x")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    assert Counter((r.page_id, r.url, bool(r.text)) for r in got) == Counter([(1, "u", True), (2, None, False), (3, "v", False), (None, "w", True), (1, "u", True)])
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_extraction_equals_brute_force_over_all_labellings(spark):
    """Of all labellings of a page's blocks the cheapest gives the text (of equals, the one with the least content)."""
    r = random.Random(6)
    kinds = ['<p>{}</p>', '<li><a href="x">{}</a></li>', '<div class="sidebar">{}</div>', "<h2>{}</h2>", "<div>{}</div>", "<footer>{}</footer>", '<article class="post"><p>{}</p></article>']
    for _ in range(60):
        page = "<body>" + "".join(r.choice(kinds).format(" ".join("word" for _ in range(r.randint(1, 25)))) for _ in range(r.randint(1, 9)))
        found, tree = main_text.blocks(page)
        odds, edges = [main_text.log_odds(b) for b in found], main_text.edges_of(found, tree)

        def cost(content, odds=odds, edges=edges):
            return sum(max(0, o) if not c else max(0, -o) for o, c in zip(odds, content)) + sum(w for i, j, w in edges if content[i] != content[j])

        best = min(itertools.product([False, True], repeat=len(found)), key=lambda c: (round(cost(c), 9), sum(c)))
        assert main_text.main_text(page) == "\n".join(b.text for b, c in zip(found, best) if c)


def test_large_and_mixed_pages_take_seconds():
    begun = time.time()
    mixed = "<body>" + "".join(f"<p>A sentence with some words, number {i}.</p><li><a href=x>link {i}</a></li>" for i in range(25_000))
    assert main_text.main_text(mixed).count("\n") == 24_999
    deep = "<div class='x'>word " * 50_000
    assert isinstance(main_text.main_text(deep), str)
    assert main_text.main_text("<div>" * 50_000 + "<article><p>A sentence, as long as it needs to be, is here.</p></article>" + "</span>" * 50_000) == "A sentence, as long as it needs to be, is here."
    assert main_text.main_text("<b>" * 50_000 + "<div>a b</div>" * 20_000) == ""
    assert time.time() - begun < 20


# --- toxicity ---------------------------------------------------------------------------------------


def test_folding_and_matches():
    assert len(toxicity.fold("İdIоT1 ß Ｘ")) == len("İdIоT1 ß Ｘ")
    m = toxicity.Lexicon({toxicity.fold(w): 2.0 for w in ("idiot", "clown")}, {toxicity.fold("lowei"): 3.0}, ("clown fish",)).matcher()
    for t in ("IDIOT", "1d10t", "іdiоt", "an idiot.", "ｉｄｉｏｔ", "cl0wn!", "loweischaft", "(idiot)"):
        assert m.matches(t), t
    for t in ("", "idiotic", "xidiot", "clown fish", "a clown fish swims", "slowei", "100 %"):
        assert not m.matches(t), t
    assert m.score("idiot") > m.score("idiot " + "word " * 500) > m.score("word")


def toxic_rows(n=600, seed=1):
    r = random.Random(seed)
    words = [f"wort{i}" for i in range(200)]
    bad = ["qualz", "drimbo"]
    stems = ["zarg"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 3)):
                x = r.choice([r.choice(bad), r.choice(stems) + r.choice(words)])
                w.insert(r.randrange(len(w)), x if r.random() < 0.8 else x.replace("a", "4").replace("o", "0"))
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns(spark):
    docs, labels = toxic_rows()
    d = spark.createDataFrame(docs + [(10_000, None, None, None), (10_001, "", "en", "s"), (None, "qualz", "en", "s")], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    right = sum(got[i].predicted == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert got[10_000].predicted == 0 and got[10_001].score == got[10_000].score and 0 <= got[10_000].score <= 1
    assert got[None].predicted == 1 and got[None].held_out is False
    clean = toxicity.clean_rows(d, toxicity.learn(d, lab, toxicity.training_rows()))
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "you idiot", "x"), (2, "fine", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(d, none).collect()} == {1: 0, 2: 0}  # no term is built in
    own = toxicity.learn(d, none, toxicity.training_rows(), terms={"idiot": 3.0, "fine": 3.0}, exceptions=["fine"])
    assert [r.doc_id for r in toxicity.clean_rows(d, own).collect()] == [2]
    assert toxicity.toxicity(d.limit(0), none).collect() == []
    spans = toxicity.score(d, toxicity.Lexicon({"idiot": 3.0})).where("doc_id = 1").first().spans
    assert [(s.start, s.end) for s in spans] == [(4, 9)]


# --- quality ----------------------------------------------------------------------------------------


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, lines, len(inside)


def test_quality_counts():
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", "c", " ", " ", "\n", "\t", "#", "<", "é", "\x0b"]) for _ in range(r.randint(0, 120)))
        assert quality_rules.counts(t) == brute_counts(t), repr(t)


def test_quality_rules_adapt(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        lang, source = r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None])
        size = 12 if lang == "de" else 4  # one language has long words
        rows.append((i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(size - 2, size + 2))) for _ in range(r.randint(60, 200))), lang, source, 1))
    junk = [(9000, " ".join("".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(100)), "en", "s0", 1), (9001, " ".join(f"w{i}###" for i in range(100)), "en", "s0", 1), (9002, "the same line again and again here\n" * 40, "en", "s0", 1), (9003, None, "en", "s0", 1), (9004, "short", None, None, 1)]
    docs = spark.createDataFrame(rows + junk + rows[:1], "doc_id long, text string, lang string, source string, l int")
    got = defaultdict(list)
    for x in quality_rules.judge(docs).collect():
        got[x.doc_id].append(x)
    assert len(got[0]) == 2 and sum(map(len, got.values())) == 606
    assert not any(got[i][0].kept for i in range(9000, 9005))
    assert got[9003][0].base_failed and got[9003][0].n_words == 0 and not got[9000][0].base_failed
    assert sum(got[i][0].kept for i in range(600)) >= 595  # clean documents of every group stay
    for i, t, *_ in rows[:50]:
        x = got[i][0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_lines, x.n_repeat_words) == brute_counts(t)
    assert quality_rules.judge(docs.limit(0)).collect() == []


def brute_kept(rows):
    """Verdicts by sorted values: quartiles are the middles of their buckets, and lean on language and corpus."""
    counted = [(lang, source, *brute_counts(t or "")) for _, t, lang, source in rows]
    failed = [c[2] < 50 or 100 * c[7] > 50 * c[2] for c in counted]
    numerators = {"mean": (3, 2, 0), "symbols": (4, 3, 1), "lines": (5, 6, 1), "repeats": (7, 2, 6)}
    share = lambda a, b: a / b if b else 0.0
    gamma = 1.01 / 0.99
    middle = lambda v: 0.0 if v < 1e-4 else 2 * gamma ** math.ceil(math.log(min(v, 1e4)) / math.log(gamma)) / (gamma + 1)

    def quartiles(chosen, value):
        v = sorted(value(c) for c in chosen)
        return np.array([middle(v[math.ceil(q * len(v)) - 1]) for q in (0.25, 0.75)])

    good = [c for c, f in zip(counted, failed) if not f]

    def leaning(group, value):
        of_lang, own = ([c for c in good if c[:k] == group[:k]] for k in (1, 2))
        q = quartiles(good, value)
        for chosen in (of_lang, own):
            q = (len(chosen) * quartiles(chosen, value) + 20 * q) / (len(chosen) + 20)
        return q

    fences = {}
    for group in {c[:2] for c in good}:
        for r, (a, b, step) in numerators.items():
            q1, q3 = leaning(group, lambda c: share(c[a], c[b]))
            spread = q3 - q1
            if r != "mean":
                spread = max(spread, 2 * leaning(group, lambda c: share(step, c[b]))[1])
            reach, room = 6 * spread, 1 - q3
            fences[group, r] = (q1 - reach, q3 + reach) if r == "mean" else (-1, q3 + room * reach / math.hypot(room, reach))
    out = []
    for c, f in zip(counted, failed):
        inside = all((x := fences.get((c[:2], r))) is None or x[0] <= share(c[a], c[b]) <= x[1] for r, (a, b, _) in numerators.items())
        out.append(not f and inside)
    return out


def test_quality_verdicts_equal_brute_force_and_sources_have_their_own_fences(spark):
    r = random.Random(11)
    rows = []
    for i in range(500):
        lang, source = r.choice(["en", "en", "de"]), r.choice(["chat", "news"])
        n = r.randint(55, 120) if source == "chat" else r.randint(300, 900)
        noise = 0.10 if source == "chat" else 0.002  # one source is full of symbols
        text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) + ("#" if r.random() < noise else "") for _ in range(n))
        if r.random() < 0.1:
            text += " " + " ".join(f"x{k}##" for k in range(r.randint(1, n // 2)))
        if r.random() < 0.1:
            text += "\n" + "\n".join(["a line that comes again"] * r.randint(1, 40))
        rows.append((i, text, lang, source))
    rows += [(900, None, "en", "chat"), (901, "too short", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    want = brute_kept(rows)
    assert [judged[i].kept for i, *_ in rows] == want and 0.6 * len(rows) < sum(want) < 0.97 * len(rows)
    fences = {(x.lang, x.source): (x.symbol_share_high, x.repeat_share_high, x.mean_word_chars_high) for x in judged.values()}
    assert len({fences[g] for g in fences if g[0] in ("en", "de")}) == 4
    assert fences["en", "chat"][0] > 3 * fences["en", "news"][0]


def test_quality_fences_differ_by_group_on_the_tables(spark):
    got = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    fences = got.groupBy("lang", "source").agg(*(F.first(f"{x}_high", True).alias(x) for x in quality_rules.RATIOS)).dropna().collect()
    for name in ("mean_word_chars", "symbol_share", "repeat_share"):
        assert len({x[name] for x in fences}) > 0.8 * len(fences)


def test_every_fence_of_the_tables_can_fire(spark):
    """Each group of the tables would reject a text that is as bad as can be in one ratio; the share fences are below what the base rule takes, or below 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(5)
    plain = lambda n: [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrs')}{r.choice('aeiou')}{k % 10}{k // 10}" for k in range(n)]
    bad = {
        "mean_word_chars": " ".join("x".join(plain(3)) * 2 for _ in range(60)),
        "symbol_share": " ".join(w + "##" for w in plain(80)),
        "dup_line_share": " ".join(plain(300)) + "\nagain" * 120,
        "repeat_share": " ".join(plain(66) + [*"stuvwxyzab"] * 6),
    }
    groups = [(x.lang, x.source) for x in docs.groupBy("lang", "source").count().where("count >= 20").collect()]
    rows = [(-1 - 10 * i - k, t, *g) for i, g in enumerate(groups[:10]) for k, t in enumerate(bad.values())]
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    fired: dict[str, set] = {name: set() for name in bad}
    for x in quality_rules.judge(both).where("doc_id < 0").collect():
        for name in bad:
            if not x.base_failed and x[name] > x[f"{name}_high"]:
                assert not x.kept
                fired[name].add((x.lang, x.source))
    assert all(fired.values()), {k: len(v) for k, v in fired.items()}


def test_sketches_merge(spark):
    r = np.random.default_rng(1)
    values = r.lognormal(0, 1, 4000)
    rows = spark.createDataFrame([("a" if i % 3 else "b", float(v), *[0.0] * 6) for i, v in enumerate(values)], "g string, " + ", ".join(f"{x} double" for x in quality_rules.SKETCHED))
    both = quality_rules.merged(quality_rules.sketch(rows, ["g"]), [])
    whole = quality_rules.sketch(rows, [])
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.select(both.columns).collect()))
    q = {x.ratio: x for x in quality_rules.quantiles(whole, [], {"q1": 0.25, "q3": 0.75}).collect()}
    for name, at in (("q1", 0.25), ("q3", 0.75)):
        assert abs(q["mean_word_chars"][name] / np.quantile(values, at) - 1) < 0.03
    assert q["symbol_share"]["q3"] == 0


# --- language model ---------------------------------------------------------------------------------


def lm_rows(n=250, seed=2):
    r = random.Random(seed)
    follow = {f"a{i}": [f"a{(i * 3 + k) % 30}" for k in range(2)] for i in range(30)}
    rows = []
    for i in range(n):
        w, x = [], f"a{r.randrange(30)}"
        for _ in range(r.randint(5, 60)):
            w.append(x if r.random() < 0.9 else f"rare{r.randrange(3000)}")
            x = r.choice(follow[x])
        rows.append((i, " ".join(w)))
    return rows


def test_language_model(spark):
    rows = lm_rows() + [(900, None), (901, ""), (902, "Never SEEN words"), (0, "again a1 A2"), (None, "a1 a2 a3")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, score string")
    got = maxent_lm.language_model(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update(maxent_lm.tokens(t or ""))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(k := maxent_lm.tokens(t or "")), sum(count[w] > 0 for w in k), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in k), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    tested = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)
    assert all(r.score < 0 for r in got)


def test_model_is_a_distribution():
    heavy = [(f"w{i}", 1000 - i) for i in range(500)]
    m = maxent_lm.Model(heavy, 600_000)
    r = np.random.default_rng(1)
    m.rows[:] = r.normal(0, 0.5, m.rows.shape)
    m.word[:] = r.normal(0, 0.5, m.word.shape)
    k = maxent_lm.VOCABULARY + 1
    context = np.array([3, 7, 11])
    f = [np.repeat(x[2:3], k) for x in m.features(context)]
    log_p = m.forward(np.arange(k, dtype=np.int32), tuple(f))[0]
    assert math.isclose(np.exp(log_p).sum(), 1, rel_tol=1e-4)


def test_gradient_is_the_derivative():
    heavy = [(f"w{i}", 100) for i in range(200)]
    m = maxent_lm.Model(heavy, 20_000)
    m.rows = m.rows.astype(np.float64)
    m.word = m.word.astype(np.float64)
    target, rows = np.array([5, 130, maxent_lm.VOCABULARY], np.int32), m.features(np.array([5, 130, 7]))
    g = maxent_lm.Gradient(m)
    m.gradient(target, rows, g)
    for array, grad, at in ((m.rows, g.rows, (rows[0][1], 2)), (m.word, g.word, (m.word_row(np.array([2]), rows[0][1:2])[0], 2))):
        before = m.forward(target, rows)[0].sum()
        array[at] += 1e-4
        assert math.isclose((m.forward(target, rows)[0].sum() - before) / 1e-4, grad[at], abs_tol=1e-2)
        array[at] -= 1e-4


def test_language_model_beats_the_base_on_held_out_rows_of_the_tables(spark):
    got = maxent_lm.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    score, base, n = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert score / n > base / n + 0.1


def test_blocks_of_gradients_add_up():
    m = maxent_lm.Model([(f"w{i}", 5000 - i) for i in range(4500)], 250_000_000)
    r = np.random.default_rng(2)
    whole, sums = maxent_lm.Gradient(m), maxent_lm.Gradient(m)
    assert m.hashed == maxent_lm.hashed_rows(250_000_000) > maxent_lm.hashed_rows(0) == maxent_lm.LEAST_ROWS
    for _ in range(3):
        context, part = r.integers(0, maxent_lm.CONTEXTS - 1, 500), maxent_lm.Gradient(m)
        target = np.minimum(context, maxent_lm.VOCABULARY)
        for g in (whole, part):
            m.gradient(target, m.features(context), g)
        for block in part.blocks():
            sums.add_block(*block)
    for a, b in ((whole.rows, sums.rows), (whole.word, sums.word), (whole.fired, sums.fired), (whole.word_fired, sums.word_fired)):
        assert np.allclose(a, b, atol=1e-4)


def test_language_model_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert maxent_lm.language_model(docs).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = maxent_lm.language_model(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (got.train_tokens, got.n_known, got.n_tokens, got.base_score) == (0, 0, 3, 0.0)


# --- mixing -----------------------------------------------------------------------------------------


def mixing_rows(n=300, seed=5):
    r = random.Random(seed)
    words = {"en": ["the", "of", "and", "to"], "fr": ["le", "la", "et", "de"], "xx": ["qq", "zz"]}
    rows = []
    for i in range(n):
        lang = r.choices(["en", "fr", "xx"], [6, 3, 1])[0]
        rows.append((i, " ".join(r.choice(words[lang]) if r.random() < 0.8 else r.choice(words["en"]) for _ in range(r.randint(3, 60))), lang))
    return rows


def reference_rates(p, n, targets, steps=4000):
    """Projected gradient descent in numpy on the same weighted problem."""
    a = p * n[:, None]
    matrix = np.linalg.pinv((p * n[:, None]).T @ p)
    rate = np.ones(len(n))
    for _ in range(steps):
        rate = np.maximum(0, rate - p @ (matrix @ (a.T @ rate - targets)))
    return rate


@pytest.mark.parametrize("shares", [{"en": 0.4, "fr": 0.3, "xx": 0.3}, {"en": 1.0, "fr": 0.0, "xx": 0.0}])
def test_mixing(spark, shares):
    rows = mixing_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(900, None, "en", 1), (901, "", None, 1), (None, "le la", "fr", 1), (3, "le et", "fr", 1)], "doc_id long, text string, lang string, rate int")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(None, 1)], "doc_id long, quality int")
    got = mixing.mix(docs, mixing.labelled_domains(docs, labels), shares).collect()
    assert len(got) == len(rows) + 4 and all(r.rate >= 0 for r in got)
    assert sum(r.n_tokens == 0 for r in got) == 2
    domains = sorted(shares)
    p = np.array([[r.membership[d] for d in domains] for r in got])
    n = np.array([r.n_tokens for r in got], float)
    assert np.allclose(p.sum(axis=1), 1)
    targets = np.array([shares[d] for d in domains]) * n.sum()
    rate = np.array([r.rate for r in got])
    off = lambda x: x @ (p * n[:, None]) - targets
    assert all(math.isclose(r.unmet, np.abs(off(rate)).max() / n.sum(), abs_tol=1e-6) for r in got)
    if min(shares.values()) > 0.01:
        assert np.allclose(off(rate), 0, atol=1e-5 * n.sum()) and got[0].unmet < 1e-5
    else:
        matrix = np.linalg.pinv((p * n[:, None]).T @ p)
        cost = lambda x: off(x) @ matrix @ off(x)
        # the target cannot be met: steps shorten near the bound, and the iterations stop within this of the optimum
        assert cost(rate) <= cost(reference_rates(p, n, targets)) + 1e-4 * cost(np.ones(len(n)))
    lang = {i: l for i, _, l in rows}
    right = [r.membership[lang[r.doc_id]] for r in got if r.doc_id in lang and r.n_tokens > 20]
    assert sum(x > 0.5 for x in right) > 0.9 * len(right)


def test_mixing_of_sources_that_texts_tell_apart(spark):
    rows = [(i, t, "en", {"en": "web", "fr": "news", "xx": "code"}[lang]) for i, t, lang in mixing_rows(400, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id long")
    got = mixing.mix(docs, mixing.labelled_domains(docs, labels, "source"), {"web": 0.2, "news": 0.5, "code": 0.3}).collect()
    tokens = sum(r.n_tokens for r in got)
    for domain, share in (("web", 0.2), ("news", 0.5), ("code", 0.3)):
        assert math.isclose(sum(r.rate * r.n_tokens * r.membership[domain] for r in got), share * tokens, rel_tol=1e-4)
    assert got[0].unmet < 1e-5


def test_mixing_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mixing.mix(docs, mixing.labelled_domains(docs, docs.select("doc_id"))).collect() == []


def test_toxicity_matches_by_brute_force():
    """Every term at every place, by comparison, against the automaton; then the score from its definition."""
    r = random.Random(5)
    hits = 0
    for _ in range(300):
        some = lambda n: ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(n)]
        lexicon = toxicity.Lexicon(word={t: r.uniform(0.5, 6) for t in some(3)}, start={t: r.uniform(0.5, 6) for t in some(2)}, exceptions=tuple(" ".join(some(2)) for _ in range(2)))
        text = "".join(r.choice("aabbccAB4@ -.1") for _ in range(60))
        folded = toxicity.fold(text)
        assert len(folded) == len(text)
        spans = []
        for terms, kind in ((lexicon.word, "w"), (lexicon.start, "s"), ({toxicity.fold(x): 0 for x in lexicon.exceptions}, "x")):
            for t in terms:
                for i in range(len(text) - len(t) + 1):
                    end = i + len(t)
                    whole = end == len(text) or not text[end].isalpha()
                    if folded[i:end] == t and not (i and text[i - 1].isalnum()) and (kind == "s" or whole):
                        spans.append((kind, i, end, terms[t]))
        spared = [(i, e) for kind, i, e, _ in spans if kind == "x"]
        longest = {i: max(e for k, a, e, _ in spans if a == i and k != "x") for k, i, _, _ in spans if k != "x"}
        want = {(i, e) for i, e in longest.items() if not any(a <= i and e <= z for a, z in spared)}
        got = lexicon.matcher().matches(text)
        assert {(i, e) for i, e, _ in got} == want
        assert all((w in (lexicon.word.get(folded[i:e]), lexicon.start.get(folded[i:e]))) for i, e, w in got)
        weight = sum(w for _, _, w in got)
        n = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text)))
        x, y = (math.log1p(weight), math.log1p(100 * weight / n)) if weight else (0, 0)
        bias, p, q = lexicon.curve
        assert math.isclose(lexicon.matcher().score(text), 1 / (1 + math.exp(-(bias + p * x + q * y))), rel_tol=1e-9)
        hits += len(got)
    assert hits > 300


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in mixing_rows()], "doc_id long, text string, lang string, __x int")
    labels = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    out = mixing.mix_rows(docs, mixing.labelled_domains(docs, labels))
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == set(range(300)) and max(times.values()) > 1
    assert mixing.mix_rows(docs.limit(0), mixing.labelled_domains(docs, labels)).collect() == []
    rated = docs.select("doc_id", F.lit(2.0).alias("rate")).where("doc_id < 3")
    assert Counter(r.doc_id for r in mixing.take(docs, rated).collect()) == {0: 2, 1: 2, 2: 2}


def test_mixing_without_labels(spark):
    docs = spark.createDataFrame(mixing_rows(20), "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(docs, none, total_tokens=2 * sum(len(t.split()) for _, t, _ in mixing_rows(20))).collect()
    assert all(math.isclose(r.rate, 2.0, rel_tol=1e-6) and r.membership == {"all": 1.0} for r in got)


@pytest.mark.parametrize("seed", range(5))
def test_solve(seed):
    r = np.random.default_rng(seed)
    a = r.normal(size=(4, 4))
    b = r.normal(size=4)
    assert np.allclose(mixing.solve(a.tolist(), b.tolist()), np.linalg.solve(a, b))
    assert mixing.solve([[2.0, 0.0], [0.0, 0.0]], [4.0, 0.0]) == [2.0, 0.0]


def test_toxicity_tries_terms_behind_many_more_frequent_ones(spark):
    r = random.Random(8)
    common_words = " ".join("".join(r.choice("abcdefghijkmnopqrstuvwxyz") for _ in range(9)) for _ in range(6000))
    rows = [(i, common_words + " zorgblat" * (i < 11), 1) for i in range(14)] + [(100 + i, common_words if i < 20 else "fine words", 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    assert lexicon.matcher().matches("a zorgblat b")
    assert not lexicon.matcher().matches(common_words)
