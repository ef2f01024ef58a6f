"""Exact quantiles and the constrained draw against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from arglake.operators import quantiles, sampling


def test_quantiles_of_all_groups_at_once(spark):
    r = random.Random(1)
    rows = [("hot", r.gauss(0, 1) * 10 ** r.randint(-9, 9)) for _ in range(3000)] + [("ties", float(r.randint(-3, 3))) for _ in range(500)]
    rows += [(None, 5.0), (None, -0.0), ("one", 7.0), ("none", None), ("wide", 1e308), ("wide", -1e308), ("wide", 0.0), ("tiny", 5e-324), ("tiny", 1e-320), ("tiny", 0.0)]
    rows += [("close", 1.0 + i * 2**-52) for i in range(100)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for few, parts in ((4096, 4096), (3, 8)):
        got = {x.g: (x.n, x.q) for x in quantiles.exact_quantiles(df, "x", probabilities, "g", few=few, parts=parts).collect()}
        assert got.keys() == {"hot", "ties", None, "one", "wide", "tiny", "close"}
        for g, (n, q) in got.items():
            values = sorted(v for k, v in rows if k == g and v is not None)
            assert n == len(values)
            for p, v in zip(probabilities, q):
                at = p * (n - 1)
                low, high = int(np.floor(at)), int(np.ceil(at))
                assert v == (values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]), (g, p)
    whole = quantiles.exact_quantiles(df.where("g = 'ties'"), "x", [0.5]).first()
    assert (whole.n, whole.q) == (500, [float(np.median([v for k, v in rows if k == "ties"]))])
    assert quantiles.exact_quantiles(df.where("false"), "x", [0.5], "g").collect() == []
    assert quantiles.medians(df.where("g = 'one'").selectExpr("x AS a", "CAST(NULL AS double) AS b"), "a", "b").first() == (7.0, None)


def test_no_percentile_in_the_plans(spark):
    from arglake.operators import catalog, runlog

    docs = spark.createDataFrame([(i, "w " * i, float(i)) for i in range(9)], "doc_id long, text string, v double")
    plans = [catalog.word_thresholds(docs), catalog.content_lengths(docs), catalog.numeric_summary(docs, "v"), sampling.quartiles(docs, "doc_id", "v"), runlog.latency_stats(docs, "v", "doc_id")]
    assert not any("percentile" in df._jdf.queryExecution().toString().lower() for df in plans)
    assert plans[0].first().median_words == 4 and plans[2].first().median == 4 and plans[4].first().median == 4


def sequential(rows, quotas, columns):
    """Rows come in order; the first of a group that repeat nothing."""
    used, n, out = {}, {}, set()
    for row in rows:
        g = row["g"]
        if n.get(g, 0) >= quotas.get(g, 0):
            continue
        values = {(g, c, v) for c in columns for v in (row[c] if isinstance(row[c], list) else [row[c]]) if v is not None}
        if values & used.keys():
            continue
        used.update(dict.fromkeys(values))
        n[g] = n.get(g, 0) + 1
        out.add(row["id"])
    return out


def drawn(spark, rows, ddl, quotas, columns):
    df = spark.createDataFrame(rows, ddl)
    order = [r.asDict() for r in df.withColumn("_h", F.xxhash64("id", F.lit(42))).orderBy("_h", "id").collect()]
    found = sampling.constrained_draw(df, "g", "id", spark.createDataFrame(list(quotas.items()), "g string, allocated long"), columns)
    assert found.columns == df.columns
    got = [r.id for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got), sequential(order, quotas, columns)


def test_draw_is_the_sequential_one(spark):
    r = random.Random(2)
    ddl = "id long, g string, authors array<string>, year int"
    rows = [(i, r.choice("ab"), [f"a{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 3))], r.choice([None, *range(400)])) for i in range(4000)]
    rows += [(4000 + i, None, ["x", None], None) for i in range(5)] + [(5000, "a", None, None), (5001, "nobody", [], 1)]
    got, want = drawn(spark, rows, ddl, {"a": 150, "b": 10**6, None: 3}, ["authors", "year"])
    assert got == want and len(want) > 300


def test_draw_from_a_large_stratum(spark):
    """A third of the rows have one value, and the draw goes through all 100,000."""
    r = random.Random(3)
    rows = [(i, "a", 0 if i % 3 == 0 else r.randint(1, 60_000), r.randint(0, 50_000)) for i in range(100_000)]
    got, want = drawn(spark, rows, "id long, g string, year int, place int", {"a": 10**6}, ["year", "place"])
    assert got == want and len(want) > 10_000


def test_sample_with_suggestions(spark):
    rows = [(i, "ab"[i % 2], i // 20, i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, year int, other int")
    out = sampling.sample_with_suggestions(df, "g", "id", 30, ["year"]).collect()
    sampled = [r for r in out if r.role == "sampled"]
    assert len(sampled) == 20 and len({(r.g, r.year) for r in sampled}) == 20  # ten years in each group
    assert not [r for r in out if r.role == "suggested"]  # no year is left
    more = sampling.sample_with_suggestions(df.withColumn("year", F.when(F.col("id") >= 40, F.col("year"))), "g", "id", 180, ["year"]).collect()
    assert len({r.id for r in more}) == len(more)
