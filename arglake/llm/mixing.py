"""Soft-membership mixing of documents to target domain weights, with DataFrame functions only.

1. A multinomial naive-Bayes classifier over BUCKETS hashed words is fitted on a labelled table
   (doc_id, domain), of which at most about MAX_LABELLED rows are used (chosen by a hash of the id).
2. Every document gets posteriors p over the domains; the evidence of a text of n words is tempered by
   sqrt(n), so membership stays soft.
3. Nonnegative rates r minimise the weighted squared distance between the expected domain totals
   sum(r * n * p) and the targets.  Projected gradient descent, r <- max(0, r - p . y) with
   y = (sum(n p p'))^-1 (totals - targets), is that of the least-squares problem weighted by the inverse
   matrix, in the metric in which a document's length does not matter; a step of 1 is safe, as the
   largest eigenvalue is 1.  An iteration is one aggregation over the compact table of posteriors.

Only sums of as many numbers as there are domains (and their products) reach the driver.

Edge cases: null or empty texts have no words, prior posteriors and no weight in totals, and get the rate
of their posteriors; labelled rows with a null domain are left out; with no labelled row at all there is
one domain, and all rates are target / total; rows with equal ids count each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.llm.common import SPACE_PATTERN, materialise

BUCKETS = 8192
MAX_LABELLED = 20_000
#: Pseudo-counts of the classifier, in all buckets of a domain together.
SMOOTHING = 500.0
#: Iterations stop where the totals are met, or change no more, both as a share of all tokens; or after so many.
ITERATIONS, TOLERANCE, STILL = 200, 1e-9, 1e-10
#: Iterations after which the rates are written out, to keep expressions short.
WRITE_EVERY = 6


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word (and one for each text without any): ``keep``, bucket (null where there is no word)."""
    word = F.explode_outer(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE_PATTERN)).alias("word")
    rows = docs.select(*keep, word)
    return rows.select(*keep, F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).alias("bucket"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, most: int = MAX_LABELLED) -> tuple[list[str], list[float], DataFrame]:
    """Domains, their log priors, and a table (bucket, weight_0, weight_1, ...) of log likelihoods."""
    labelled = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("domain").cast("string").alias("domain"))
    n = labelled.count()
    if n > most:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    sizes = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    domains = sorted(sizes) or ["all"]
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")  # at most about ``most`` rows of ids
    counts = _words(rows, "domain").where("bucket is not null").groupBy("bucket", "domain").count()
    wide = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"n_{i}") for i, d in enumerate(domains)))
    wide = materialise(wide, "mixing-counts")
    sums = wide.agg(*(F.coalesce(F.sum(f"n_{i}"), F.lit(0)) for i in range(len(domains)))).first()
    weights = [F.log((F.col(f"n_{i}") + SMOOTHING / BUCKETS) / (sums[i] + SMOOTHING)).alias(f"weight_{i}") for i in range(len(domains))]
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return domains, priors, every.join(wide, "bucket", "left").na.fill(0).select("bucket", *weights)


def posteriors(docs: DataFrame, domains: list[str], priors: list[float], weights: DataFrame) -> DataFrame:
    """row, doc_id, n_tokens (words) and the posteriors p_0, p_1, ... of each row of ``docs``."""
    k = range(len(domains))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _words(rows, "row", "doc_id").join(F.broadcast(weights), "bucket", "left")  # BUCKETS rows
    sums = found.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_tokens"), *(F.coalesce(F.sum(f"weight_{i}"), F.lit(0.0)).alias(f"s_{i}") for i in k))
    tempered = sums.select("row", "doc_id", "n_tokens", *((F.lit(priors[i]) + F.col(f"s_{i}") / F.sqrt(F.greatest("n_tokens", F.lit(1)))).alias(f"z_{i}") for i in k))
    top = F.greatest(*(F.col(f"z_{i}") for i in k)) if len(domains) > 1 else F.col("z_0")
    shifted = tempered.select("row", "doc_id", "n_tokens", *(F.exp(F.col(f"z_{i}") - top).alias(f"e_{i}") for i in k))
    total = sum((F.col(f"e_{i}") for i in k), F.lit(0.0))
    return shifted.select("row", "doc_id", "n_tokens", *((F.col(f"e_{i}") / total).alias(f"p_{i}") for i in k))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting; directions without weight get 0."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    scale = max((abs(x) for r in matrix for x in r), default=0.0)
    used: list[int] = []
    for c in range(n):
        free = [i for i in range(n) if i not in used]
        best = max(free, key=lambda i: abs(rows[i][c]))
        if abs(rows[best][c]) <= 1e-12 * scale:
            used.append(-1 - c)
            continue
        used.append(best)
        for i in range(n):
            if i != best and (f := rows[i][c] / rows[best][c]):
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[best])]
    return [rows[b][n] / rows[b][c] if b >= 0 else 0.0 for c, b in enumerate(used)]


def fit_rates(table: DataFrame, domains: list[str], targets: list[float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """``table`` (row, doc_id, n_tokens, p_i) with a column ``rate``; and the expected totals at these rates, which miss
    targets that no nonnegative rates reach.

    ``targets`` are token totals, one for each domain.
    """
    k = range(len(domains))
    n, p = F.col("n_tokens").cast("double"), [F.col(f"p_{i}") for i in k]
    pairs = [(i, j) for i in k for j in k if j <= i]
    got = table.agg(*(F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)) for i, j in pairs)).first()
    matrix = [[0.0] * len(domains) for _ in k]
    for (i, j), x in zip(pairs, got):
        matrix[i][j] = matrix[j][i] = x
    current, rate = table, F.lit(1.0)
    total, before = max(sum(targets), 1.0), None
    for step in range(iterations + 1):
        totals = list(current.agg(*(F.coalesce(F.sum(rate * n * p[i]), F.lit(0.0)) for i in k)).first())
        off = [a - b for a, b in zip(totals, targets)]
        still = before is not None and max(abs(a - b) for a, b in zip(totals, before)) <= STILL * total
        if max(map(abs, off)) <= tolerance * total or still or step == iterations:
            break
        before = totals
        y = solve(matrix, off)
        rate = F.greatest(F.lit(0.0), rate - sum((p[i] * F.lit(y[i]) for i in k), F.lit(0.0)))
        if step % WRITE_EVERY == WRITE_EVERY - 1:
            current, rate = materialise(current.select(*table.columns, rate.alias("rate")), "mixing-rates"), F.col("rate")
    return current.select(*table.columns, rate.alias("rate")), totals


def mix(docs: DataFrame, labelled: DataFrame, target_shares: dict[str, float] | None = None, total_tokens: float | None = None) -> DataFrame:
    """doc_id, n_tokens, rate, the posteriors as a map, and unmet, for each row of ``docs``: unmet is the same everywhere,
    the largest distance of a domain's expected total from its target, as a share of all tokens asked for.

    ``target_shares`` gives each domain's share of the tokens (all equal by default; they are scaled to 1);
    ``total_tokens`` is the number of tokens to reach (that of ``docs`` by default).
    """
    domains, priors, weights = fit_classifier(docs, labelled)
    table = materialise(posteriors(docs, domains, priors, weights), "mixing-posteriors")
    shares = [float((target_shares or {}).get(d, 0.0 if target_shares else 1.0)) for d in domains]
    if not sum(shares):
        shares = [1.0] * len(domains)
    total = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] if total_tokens is None else total_tokens
    targets = [total * s / sum(shares) for s in shares]
    rated, reached = fit_rates(table, domains, targets)
    unmet = max(abs(a - b) for a, b in zip(reached, targets)) / max(total, 1.0)
    membership = F.create_map(*(x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"p_{i}"))))
    return rated.select("row", "doc_id", "n_tokens", "rate", membership.alias("membership"), F.lit(float(unmet)).alias("unmet"))


def labelled_domains(docs: DataFrame, labels: DataFrame, column: str = "lang") -> DataFrame:
    """(doc_id, domain) of the documents that the table of labels lists: their ``column`` is trusted as the domain."""
    listed = labels.select("doc_id").where("doc_id is not null").distinct()
    return docs.select("doc_id", F.col(column).alias("domain")).join(listed, "doc_id", "left_semi")


def smoothed_shares(table: DataFrame, domains: list[str], power: float) -> tuple[list[float], list[float]]:
    """(own, target): the domains' expected token totals, and shares proportional to their ``power``."""
    own = list(table.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{i}")), F.lit(0.0)) for i in range(len(domains)))).first())
    raised = [max(x, 0.0) ** power for x in own]
    total = sum(raised) or 1.0
    return own, [x / total for x in raised]


def mix_rows(docs: DataFrame, labelled: DataFrame, power: float = 0.7, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, repeated to smoothed domain shares (token shares to the ``power``).

    The total is the least at which no domain shrinks, and every row is there once at least: mixing repeats documents of
    small domains and drops none.  A row comes as often as the whole part of its rate says, and once more with the chance
    of the rest (by a hash of its id).
    """
    domains, priors, weights = fit_classifier(docs, labelled)
    table = materialise(posteriors(docs, domains, priors, weights), "mixing-posteriors")
    own, shares = smoothed_shares(table, domains, power)
    total = max((o / s for o, s in zip(own, shares) if s > 0), default=0.0)
    rated, _ = fit_rates(table, domains, [total * s for s in shares])
    return take(docs, rated, least=1, seed=seed)


def take(docs: DataFrame, rated: DataFrame, least: int = 0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the rates of their ids say (the largest of a repeated id), ``least`` times at least."""
    rates = rated.groupBy("doc_id").agg(F.max("rate").alias("__rate")).withColumnRenamed("doc_id", "__rated_id")
    chance = F.pmod(F.xxhash64("__rated_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    copies = F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("int")
    counted = rates.select("__rated_id", F.greatest(copies.cast("int"), F.lit(least)).alias("__copies")).where("__copies > 0")
    out = docs.join(counted, F.col("doc_id").cast("long").eqNullSafe(F.col("__rated_id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
