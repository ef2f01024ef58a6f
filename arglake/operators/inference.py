"""Pluggable models: classifiers, pair classifiers and generators behind Arrow functions.

A plug-in is a factory that a worker calls once; what it returns is called with batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.functions.text import sentences
from arglake.operators.maps import drop_non_relations, keep_spans, span_pairs

Classifier = Callable[[list[str]], list[tuple[str, float]]]
Generator = Callable[[str, str], dict]


def stub_classifier(labels: tuple[str, ...]) -> Callable[[], Classifier]:
    """A deterministic classifier for tests: the label is chosen by a hash of the text (or pair of texts)."""

    def make() -> Classifier:
        def classify(texts):
            out = []
            for t in texts:
                h = int.from_bytes(hashlib.blake2b("\0".join(x or "" for x in (t if isinstance(t, tuple) else (t,))).encode(), digest_size=4).digest(), "little")
                out.append((labels[h % len(labels)], round(0.5 + h % 1000 / 2000, 6)))
            return out

        return classify

    return make


def stub_generator() -> Generator:
    return lambda system, user: {"text": f"{len(system or '')}:{len(user or '')}", "tokens": len((user or "").split())}


def classify(df: DataFrame, text: str, factory: Callable[[], Classifier], batch: int = 32) -> DataFrame:
    """``df`` with the best label and its probability."""
    return mapped(df, [text], factory, "label string, score double", batch)


def mapped(df: DataFrame, columns: list[str], factory: Callable, fields: str, batch: int = 32) -> DataFrame:
    """``df`` with what a batch function returns for the rows of ``columns``: ``fields`` is the DDL of its tuples."""
    names = [f.split()[0].strip("`") for f in fields.split(",")]

    def work(frames):
        model = factory()
        for f in frames:
            rows = list(zip(*(f[c] for c in columns))) if len(columns) > 1 else f[columns[0]].tolist()
            out = []
            for i in range(0, len(rows), batch):
                out += model(rows[i : i + batch])
            yield f.assign(**{n: [o[j] for o in out] for j, n in enumerate(names)})

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(work, f"{schema}, {fields}")


def spans(docs: DataFrame, factory: Callable[[], Classifier], id_column: str = "doc_id", text_column: str = "text", positive: str | None = None) -> DataFrame:
    """(id, pos, start, end, text, label, score): classified sentences that are arguments."""
    flat = docs.select(F.col(id_column).alias("id"), F.posexplode(sentences(text_column)).alias("pos", "s")).select("id", "pos", "s.*")
    return keep_spans(mapped(flat, ["text"], factory, "label string, score double"), positive)


def relations(found: DataFrame, factory: Callable, batch: int = 16) -> DataFrame:
    """(id, head, tail, label, score): classified ordered pairs of spans of one document, non-relations dropped."""
    texts = found.select("id", "pos", "text")
    pairs = span_pairs(found, "id")
    pairs = pairs.join(texts.select("id", F.col("pos").alias("head"), F.col("text").alias("head_text")), ["id", "head"])
    pairs = pairs.join(texts.select("id", F.col("pos").alias("tail"), F.col("text").alias("tail_text")), ["id", "tail"])
    return drop_non_relations(mapped(pairs, ["head_text", "tail_text"], factory, "label string, score double", batch)).select("id", "head", "tail", "label", "score")


def generate(prompts: DataFrame, factory: Callable[[], Generator] = stub_generator, system: str = "system", user: str = "user") -> DataFrame:
    """``prompts`` with text, tokens and error of a generator; a row that fails has an error and no text."""

    def make():
        model = factory()

        def run(rows):
            out = []
            for s, u in rows:
                try:
                    r = model(s, u)
                    out.append((r["text"], int(r.get("tokens", 0)), None))
                except Exception as e:  # one record must not fail the job
                    out.append((None, 0, str(e)[:500]))
            return out

        return run

    return mapped(prompts, [system, user], make, "text string, tokens long, error string", 1)


_STEP = re.compile(r"<step\s*(\d+)\s*output>", re.I)


def fill_steps(template: str, outputs: list[str]) -> str:
    """``<step N output>`` by the N-th output, by nothing where there is none."""
    return _STEP.sub(lambda m: outputs[int(m[1]) - 1] if 0 < int(m[1]) <= len(outputs) else "", template or "")


def run_steps(prompts: DataFrame, factory: Callable[[], Generator] = stub_generator, strategy: str = "system") -> DataFrame:
    """``prompts`` (steps array<struct<system,user>>) with text and trace: steps in order, earlier outputs injected (``system``: a fresh chat each) or carried along (``user``)."""

    def make():
        model = factory()

        def run(rows):
            out = []
            for steps in rows:
                outputs: list[str] = []
                for s in steps:
                    user = fill_steps(s["user"], outputs)
                    if strategy == "user" and outputs:
                        user = "\n\n".join([*outputs, user])
                    outputs.append(model(fill_steps(s["system"], outputs), user)["text"])
                out.append((outputs[-1] if outputs else None, outputs))
            return out

        return run

    return mapped(prompts, ["steps"], make, "text string, trace array<string>", 1)


def training_examples(df: DataFrame) -> DataFrame:
    """(id, text, label): spans as examples; claims 0, premises 1, others 2."""
    flat = df.select("id", F.explode("spans").alias("s"))
    label = F.when(F.col("s.label").isin("MajorClaim", "Claim"), 0).when(F.col("s.label") == "Premise", 1).otherwise(2)
    return flat.select("id", F.col("s.text").alias("text"), label.alias("label"))


def logistic_weights(df: DataFrame, features: list[str], label: str):
    """Weights of a logistic regression on metric columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_f").transform(df.na.fill(0.0, features))
    return LogisticRegression(featuresCol="_f", labelCol=label, maxIter=50).fit(rows)
