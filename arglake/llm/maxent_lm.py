"""A hashed maximum-entropy language model with a class-factored softmax.

The most frequent words fall, by frequency, into CLASSES classes of WIDTH words; all others are one more
class, inside which a word's probability comes from its add-one count.  With the context h,

    log P(w | h) = log softmax_class(bias + prev[h] + pair[h] + skip[h]) + log softmax_in_class(bias + word[class, prev])

where prev is the row of the previous word, pair the hashed row of the two previous words, skip the row
of the word before the previous one, and word the hashed row of (class, previous word).  Words outside
the vocabulary have a context number by their last letters.

Word counts are exact, over all training documents.  Texts are cut into tokens once more to be coded: a row's
tokens become context numbers of two bytes, written to the shared folder; training and scoring read these.
The weights are trained by ROUNDS synchronous gradient updates: every training document is in exactly one
round (by a hash of its id); each task sums the gradients (observed less expected feature counts) of its
documents, and passes on the rows that it touched in blocks, which are added up block by block in a tree
of FAN_IN branches and applied with a diagonal preconditioner.  Tasks grow in number with the tokens.  The hashed tables grow with the number of training
tokens (a row for each TOKENS_A_ROW, between LEAST_ROWS and MOST_ROWS, which bounds the broadcast).
Scoring works on sparse batches of tokens in numpy.  At most HEAVY words, the most frequent, are broadcast;
the counts of all others meet their tokens in a join.

Edge cases: null counts as empty; an empty text is its end token alone; documents with a null id are
training documents; without training documents all counts are 0 and the model is uniform over classes;
rows with equal ids are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arglake.llm.common import crc_of_id, lower_ascii, materialise, strings, words

CLASSES, WIDTH = 64, 64
#: Words that are broadcast with their counts, at most; each of at most LONGEST characters.
HEAVY, LONGEST = 200_000, 64
#: Context numbers of words outside the vocabulary.
ENDINGS = 1024
#: Hashed rows of word pairs, and of (class, previous word): a power of two that grows with the training tokens.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 16384, 1 << 13, 1 << 15
ROUNDS = 3
RATE, DAMPING, CLIP = 0.5, 4.0, 3.0
#: Tokens of a numpy batch.
BATCH = 4096
#: Words that a task counts before it passes them on.
COUNTED = 400_000
END = "\n"  # no word has white space

VOCABULARY = CLASSES * WIDTH
#: Columns of a class-level row: the classes, that of all other words, and one of no weight, as gradients are added up in pairs.
COLUMNS = CLASSES + 2
CONTEXTS = VOCABULARY + ENDINGS + 1  # the last: before the text
#: Weight rows of a block in which gradients travel; gradients that one task adds up at a level.
BLOCK_ROWS, FAN_IN = 2048, 64
#: Tokens that a training task takes at least, so that its gradient is small beside its input.
TOKENS_A_TASK = 4_000_000


def tokens(text: str) -> list[str]:
    found = words(lower_ascii(text))
    found.append(END)
    return found


# --- counts ---------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``docs``, the end token included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out():
            ws = list(n)
            for i in range(0, len(ws), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(ws[i : i + 50_000], pa.string()), pa.array([n[w] for w in ws[i : i + 50_000]], pa.int64())], names=["word", "c"])
            n.clear()

        for b in batches:
            for t in strings(b.column(0)):
                n.update(tokens(t))
                if len(n) > COUNTED:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def heavy_words(counts: DataFrame, most: int = HEAVY) -> list[tuple[str, int]]:
    """The most frequent words, most frequent first: at most ``most``, cut between two steps of count so that no tie is split."""
    step = F.floor(F.log2("c") * 16).cast("int")
    short = counts.where(F.length("word") <= LONGEST)
    steps = sorted(((r[0], r[1]) for r in short.groupBy(step.alias("s")).count().collect()), reverse=True)  # at most 16 * 63 rows
    cut, n = None, 0
    for s, k in steps:
        if n + k > most:
            break
        n, cut = n + k, s
    if cut is None:
        return []
    rows = short.where(step >= cut).collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[1], x[0]))


class _Numbers(dict):
    """-1 for words that are not there."""

    def __missing__(self, word: str) -> int:
        return -1


class Lookup:
    """What a worker knows of the heavy words."""

    def __init__(self, heavy: list[tuple[str, int]]):
        self.number = _Numbers((w, i) for i, (w, _) in enumerate(heavy))
        self.counts = np.array([c for _, c in heavy] + [0], np.int64)
        vocabulary = min(VOCABULARY, len(heavy))
        self.target = np.full(len(heavy) + 1, VOCABULARY, np.int32)
        self.target[:vocabulary] = np.arange(vocabulary)
        self.context = np.array([i if i < vocabulary else VOCABULARY + ending(w) for i, (w, _) in enumerate(heavy)] + [0], np.int32)

    def __call__(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heavy number or -1, target, context) of each token."""
        h = np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))
        context = self.context[h]
        for i in np.flatnonzero(h < 0).tolist():
            context[i] = VOCABULARY + ending(found[i])
        return h, self.target[h], context


def hashed_rows(total: int) -> int:
    """Rows of a hashed table for so many training tokens."""
    wanted = max(1, total // TOKENS_A_ROW)
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (wanted - 1).bit_length()))


def ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % ENDINGS


# --- the model ------------------------------------------------------------------------------------


class Model:
    """Weights; ``rows`` stacks the class-level rows (prev, skip, pair), ``word`` the rows inside a class."""

    def __init__(self, heavy: list[tuple[str, int]], total: int):
        c = np.array([n for _, n in heavy[:VOCABULARY]], np.float64)
        slots = np.zeros(VOCABULARY)
        slots[: len(c)] = c
        by_class = slots.reshape(CLASSES, WIDTH)
        mass = np.append(by_class.sum(axis=1), max(0.0, total - c.sum())) + 0.5
        self.prior = np.append(mass / mass.sum(), 0).astype(np.float32)
        self.class_bias = np.append(np.log(self.prior[:-1]), np.float32(-1e4))
        inside = by_class + 0.5
        inside[slots.reshape(CLASSES, WIDTH) == 0] = 1e-6  # slots without a word
        self.word_prior = (inside / inside.sum(axis=1, keepdims=True)).astype(np.float32)
        self.word_bias = np.log(self.word_prior)
        self.hashed = hashed_rows(total)
        self.rows = np.zeros((2 * CONTEXTS + self.hashed, COLUMNS), np.float32)
        self.word = np.zeros((self.hashed, WIDTH), np.float32)

    def features(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of prev, skip and pair for each place of one text, whose tokens have the context numbers ``context``."""
        n = len(context)
        padded = np.full(n + 2, CONTEXTS - 1, np.int64)
        padded[2:] = context
        prev, skip = padded[1 : n + 1], padded[:n]
        pair = (prev * 40_503 + skip * 65_599 + 7) % 2_147_483_647 % self.hashed
        return prev, CONTEXTS + skip, 2 * CONTEXTS + pair

    def word_row(self, cls: np.ndarray, prev: np.ndarray) -> np.ndarray:
        return (prev * CLASSES + cls) * 2_654_435_761 % 4_294_967_291 % self.hashed

    def forward(self, target: np.ndarray, rows: tuple[np.ndarray, ...], negative: bool = False):
        """log P of each target's class and place, and what the gradient needs (if ``negative``: less the probabilities); all but the first is overwritten by the next call."""
        # Biases are log priors and updates are clipped, so exponentials stay far from the limits of float32.
        n, space = len(target), _space(len(target), self.rows.dtype)
        z, more = space.z[:n], space.more[:n]
        np.take(self.rows, rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            z += np.take(self.rows, r, axis=0, out=more, mode="clip")
        z += self.class_bias
        cls = target // WIDTH
        at = np.arange(n)
        log_p = z[at, cls].astype(np.float64)
        p = np.exp(z, out=z)
        total = p @ np.ones(p.shape[1], p.dtype)
        log_p -= np.log(total)
        known = np.flatnonzero(target < VOCABULARY)
        k, of = len(known), cls[known]
        word = self.word_row(of.astype(np.int64), rows[0][known])
        y, bias = space.y[:k], space.bias[:k]
        np.take(self.word, word, axis=0, out=y, mode="clip")
        y += np.take(self.word_bias, of, axis=0, out=bias, mode="clip")
        slot = target[known] % WIDTH
        chosen = y[np.arange(k), slot].astype(np.float64)
        q = np.exp(y, out=y)
        inside = q @ np.ones(WIDTH, q.dtype)
        log_p[known] += chosen - np.log(inside)
        if negative:
            p *= (-1 / total)[:, None]
            q *= (-1 / inside)[:, None]
        return log_p, cls, p, known, word, slot, q

    def gradient(self, target: np.ndarray, rows: tuple[np.ndarray, ...], out: Gradient) -> None:
        """Add observed less expected feature counts."""
        log_p, cls, p, known, word, slot, q = self.forward(target, rows, True)
        out.log_p += float(log_p.sum())
        p[np.arange(len(target)), cls] += 1
        q[np.arange(len(known)), slot] += 1
        space = _space(len(target), self.rows.dtype)
        for r in rows:
            _add_rows(out.rows, out.fired, r, p, space.at_class)
        _add_rows(out.word, out.word_fired, word, q, space.at_word)

    def update(self, g: Gradient) -> None:
        step = g.rows / (g.fired[:, None] * self.prior + DAMPING)
        self.rows += RATE * np.clip(step, -CLIP, CLIP)
        typical = self.word_prior.mean(axis=0)
        step = g.word / (g.word_fired[:, None] * typical + DAMPING)
        self.word += RATE * np.clip(step, -CLIP, CLIP)


class Gradient:
    def __init__(self, model: Model):
        self.rows, self.word = np.zeros_like(model.rows), np.zeros_like(model.word)
        self.fired, self.word_fired = np.zeros(len(model.rows), np.float32), np.zeros(len(model.word), np.float32)
        self.log_p, self.tokens = 0.0, 0

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, rows touched in it, their values and how often each fired), for all blocks of the class-level rows and then of the others."""
        first = 0
        for values, fired in ((self.rows, self.fired), (self.word, self.word_fired)):
            for at in range(0, len(values), BLOCK_ROWS):
                touched = np.flatnonzero(fired[at : at + BLOCK_ROWS])
                if len(touched):
                    yield first, touched.astype(np.int32).tobytes(), np.column_stack([values[at + touched], fired[at + touched]]).tobytes()
                first += 1

    def add_block(self, block: int, touched: bytes, values: bytes) -> None:
        of_rows = -(-len(self.rows) // BLOCK_ROWS)
        into, fired, at = (self.rows, self.fired, block) if block < of_rows else (self.word, self.word_fired, block - of_rows)
        rows = np.frombuffer(touched, np.int32) + at * BLOCK_ROWS
        x = np.frombuffer(values, np.float32).reshape(len(rows), -1)
        into[rows] += x[:, :-1]
        fired[rows] += x[:, -1]


class _Space:
    """Arrays of a batch, which are used again and again: fresh ones of this size cost more than what is done in them."""

    def __init__(self, n: int, kind):
        self.n, self.kind = n, kind
        self.z, self.more = np.empty((n, COLUMNS), kind), np.empty((n, COLUMNS), kind)
        self.y, self.bias = np.empty((n, WIDTH), kind), np.empty((n, WIDTH), np.float32)
        self.at_class, self.at_word = np.empty((n, COLUMNS // 2), np.int64), np.empty((n, WIDTH // 2), np.int64)


_SPACE: list[_Space] = []


def _space(n: int, kind) -> _Space:
    if not _SPACE or _SPACE[0].n < n or _SPACE[0].kind != kind:
        _SPACE[:] = [_Space(max(n, BATCH), kind)]
    return _SPACE[0]


def _add_rows(into: np.ndarray, fired: np.ndarray, index: np.ndarray, values: np.ndarray, at: np.ndarray) -> None:
    """into[index] += values for repeated indices too, and how often each row fires; ``at`` is room for the places.

    Two neighbouring numbers are added as one complex number, which halves the places.
    """
    at = at[: len(index)]
    pair = np.complex64 if into.dtype == np.float32 else np.complex128
    np.add((index * at.shape[1])[:, None], np.arange(at.shape[1]), out=at)
    np.add.at(into.reshape(-1).view(pair), at.reshape(-1), values.astype(into.dtype, copy=False).reshape(-1).view(pair))
    fired += np.bincount(index, minlength=len(fired)).astype(np.float32)


_KNOWN: dict = {}


def _once(key, make):
    """One object for each worker process and broadcast."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = make()
    return _KNOWN[key]


class _Batches:
    """Gathers the tokens of texts into numpy batches of about BATCH."""

    def __init__(self, model: Model):
        self.model, self.parts, self.n = model, [], 0

    def add(self, context: np.ndarray) -> bool:
        target, rows = np.minimum(context, VOCABULARY), self.model.features(context)
        for i in range(0, len(target), 8 * BATCH):
            self.parts.append((target[i : i + 8 * BATCH], *(r[i : i + 8 * BATCH] for r in rows)))
        self.n += len(target)
        return self.n >= BATCH

    def take(self):
        parts, self.parts, self.n = self.parts, [], 0
        if not parts:
            return
        if sum(len(p[0]) for p in parts) <= 8 * BATCH:
            parts = [tuple(np.concatenate(x) for x in zip(*parts))]
        for p in parts:
            for i in range(0, len(p[0]), BATCH):
                yield p[0][i : i + BATCH], tuple(r[i : i + BATCH] for r in p[1:])


def _contexts(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64)


_CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inside", pa.float64()), ("contexts", pa.binary()), ("tail", pa.list_(pa.string()))])
_CODED_DDL = "row long, doc_id long, learned boolean, n_tokens long, n_known long, base double, inside double, contexts binary, tail array<string>"


def coded(docs: DataFrame, heavy: list[tuple[str, int]], n: int, v: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, learned, text) as context numbers, with what the counts of the heavy words say and the words (tail) whose counts are elsewhere."""
    words_, key = docs.sparkSession.sparkContext.broadcast(heavy), uuid.uuid4().hex
    in_model = heavy[:VOCABULARY]
    rare_n, rare_v = n - sum(c for _, c in in_model), v - len(in_model)
    log10_base, log10_rare = np.log10(n + v + 1), np.log10(rare_n + rare_v + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lookup = _once(key, lambda: Lookup(words_.value))
        log_c = np.log10(lookup.counts + 1.0)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            texts, lo = strings(b.column(2)), 0
            while lo < len(texts):
                found, sizes = [], []
                while lo + len(sizes) < len(texts) and len(sizes) < 256 and len(found) < 300_000:
                    own = tokens(texts[lo + len(sizes)])
                    sizes.append(len(own))
                    found += own
                n_rows, length = len(sizes), np.array(sizes, np.int64)
                starts = np.cumsum(length) - length
                h, target, ctx = lookup(found)
                logs = log_c[h]  # 0 for what is not heavy
                rare = target == VOCABULARY
                base = np.add.reduceat(logs, starts) - length * log10_base
                inside = np.add.reduceat(np.where(rare, logs - log10_rare, 0.0), starts)
                missing = np.flatnonzero(h < 0)
                tails = np.diff(np.searchsorted(missing, np.append(starts, len(found))))
                tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tails)), pa.int32()), pa.array([found[i] for i in missing.tolist()], pa.string()))
                offsets = np.append(0, 2 * np.cumsum(length)).astype(np.int32)
                contexts = pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ctx.astype(np.uint16).tobytes())])
                of = slice(lo, lo + n_rows)
                columns = [pa.array(np.arange(row, row + n_rows)), b.column(0)[of], b.column(1)[of], pa.array(length), pa.array(length - tails), pa.array(base), pa.array(inside), contexts, tail]
                yield pa.RecordBatch.from_arrays(columns, schema=_CODED)
                row += n_rows
                lo += n_rows

    return docs.select("doc_id", "learned", "text").mapInArrow(work, _CODED_DDL)


def train(rows: DataFrame, heavy: list[tuple[str, int]], total: int, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Gradient updates over coded rows, each in one round; returns the model and the mean log10 P of each round's tokens before its update."""
    spark: SparkSession = rows.sparkSession
    context = spark.sparkContext
    model, history = Model(heavy, total), []
    for r in range(rounds):
        weights = context.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            m = weights.value
            g, held = Gradient(m), _Batches(m)
            for b in batches:
                for ctx in _contexts(b.column(0)):
                    g.tokens += len(ctx)
                    if held.add(ctx):
                        for x, features in held.take():
                            m.gradient(x, features, g)
            for x, features in held.take():
                m.gradient(x, features, g)
            if g.tokens:
                group = TaskContext.get().partitionId()
                yield _block_batch(group, -1, b"", np.array([g.log_p, g.tokens]).tobytes())
                for block in g.blocks():
                    yield _block_batch(group, *block)

        def add(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            m, at = weights.value, {}
            for b in batches:
                for group, i, touched, values in zip(*(c.to_pylist() for c in b.columns)):
                    g = at.setdefault(group // FAN_IN, (Gradient(m), np.zeros(2)))
                    if i < 0:
                        g[1][:] += np.frombuffer(values, np.float64)
                    else:
                        g[0].add_block(i, touched, values)
            for group, (g, ends) in at.items():
                if ends[1]:
                    yield _block_batch(group, -1, b"", ends.tobytes())
                for block in g.blocks():
                    yield _block_batch(group, *block)

        ddl = "group int, block int, touched binary, sums binary"
        part = rows.where(F.col("learned") & (F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)).select("contexts")
        tasks = max(1, total // rounds // TOKENS_A_TASK)
        part = part.coalesce(tasks)
        blocks = -(-len(model.rows) // BLOCK_ROWS) - (-len(model.word) // BLOCK_ROWS) + 1
        sums = part.mapInArrow(work, ddl)
        while True:
            tasks = -(-tasks // FAN_IN)
            place = F.floor(F.col("group") / FAN_IN).cast("int") * blocks + F.col("block") + 1
            sums = sums.repartitionById(tasks * blocks, place).mapInArrow(add, ddl)
            if tasks == 1:
                break
        sums = sums.collect()  # the weights' size
        weights.unpersist()
        if sums:
            g = Gradient(model)
            for x in sums:
                if x["block"] < 0:
                    g.log_p, g.tokens = np.frombuffer(x["sums"], np.float64)
                else:
                    g.add_block(x["block"], x["touched"], x["sums"])
            history.append(g.log_p / max(1, g.tokens) / np.log(10))
            model.update(g)
    return model, history


def _block_batch(group: int, block: int, touched: bytes, sums: bytes) -> pa.RecordBatch:
    columns = [pa.array([group], pa.int32()), pa.array([block], pa.int32()), pa.array([touched], pa.binary()), pa.array([sums], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["group", "block", "touched", "sums"])


def score(docs: DataFrame, training, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns from rows for which ``training`` holds."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("learned"), "text")
    counts = materialise(word_counts(docs.where("learned")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    heavy = heavy_words(counts)
    rows = materialise(coded(docs.withColumn("doc_id", F.col("doc_id").cast("long")), heavy, n, v), "lm-coded")
    model, _ = train(rows, heavy, n, rounds)
    weights = context.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "inside"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = weights.value
        for b in batches:
            held, lengths = _Batches(m), []
            logs: list[np.ndarray] = []
            for ctx in _contexts(b.column(len(names))):
                lengths.append(len(ctx))
                if held.add(ctx):
                    logs += [m.forward(x, features)[0] for x, features in held.take()]
            logs += [m.forward(x, features)[0] for x, features in held.take()]
            if not lengths:
                continue
            totals = np.add.reduceat(np.concatenate(logs), np.cumsum(lengths) - lengths) / np.log(10)
            columns = [b.column(i) for i in range(len(names) - 1)] + [pa.array(b.column(len(names) - 1).to_numpy() + totals)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:-1], "model"])

    tail = rows.where(F.size("tail") > 0).select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.count("c").alias("more_known"))
    scored = rows.select(*names, "contexts").mapInArrow(work, "row long, doc_id long, n_tokens long, n_known long, base double, model double")
    out = scored.join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def language_model(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of all rows; rows with crc32(doc_id as text) mod ``folds`` = ``held`` are held out."""
    fold = F.pmod(crc_of_id(), F.lit(folds))
    out = score(docs, F.coalesce(fold != held, F.lit(True)))
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
