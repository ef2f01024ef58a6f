"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables and exact reranking.

1. *Classes.*  Equal vectors are one entry of the index with its K + 1 smallest ids: no more can ever be returned, the query's own included.
2. *Hash.*  A table turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the nearest
   signed axis; with many rows a second and third turn of fewer axes are appended, so that buckets stay near BUCKET_ROWS.
   Where lengths differ, vectors are lifted to one length by one more component, so that the nearest unit vector has the largest product.
3. *Probes.*  A query visits the buckets, of all tables together, whose axes have the largest turned components.  How many is
   measured: for a bounded sample of queries (SAMPLE) the true neighbours are found by a scan, and the number of probes at which
   a TARGET share of them is met is used for all.
4. *Reranking.*  Probes meet their bucket's entries in slices of bounded size; the task takes exact products in double precision
   and passes on the best K of each probe, and a query's best K of all probes are kept.  A query that met fewer than K
   candidates visits every bucket of one table, that is, all rows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id take no part; vectors meet only
those with as many components; rows that repeat id and vector count once, rows that share an id only are candidates of
their own but never of each other's id, and a query's answers are those of its id; fewer candidates than K return all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arglake.llm.common import materialise, release

#: Neighbours of a query; one id in so many is a query.
K, EVERY = 20, 20
#: Tables; rows of a bucket beyond which hashes get more axes.
TABLES, BUCKET_ROWS = 16, 4096
#: Entries of a slice of a bucket, which a task holds at once.
SLICE_ROWS = 4096
#: Queries whose true neighbours are looked up, at most, and the share of these that the probes must meet.
SAMPLE, TARGET = 128, 0.96
#: Larger slices are used where more buckets than this would be cut.
CUT_BUCKETS = 1 << 16

_ANSWER_DDL = "asker string, id long, score double"
_ANSWER = pa.schema([("asker", pa.string()), ("id", pa.int64()), ("score", pa.float64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their (power of two) width, scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


class Hash:
    """The tables' hash functions for vectors of ``width`` components: the same on every machine.

    ``axes`` are the axes of the turns that make up a hash; ``longest`` is the length to which vectors are lifted, 0 for none.
    """

    def __init__(self, width: int, axes: tuple[int, ...] = (), longest: float = 0.0, tables: int = TABLES, seed: int = 7):
        self.width, self.longest, self.tables = width, longest, tables
        self.padded = 1 << max(0, (width + (longest > 0) - 1).bit_length())
        self.axes = axes or (self.padded,)
        random = np.random.default_rng([seed, self.padded])
        self.signs = random.choice(np.array([-1.0, 1.0]), (tables, len(self.axes), 3, self.padded))
        self.buckets = int(np.prod([2 * a for a in self.axes]))

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows as unit vectors of the padded width."""
        out = np.zeros((len(x), self.padded))
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        norms = np.linalg.norm(scaled, axis=1, keepdims=True)
        out[:, : self.width] = scaled / norms
        if self.longest and not query:
            share = np.minimum(norms[:, 0] * np.abs(x).max(axis=1) / self.longest, 1.0)
            out[:, : self.width] *= share[:, None]
            out[:, self.width] = np.sqrt(1.0 - share * share)
        return out

    def turned(self, units: np.ndarray, table: int) -> list[np.ndarray]:
        """For each turn of the table the components along the signed axes: first the positive ones, then the negative."""
        out = []
        for signs, axes in zip(self.signs[table], self.axes):
            x = units
            for s in signs:
                x = hadamard(x * s)
            out.append(np.concatenate([x[:, :axes], -x[:, :axes]], axis=1))
        return out

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Bucket numbers by row and table."""
        out = np.empty((len(units), self.tables), np.int64)
        for t in range(self.tables):
            code = np.zeros(len(units), np.int64)
            for x in self.turned(units, t):
                code = code * x.shape[1] + x.argmax(axis=1)
            out[:, t] = code + t * self.buckets
        return out

    def probes(self, units: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` best buckets of all tables by row, best first, -1 where there are no more."""
        scores, codes = [], []
        for t in range(self.tables):
            best, code = np.zeros((len(units), 1)), np.zeros((len(units), 1), np.int64)
            for x in self.turned(units, t):
                total = (best[:, :, None] + x[:, None, :]).reshape(len(units), -1)
                after = (code[:, :, None] * x.shape[1] + np.arange(x.shape[1])).reshape(len(units), -1)
                keep = np.argsort(-total, axis=1, kind="stable")[:, :most]  # no worse prefix leads to a better sum
                best, code = np.take_along_axis(total, keep, 1), np.take_along_axis(after, keep, 1)
            scores.append(best)
            codes.append(code + t * self.buckets)
        scores, codes = np.concatenate(scores, axis=1), np.concatenate(codes, axis=1)
        keep = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(codes, keep, 1)


def axes_for(rows: int, padded: int, bucket_rows: int = BUCKET_ROWS) -> tuple[int, ...]:
    """Axes of the turns of a hash, so that a bucket has about ``bucket_rows`` rows or fewer."""
    axes, buckets = [padded], 2 * padded
    while rows > buckets * bucket_rows and len(axes) < 4:
        more = 1
        while more < padded and rows > buckets * 2 * more * bucket_rows:
            more *= 2
        axes.append(more)
        buckets *= 2 * more
    return tuple(axes)


def matrix(raw: list[bytes], width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, width).astype(np.float64)


def best_of(entries: np.ndarray, ids: list[list[int]], query: np.ndarray, most: int) -> list[tuple[float, int, int]]:
    """(product negated, id, entry) of the ``most`` ids of largest product, ties to smaller ids."""
    rough = entries @ query
    some = np.arange(len(rough))
    if len(rough) > most:
        bar = np.partition(rough, len(rough) - most)[len(rough) - most]
        some = np.flatnonzero(rough >= bar - 1e-9 * (1.0 + abs(bar)))
    exact = (entries[some] * query).sum(axis=1)  # summed in one order, whatever rows stand beside
    return sorted((-s, i, e) for s, e in zip(exact.tolist(), some.tolist()) for i in ids[e])[:most]


def _vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, class, vector) of the rows that take part; equal vectors have one class."""
    kind = "float" if dict(table.dtypes)[vector_column] == "array<float>" else "double"
    v, zero = F.col("vector"), F.lit(0).cast(kind)
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(plain).select("id", F.transform(v, lambda x: x + zero).alias("vector"))  # -0.0 as 0.0
    return rows.select("id", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector"))).alias("class"), "vector")


def classes(rows: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(class, asked, width, norm, ids, vector): distinct vectors with their ``most`` smallest ids."""
    v = F.col("vector")
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    least = rows.dropDuplicates(["id", "class"]).withColumn("place", place).where(F.col("place") <= most)
    out = least.groupBy("class").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))
    out = out.join(queries.select("class").distinct().withColumn("asked", F.lit(True)), "class", "left")
    top = F.array_max(F.transform(v, lambda x: F.abs(x).cast("double")))
    norm = top * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))
    return out.select("class", F.coalesce("asked", F.lit(False)).alias("asked"), F.size(v).alias("width"), norm.alias("norm"), "ids", "vector")


def _bytes_of(kind: str) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            raw = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes) * raw.itemsize
            raw = raw.tobytes()
            packed = pa.array([raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=b.schema.names)

    return pack


def _scan(sample: list[tuple[str, bytes]], width: int, kind: str, most: int) -> Callable:
    """The best entries of a task for each of a few queries, without those of the query's own class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, kept = matrix([r for _, r in sample], width, kind), [[] for _ in sample]
        for b in batches:
            if b.num_rows:
                names, ids, raw = (c.to_pylist() for c in b.columns)
                entries = matrix(raw, width, kind)
                for q, (own, _) in enumerate(sample):
                    new = [(s, i, raw[e]) for s, i, e in best_of(entries, ids, queries[q], 2 * most + 1) if names[e] != own]
                    kept[q] = sorted(kept[q] + new)[:most]
        rows = [(q, i, -s, r) for q, found in enumerate(kept) for s, i, r in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.float64(), pa.binary()))], names=["q", "id", "score", "vector"])

    return scan


def measured_probes(index: DataFrame, width: int, kind: str, hashing: Hash, k: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    """How many probes meet a ``target`` share of the true neighbours of at most ``sample`` queries (those of smallest hash)."""
    picked = index.where("asked").orderBy(F.xxhash64("class"), "class").select("class", "vector").limit(sample).collect()
    if not picked:
        return 1
    found = index.select("class", "ids", "vector").mapInArrow(_scan([tuple(r) for r in picked], width, kind, k), "q int, id long, score double, vector binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    true = found.withColumn("place", place).where(F.col("place") <= k).select("q", "vector").collect()  # sample * k rows at most
    if not true:
        return 1
    asked_of = np.array([r["q"] for r in true])
    codes = hashing.codes(hashing.unit(matrix([bytes(r["vector"]) for r in true], width, kind), False))
    queries = hashing.unit(matrix([bytes(r["vector"]) for r in picked], width, kind), True)
    most, all_of_them = 64, hashing.tables * hashing.buckets
    while True:
        most = min(most, all_of_them)
        order = hashing.probes(queries, most).tolist()
        met = []
        for q, own in enumerate(order):
            rank = {b: i for i, b in enumerate(own)}
            met += [min((rank[c] for c in found if c in rank), default=all_of_them) for found in codes[asked_of == q].tolist()]
        need = sorted(met)[max(0, int(np.ceil(target * len(met))) - 1)]
        if need < most or most == all_of_them:
            return min(need + 1, all_of_them)
        most *= 4


def _coded(hashing: Hash, width: int, kind: str, probes: int) -> Callable:
    """Adds the buckets that an entry is in and, if it is asked for, those that it visits."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                vectors, asked = matrix(b.column(3).to_pylist(), width, kind), np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False))
                buckets = hashing.codes(hashing.unit(vectors, False))
                visits: list[list[int] | None] = [None] * b.num_rows
                if len(asked):
                    for i, v in zip(asked.tolist(), hashing.probes(hashing.unit(vectors[asked], True), probes).tolist()):
                        visits[i] = v
                kinds = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(buckets.tolist(), kinds), pa.array(visits, kinds)], names=["class", "ids", "vector", "buckets", "visits"])
        release()

    return coded


def _rerank(width: int, kind: str, most: int) -> Callable:
    """Rows come sorted by bucket and slice, the entries before the probes."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raw, ids, entries, done = None, [], [], None, []

        def given(least: int):
            if len(done) >= least:
                columns = list(zip(*done))
                done.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANSWER)], schema=_ANSWER)

        for b in batches:
            for bucket, part, asker, group, vector in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, part) != at:
                    at, raw, ids, entries = (bucket, part), [], [], None
                if asker is None:
                    raw.append(vector)
                    ids.append(group)
                elif raw:
                    if entries is None:
                        entries = matrix(raw, width, kind)
                    done += [(asker, i, -s) for s, i, _ in best_of(entries, ids, np.frombuffer(vector, kind).astype(np.float64), most)]
            yield from given(5000)
        yield from given(1)
        release()

    return rerank


def _met(entries: DataFrame, visits: DataFrame, width: int, kind: str, most: int, slice_rows: int) -> DataFrame:
    """(asker, id, score): the best of each visited bucket; one of many entries is cut into slices, each of which is visited."""
    counts = entries.groupBy("bucket").count()
    least = max(slice_rows, entries.count() // CUT_BUCKETS)
    large = counts.where(F.col("count") > least).select("bucket", F.ceil(F.col("count") / least).cast("int").alias("slices"))
    large = F.broadcast(large)  # CUT_BUCKETS rows at most
    slices, no_one, nothing = F.coalesce("slices", F.lit(1)), F.lit(None).cast("string"), F.lit(None).cast("array<long>")
    own = entries.join(large, "bucket", "left").select("bucket", F.pmod(F.xxhash64("class"), slices).cast("int").alias("slice"), no_one.alias("asker"), "ids", "vector")
    asked = visits.join(large, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("class").alias("asker"), nothing.alias("ids"), "vector")
    met = own.unionByName(asked).repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", F.col("asker").asc_nulls_first())
    return met.mapInArrow(_rerank(width, kind, most), _ANSWER_DDL)


def _first(found: DataFrame, most: int) -> DataFrame:
    """(class, answers): the best ``most`` distinct ids, in order."""
    once = found.groupBy("asker", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.col("score").desc(), "id"))
    answers = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id")))
    return once.withColumn("place", place).where(F.col("place") <= most).groupBy(F.col("asker").alias("class")).agg(answers.alias("answers"))


def _answers(index: DataFrame, width: int, kind: str, rows: int, lift: float, k: int, tables: int, sample: int, target: float, bucket_rows: int, slice_rows: int) -> DataFrame:
    """(class, answers) of the classes that are asked for, among vectors of one width."""
    hashing = Hash(width, axes_for(rows, Hash(width, (), lift, 1).padded, bucket_rows), lift, tables)
    probes = measured_probes(index, width, kind, hashing, k, sample, target)
    ddl = "class string, ids array<long>, vector binary, buckets array<long>, visits array<long>"
    coded = materialise(index.select("class", "asked", "ids", "vector").mapInArrow(_coded(hashing, width, kind, probes), ddl), "nearest-coded")
    asked = coded.where("visits IS NOT NULL")
    entries = coded.select("class", "ids", "vector", F.explode("buckets").alias("bucket"))
    visits = asked.select("class", "vector", F.explode("visits").alias("bucket"))
    answers = materialise(_first(_met(entries, visits, width, kind, k + 1, slice_rows), k + 1), "nearest-answers")
    enough = index.select(F.explode("ids").alias("id")).distinct().limit(k + 1).count()
    short = asked.join(answers.where(F.size("answers") >= enough), "class", "left_anti")
    if short.isEmpty():
        return answers
    # too few candidates: these visit every bucket of the first table, which hold all rows
    every = short.select("class", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashing.buckets - 1).cast("long"))).alias("bucket"))
    first = coded.select("class", "ids", "vector", F.col("buckets")[0].alias("bucket"))
    whole = materialise(_first(_met(first, every, width, kind, k + 1, slice_rows), k + 1), "nearest-whole")
    return answers.join(short, "class", "left_anti").unionByName(whole)


def search(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, every: int = EVERY, tables: int = TABLES, sample: int = SAMPLE, target: float = TARGET, bucket_rows: int = BUCKET_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row whose id ``every`` divides."""
    rows = _vectors(table, id_column, vector_column)
    kind = "<f4" if dict(rows.dtypes)["vector"] == "array<float>" else "<f8"
    queries = rows.where(F.col("id") % every == 0).select("id", "class").distinct()
    known = classes(rows, queries, k + 1)
    ddl = "class string, asked boolean, width int, norm double, ids array<long>, vector binary"
    known = materialise(known.mapInArrow(_bytes_of(kind), ddl), "nearest-classes")
    found = None
    sizes = known.groupBy("width").agg(F.count("*").alias("rows"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    for width, size, least, most in sorted(map(tuple, sizes.collect())):  # a row for each number of components
        lift = 0.0 if least >= most * (1 - 1e-6) else most
        part = _answers(known.where(F.col("width") == width), width, kind, size, lift, k, tables, sample, target, bucket_rows, slice_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a vector of many queries is a hot key of the queries, whose side adaptive execution can split
    told = queries.join(found, "class").select("id", F.slice(F.filter("answers", lambda x: x["id"] != F.col("id")), 1, k).alias("answers"))
    told = told.select(F.col("id").alias("query_id"), F.posexplode("answers").alias("place", "a"))
    return told.select("query_id", (F.col("place") + 1).alias("rank"), F.col("a.id").alias("vec_id"), (-F.col("a.less")).alias("score"))
