"""Exact deduplication through an extendible-hash index kept in shared files.

Keys are 64-bit hashes of the normalised text.  A directory over the leading key bits is doubled until
no bucket holds more distinct keys than its capacity: prefixes that are still overfull are counted with
more bits.  The capacity grows with the keys, so that there are about BUCKETS buckets at most.  Each owner task holds a contiguous range of buckets, chains the entries of a key, compares
their bytes and writes its part of the index.

Skew: every task first folds equal texts of its own rows, byte by byte, into one entry, so a text that
makes up a third of all rows reaches its owner once a task.  Groups so large that there can be only
HOT_GROUPS of them are broadcast to the rows; other rows meet their group in a join by key.

Edge cases: a null text counts as empty; empty texts are equal to each other; a text of white space
only equals one space; rows with the same id and the same text form one group, of which one row stays;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arglake.llm.common import SPACE_PATTERN, materialise, partitions, release, text_or_empty, work_path

#: Distinct keys of a bucket before it splits, at least; buckets beyond which the capacity grows instead.
CAPACITY, BUCKETS = 4096, 1 << 14
#: Bits that are counted beyond the depth of even buckets, and at a time for what is then overfull.
MORE_BITS = 3
#: Groups that are broadcast, at most; a group of fewer rows than this never is.
HOT_GROUPS, HOT_ROWS = 50_000, 10_000
#: Bytes of distinct texts that a task folds before it passes them on.
FOLD_BYTES = 24 << 20

_ENTRY = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("norm", pa.string()), ("least", pa.int64()), ("rows", pa.int64()), ("least_rows", pa.int64())])
_ENTRY_DDL = "key long, sha string, norm string, least long, rows long, least_rows long"
_CLASS = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("least_rows", pa.int64())])
_CLASS_DDL = "bucket int, key long, chain int, sha string, keep_id long, group_size long, least_rows long"


def normalised(column: str = "text"):
    return F.regexp_replace(text_or_empty(column), SPACE_PATTERN, " ")


def build_directory(counts: dict[tuple[int, int], int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int]]]:
    """Split buckets of more than ``capacity`` keys, doubling the directory where it is too shallow.

    ``counts`` has the keys of prefixes (depth, prefix), of which none begins with another.  Returns the
    global depth and, for each of its 2**depth entries in order, (bucket, local depth); entries of one
    bucket are neighbours.
    """
    tree: dict[tuple[int, int], int] = {}
    for (d, k), n in counts.items():
        while True:
            tree[d, k] = tree.get((d, k), 0) + n
            if not d:
                break
            d, k = d - 1, k >> 1
    leaves, stack = [], [(0, 0)]
    while stack:
        depth, prefix = stack.pop()
        children = [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
        if tree.get((depth, prefix), 0) > capacity and any(c in tree for c in children):
            stack += children
        else:
            leaves.append((depth, prefix))
    depth = max(d for d, _ in leaves)
    return depth, [(b, d) for b, (d, _) in enumerate(leaves) for _ in range(1 << (depth - d))]


def _prefix_counts(keys: DataFrame, capacity: int, key_bits: int) -> tuple[dict[tuple[int, int], int], int]:
    """Distinct keys of prefixes, long enough that none has more than the capacity; and the capacity.  The driver gets a few counts for each bucket."""
    keys = materialise(keys.select("key").distinct(), "exact-keys")
    n = keys.count()
    capacity = max(capacity, -(-n // BUCKETS))
    bits = min(key_bits, max(1, n // capacity).bit_length() + MORE_BITS)

    def counted(some: DataFrame, bits: int) -> dict[int, int]:
        return {r[0]: r[1] for r in some.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("p")).count().collect()}

    out = {(bits, k): c for k, c in counted(keys, bits).items()}
    while bits < key_bits and (over := [k for (d, k), c in out.items() if d == bits and c > capacity]):
        some = keys.where(F.shiftrightunsigned("key", 64 - bits).isin(over))
        for k in over:
            del out[bits, k]
        bits = min(key_bits, bits + MORE_BITS)
        out |= {(bits, k): c for k, c in counted(some, bits).items()}
    return out, capacity


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows with equal texts; passes on what it holds whenever that exceeds FOLD_BYTES."""
    held: dict[tuple[int, str], list] = {}
    size = 0

    def out():
        rows = [(k, s, t, *v) for (k, t), (s, *v) in held.items()]
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2000]), _ENTRY)], schema=_ENTRY)
        held.clear()

    for b in batches:
        for doc, key, sha, norm in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (e := held.get((key, norm))) is None:  # equal only if all bytes are
                held[key, norm] = [sha, doc, 1, 1]
                size += len(norm) + 200
                if size > FOLD_BYTES:
                    yield from out()
                    size = 0
            else:
                e[2] += 1
                if doc == e[1]:
                    e[3] += 1
                elif doc is not None and (e[1] is None or doc < e[1]):
                    e[1], e[3] = doc, 1
    yield from out()
    release()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, key): chain the distinct texts of each key, comparing bytes."""
    at, chain, done = None, [], []

    def close():
        done.extend((at[0], at[1], i, sha, least, rows, n) for i, (_, sha, least, rows, n) in enumerate(chain))

    for b in batches:
        for bucket, key, sha, norm, least, rows, n in zip(*(b.column(i).to_pylist() for i in range(7))):
            if (bucket, key) != at:
                if at is not None:
                    close()
                at, chain = (bucket, key), []
            for e in chain:
                if e[0] == norm:
                    e[3] += rows
                    if least == e[2]:
                        e[4] += n
                    elif least is not None and (e[2] is None or least < e[2]):
                        e[2], e[4] = least, n
                    break
            else:
                chain.append([norm, sha, least, rows, n])
        if len(done) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _CLASS)], schema=_CLASS)
            done.clear()
    if at is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _CLASS)], schema=_CLASS)


def build_index(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """Build the index of ``docs`` under ``path``: ``keys`` (a row for each document), ``directory`` and
    ``buckets`` (a row for each distinct text, sorted by bucket, key and place in the chain).

    ``key_bits`` below 64 shortens the keys, so that tests can make them collide.  Returns the buckets.
    """
    spark: SparkSession = docs.sparkSession
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), normalised(text_column).alias("norm"))
    rows = rows.select("doc", key.alias("key"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm")
    rows.select("doc", "key", "sha").write.parquet(f"{path}/keys")
    counts, capacity = _prefix_counts(spark.read.parquet(f"{path}/keys"), capacity, key_bits)
    depth, directory = build_directory(counts, capacity)
    owners = partitions(spark)
    buckets = directory[-1][0] + 1
    entries = [(e, b, d, b * owners // buckets) for e, (b, d) in enumerate(directory)]
    spark.createDataFrame(entries, "entry int, bucket int, local_depth int, owner int").coalesce(1).write.parquet(f"{path}/directory")
    lookup = spark.read.parquet(f"{path}/directory").select("entry", "bucket", "owner")
    entry = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    folded = rows.mapInArrow(_fold, _ENTRY_DDL).withColumn("entry", entry)
    owned = folded.join(F.broadcast(lookup), "entry").select("owner", "bucket", "key", "sha", "norm", "least", "rows", "least_rows")
    owned = owned.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key").drop("owner")
    owned.mapInArrow(_own, _CLASS_DDL).write.parquet(f"{path}/buckets")
    return spark.read.parquet(f"{path}/buckets")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    path = work_path(spark, "exact-dedup")
    classes = build_index(docs, path, id_column, text_column, capacity, key_bits).select("key", "sha", "keep_id", "group_size", "least_rows")
    keys = spark.read.parquet(f"{path}/keys")
    large = F.col("group_size") >= max(HOT_ROWS, keys.count() // HOT_GROUPS)  # so there are at most HOT_GROUPS
    hot = F.broadcast(classes.where(large))
    rest = keys.join(hot.select("key", "sha"), ["key", "sha"], "left_anti")
    out = rest.join(classes.where(~large), ["key", "sha"]).unionByName(keys.join(hot, ["key", "sha"]))
    # Of rows that repeat both id and text one stays; all other rows are alone in their window.
    repeated = (F.col("least_rows") > 1) & F.col("doc").eqNullSafe(F.col("keep_id"))
    salt = F.when(repeated, F.lit(0)).otherwise(F.xxhash64("doc"))
    first = F.row_number().over(Window.partitionBy("sha", salt).orderBy("doc")) == 1
    kept = F.col("doc").eqNullSafe(F.col("keep_id")) & first
    return out.select(F.col("doc").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the row with the smallest id."""
    found = exact_duplicates(docs, **options)
    keep = found.where("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    rows = docs.withColumn("__sha", F.sha2(normalised().cast("binary"), 256))
    out = rows.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")), "left_semi")
    if found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1).count():
        out = out.dropDuplicates(["doc_id", "__sha"])  # rows that repeat id and text
    return out.select(docs.columns)


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AND row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM n
"""
