"""Difference of two snapshots of a table, where rows may have got new keys: a grace hash join, first on the key, then on the content.

A pass spills both sides into hash-partitioned Parquet in the shared folder (``part=.../``), narrow rows of digests and not
texts.  A task then owns some parts: it builds a dictionary from the smaller side, in which each value has a deque of its
rows in order, and probes with the other side, a row taking the head of its deque.  What the first pass, on the key, leaves
unpaired goes through the same pass again on the content.

Skew: a value with more rows than an even part (a text that makes up a third of the table, a repeated key) is cut into blocks
of ranks.  Both sides are ranked by a range sort, whose tasks number their rows and add the counts of the tasks before them,
and block b of one side meets block b of the other: the i-th row meets the i-th as if one deque had held them all.  Nothing
that grows with the input goes to the driver, into a broadcast or through one task.

Edge cases: null keys equal null keys and null values null values, and nothing else; rows that repeat a key pair one by one,
in the order of their digests, and the rest are inserts or deletes or pair by content; of rows that pair by content
null keys come last on both sides; an empty snapshot gives only inserts or only deletes, two of them an empty
result; further columns are ignored, also ones named like those of the result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arglake.llm.common import crc_of_id, materialise, partitions, release, work_path

#: Rows of a part, at most, on the smaller side: what a dictionary holds.
PART_ROWS = 50_000
#: Rows of one value that are worth a block of their own, at least.
LEAST_BLOCK = 64

#: Columns that order the rows of a value: name, ascending.
Order = list[tuple[str, bool]]
_PLACES = ("part", "block", "side", "build")


def _digest(*columns: Column) -> Column:
    """sha256 of values; each is told from null, and no two lists of values give the same bytes."""
    one = [F.coalesce(F.concat(F.lit("1"), F.sha2(c.cast("string").cast("binary"), 256)), F.lit("0")) for c in columns]
    return F.unhex(F.sha2(F.concat(*one).cast("binary"), 256))


def rows_of(df: DataFrame, key: str, compared: Sequence[str], content: Sequence[str], row: Column) -> DataFrame:
    """(key, content, row_hash, row_digest, c0, c1, ...) of a snapshot: digests of the content, of the compared columns together and of each."""
    cells = [_digest(F.col(c)).alias(f"c{i}") for i, c in enumerate(compared)]
    return df.select(F.col(key).alias("key"), _digest(*map(F.col, content)).alias("content"), F.xxhash64(*(F.struct(c) for c in compared)).alias("row_hash"), row.alias("row_digest"), *cells)


def _number(by: str) -> Callable:
    """Rows come sorted by value and order: adds the task's number and the row's place among those of its value in this task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, n = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            places = []
            for v in b.column(b.schema.get_field_index(by)).to_pylist():
                last, n = (v, n + 1) if v == last else (v, 0)
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "task", "place"])

    return number


def _sorting(order: Order, when: Column | None = None) -> list[Column]:
    columns = [(F.col(n) if when is None else F.when(when, F.col(n)), up) for n, up in order]
    return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in columns]


def _ranked(df: DataFrame, by: str, order: Order, tasks: int) -> DataFrame:
    """``df`` with ``rank``, the row's place (from 0) among the rows of its value; no task holds a value's rows together."""
    ranged = df.repartitionByRange(tasks, F.xxhash64(by), *_sorting(order)).sortWithinPartitions(by, *_sorting(order))
    schema = T.StructType([*df.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("place", T.LongType())])
    placed = materialise(ranged.mapInArrow(_number(by), schema), "diff-places")
    counts = placed.groupBy(by, "task").agg((F.max("place") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("_by"), F.col("task").alias("_task"), before.alias("_before"))
    # (value, task): a hot value is spread over as many keys as tasks have rows of it
    met = placed.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("task") == F.col("_task")))
    return met.select(*df.columns, (F.col("place") + F.col("_before")).alias("rank"))


def _prober(names: list[str], by: str, out: pa.Schema) -> Callable:
    """Rows come sorted by part, the smaller side first, each side in order: build, probe, give out the rest."""
    at = {n: i for i, n in enumerate(names)}
    keep = [i for n, i in at.items() if n not in _PLACES]
    part_of, value_of, block_of, side_of, build_of = (at[n] for n in ("part", by, "block", "side", "build"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done = None, {}, []

        def give(*rows):
            two = [None, None]
            for r in rows:
                two[r[side_of]] = r
            done.append([r[i] if r else None for r in two for i in keep] + [r is not None for r in two])

        def flushed(least: int):
            if len(done) >= least:
                columns = list(zip(*done))
                done.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        def rest():
            for rows in held.values():
                for r in rows:
                    give(r)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[part_of] != part:
                    rest()
                    part = row[part_of]
                value = row[value_of], row[block_of]
                if row[build_of]:
                    held.setdefault(value, deque()).append(row)
                elif rows := held.get(value):
                    give(rows.popleft(), row)
                else:
                    give(row)
            yield from flushed(5000)
        rest()
        yield from flushed(1)
        release()

    return probe


def grace_join(old: DataFrame, new: DataFrame, by: str, old_order: Order, new_order: Order, part_rows: int = PART_ROWS, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Full outer join of rows with equal ``by`` (null equals null), the i-th of a value's old rows with the i-th of its new rows.

    Both frames have the same columns; they return as ``o_*`` and ``n_*``, beside ``has_old`` and ``has_new``.
    """
    spark = old.sparkSession
    sizes = [d.count() for d in (old, new)]
    parts = max(partitions(spark), -(-max(sizes) // part_rows))
    block = max(least_block, max(sizes) // parts)
    smaller = 0 if sizes[0] <= sizes[1] else 1
    # values with more rows than an even part, of which there are fewer than parts; counted before any row is dealt by value
    hot = [df.groupBy(by).count().where(F.col("count") > block).select(F.col(by).alias("_hot")) for df in (old, new)]
    values = materialise(hot[0].unionByName(hot[1]).distinct(), f"diff-{by}-hot")
    any_hot, same = not values.isEmpty(), F.col(by).eqNullSafe(F.col("_hot"))
    met = []
    for side, (rows, order) in enumerate(((old, old_order), (new, new_order))):
        if any_hot:
            rows = materialise(rows, f"diff-{by}-rows")
            ranked = _ranked(rows.join(values, same, "left_semi"), by, order, parts)
            ranked = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long")).drop("rank")
            rows = rows.join(values, same, "left_anti").withColumn("block", F.lit(0).cast("long")).unionByName(ranked)
        else:
            rows = rows.withColumn("block", F.lit(0).cast("long"))
        path = work_path(spark, f"diff-{by}-{side}")
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(by) + F.col("block"), F.lit(parts)).cast("int"))
        dealt.repartitionById(parts, F.col("part")).write.partitionBy("part").parquet(path)
        spilled = spark.read.schema(dealt.schema).parquet(path)
        met.append(spilled.withColumn("side", F.lit(side)).withColumn("build", F.lit(side == smaller)))
    both = met[0].unionByName(met[1])
    orders = [*_sorting(old_order, F.col("side") == 0), *_sorting(new_order, F.col("side") == 1)]
    both = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("build").desc(), *orders)
    kept = [f for f in both.schema.fields if f.name not in _PLACES]
    schema = T.StructType([T.StructField(p + f.name, f.dataType) for p in ("o_", "n_") for f in kept] + [T.StructField(n, T.BooleanType()) for n in ("has_old", "has_new")])
    return materialise(both.mapInArrow(_prober(both.columns, by, to_arrow_schema(schema)), schema), f"diff-{by}")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str], content: Sequence[str], row: Column | None = None, part_rows: int = PART_ROWS, least_block: int = LEAST_BLOCK) -> DataFrame:
    """One row for each pair and each unpaired row: key, old_key, op, changed, row_digest (and old_digest).

    Rows with equal keys pair first.  Of the rest, rows that are equal in the ``content`` columns pair, the i-th smallest old
    key with the i-th largest new key.  ``op`` is same, update, rekey, insert or delete; ``changed`` names the ``compared``
    columns in which a pair differs; ``row`` is the digest of a row (sha256 of the compared values unless given).
    """
    row = F.lower(F.hex(_digest(*map(F.col, compared)))) if row is None else row
    before, after = (rows_of(df, key, compared, content, row) for df in (old, new))
    ties = [("row_hash", True)]
    first = grace_join(before, after, "key", ties, ties, part_rows, least_block)
    left = [first.where(~F.col(f"has_{b}")).select([F.col(a + n).alias(n) for n in before.columns]) for a, b in (("o_", "new"), ("n_", "old"))]
    second = grace_join(left[0], left[1], "content", [("key", True), *ties], [("key", False), *ties], part_rows, least_block)
    differs = F.concat_ws(",", *(F.when(F.col("has_old") & F.col("has_new") & (F.col(f"o_c{i}") != F.col(f"n_c{i}")), F.lit(c)) for i, c in enumerate(compared)))

    def told(joined: DataFrame, pair: Column) -> DataFrame:
        op = F.when(~F.col("has_old"), "insert").when(~F.col("has_new"), "delete").otherwise(pair)
        return joined.select(F.when(F.col("has_new"), F.col("n_key")).otherwise(F.col("o_key")).alias("key"), F.col("o_key").alias("old_key"), op.alias("op"), differs.alias("changed"), F.col("n_row_digest").alias("row_digest"), F.col("o_row_digest").alias("old_digest"))

    paired = first.where("has_old and has_new")
    return told(paired, F.when(differs == "", "same").otherwise("update")).unionByName(told(second, F.lit("rekey")))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later state of ``documents`` that the query compares: crc32 of the decimal doc_id modulo 25 changes rows."""
    rest = F.coalesce(crc_of_id() % 25, F.lit(6))
    other = F.lit(-1) - F.col("doc_id")
    changed = docs.withColumn("_rest", rest).where("_rest <> 0").select(
        F.when(F.col("_rest").isin(3, 4), other).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("_rest") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_rest") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("_rest") == 2, F.col("lang")).when(F.col("_rest") != 4, F.col("source")).alias("source"),
        F.when(F.col("_rest") == 5, F.array(F.col("doc_id"), other)).otherwise(F.array(F.lit(None).cast("long"))).alias("_keys"),
    )
    keys = F.explode("_keys").alias("_key")
    return changed.select("doc_id", "text", "lang", "source", keys).select(F.coalesce("_key", "doc_id").alias("doc_id"), "text", "lang", "source")


def document_row() -> Column:
    """Digest of a document's row: text, lang and source by lines, null as ``~``."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in ("text", "lang", "source"))).cast("binary"), 256)


ORACLE = """
WITH e AS (SELECT doc_id AS k, text, lang, source FROM documents),
r AS (SELECT k, text, lang, source, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(k::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 25 AS m FROM e),
l AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - k ELSE k END AS k, CASE m WHEN 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
  CASE m WHEN 2 THEN source ELSE lang END AS lang, CASE m WHEN 2 THEN lang WHEN 4 THEN NULL ELSE source END AS source FROM r WHERE m <> 0
  UNION ALL SELECT -1 - k, text, lang, source FROM r WHERE m = 5),
le AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS h FROM l),
p AS (SELECT e.k AS ok, e.text AS ot, e.lang AS ol, e.source AS os, l.k AS nk, l.text AS nt, l.lang AS nl, l.source AS ns, l.h FROM e FULL JOIN le l ON e.k = l.k),
uo AS (SELECT *, row_number() OVER (PARTITION BY ot, ol ORDER BY ok) AS i FROM p WHERE nk IS NULL),
un AS (SELECT *, row_number() OVER (PARTITION BY nt, nl ORDER BY nk DESC) AS i FROM p WHERE ok IS NULL),
j AS (SELECT true AS by_key, ok, ot, ol, os, nk, nt, nl, ns, h FROM p WHERE ok IS NOT NULL AND nk IS NOT NULL
  UNION ALL SELECT false, o.ok, o.ot, o.ol, o.os, n.nk, n.nt, n.nl, n.ns, n.h FROM uo o FULL JOIN un n ON o.ot IS NOT DISTINCT FROM n.nt AND o.ol IS NOT DISTINCT FROM n.nl AND o.i = n.i),
c AS (SELECT *, CASE WHEN ok IS NULL OR nk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) END AS changed FROM j)
SELECT coalesce(nk, ok) AS key, ok AS old_key, CASE WHEN ok IS NULL THEN 'insert' WHEN nk IS NULL THEN 'delete' WHEN NOT by_key THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, h AS row_sha256 FROM c
"""
