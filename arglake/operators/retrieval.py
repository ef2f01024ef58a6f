"""Chunks, vectors and top-k search."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arglake.session import arrow_function
from arglake.work import shared_dir, written

#: Texts to the half-open character offsets of their tokens.
Encoder = Callable[[list[str]], list[list[tuple[int, int]]]]

CHUNK = "array<struct<chunk_index:int,text:string,start:int,end:int>>"
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Half-open offsets of chunks of at most ``size`` characters; a chunk ends behind the coarsest separator that its latter part has, and the next begins up to ``overlap`` before."""
    n, out, at = len(text), [], 0
    while at < n:
        end = min(n, at + size)
        if end < n:
            for s in separators:
                cut = text.rfind(s, at + overlap + 1, end) if s else end
                if cut > at + overlap:
                    end = cut + len(s) if s else end
                    break
            end = min(end, at + size)
        out.append((at, end))
        if end >= n:
            break
        back = max(at + 1, end - overlap)
        space = text.find(" ", back, end)
        at = space + 1 if at < space + 1 < end else back
    return out


def chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, chunk_index, chunk_id, text, start, end)."""

    @arrow_function(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk_index": i, "text": t[a:z].strip(), "start": a, "end": z} for i, (a, z) in enumerate(split_text(t or "", size, overlap))] if t else [])

    rows = docs.select(F.col(id_column).alias("id"), F.explode(cut(text_column)).alias("c"))
    return rows.select("id", "c.chunk_index", F.concat_ws("-", F.col("id").cast("string"), F.col("c.chunk_index").cast("string")).alias("chunk_id"), "c.text", "c.start", "c.end")


#: Tokens of a chunk and of its overlap with the one before.
TOKENS, SHARED = 800, 120
#: Characters whose tokens a task holds at once.
PASS = 1 << 20


def token_offsets(path: str) -> Callable[[], Encoder]:
    """Offsets by a file of the tokenizers library, which every machine has at ``path``."""

    def factory() -> Encoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.offsets for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return factory


def word_offsets() -> Encoder:
    """Offsets of runs that are not white space, where no tokenizer is at hand."""
    return lambda texts: [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]


def token_spans(offsets: list[tuple[int, int]], length: int, size: int = TOKENS, overlap: int = SHARED) -> list[tuple[int, int, int, int]]:
    """(start, end, fresh, tokens) of chunks of ``size`` tokens, each ``overlap`` tokens into the one before; the last ends the text.

    What lies between two tokens goes with the first, and what is before all with the first chunk.  Where a character
    is several tokens, a chunk begins and ends at its start.  ``fresh`` is where the part begins that no earlier chunk
    has: these parts, put together, are the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be smaller than the chunk")
    n, out, fresh = len(offsets), [], 0
    for at in range(0, n, size - overlap):
        last = min(n, at + size)
        start = offsets[at][0] if at else 0
        end = length if last == n else max(start, offsets[last][0])
        out.append((start, end, fresh, last - at))
        fresh = end
        if last == n:
            break
    return out


def token_chunks(docs: DataFrame, encoder: Callable[[], Encoder] = word_offsets, id_column: str = "doc_id", text_column: str = "text", size: int = TOKENS, overlap: int = SHARED) -> DataFrame:
    """(id, chunk_index, chunk_id, text, start, end, fresh, tokens) by offsets of tokens; a text without tokens has no chunk."""
    kind = dict(docs.dtypes)[id_column]
    names = ["id", "chunk_index", "text", "start", "end", "fresh", "tokens"]

    def work(batches):
        encode = encoder()
        for batch in batches:
            for ids, texts in _passes(batch):
                rows = [(key, i, t[a:z], a, z, f, n) for key, t, o in zip(ids, texts, encode(texts)) for i, (a, z, f, n) in enumerate(token_spans(o, len(t), size, overlap))]
                if rows:
                    key, index, text, *numbers = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(text, pa.string()), *(pa.array(c, pa.int32()) for c in numbers)], names=names)

    rows = docs.select(F.col(id_column).alias("id"), text_column).mapInArrow(work, f"id {kind}, chunk_index int, text string, start int, end int, fresh int, tokens int")
    return rows.select("id", "chunk_index", F.concat_ws("-", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "start", "end", "fresh", "tokens")


def _passes(batch: pa.RecordBatch, characters: int = PASS):
    """(ids, texts) of a batch of both, in passes of so many characters or one text: tokens and chunks of one pass are held at a time."""
    ids, texts, held = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        t = text.as_py() or ""
        if ids and held + len(t) > characters:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(key.as_py())
        texts.append(t)
        held += len(t)
    if ids:
        yield ids, texts


def contexts(chunks: DataFrame, questions: DataFrame, embedder=None, k: int = 10, question_id: str = "question_id", text: str = "question") -> DataFrame:
    """(question_id, chunks, context): the ``k`` chunks nearest to each question, best first, joined by blank lines."""
    embedder = embedder or hash_embedding
    own = embed(chunks.select("chunk_id", "text"), "text", embedder)
    asked = embed(questions.select(F.col(question_id).alias("query_id"), F.col(text).alias("q")), "q", embedder)
    asked = asked.select(F.concat(F.lit("?"), F.col("query_id").cast("string")).alias("query_id"), "embedding")
    found = top_k(own.select("chunk_id", "embedding"), asked, k, "chunk_id").join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "text")))
    out = found.groupBy("query_id").agg(ordered.alias("c"))
    return out.select(F.substring("query_id", 2, 1 << 30).alias(question_id), F.transform("c", lambda x: x.id).alias("chunks"), F.array_join(F.transform("c", lambda x: x.text), "\n\n").alias("context"))


def dot(a, b) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", query_id: str = "query_id", column: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, id, score, rank): for each query the ``k`` nearest vectors by squared distance, itself excluded; ties by id.

    The query set is held against all vectors in blocks: blocks of ``block`` queries are broadcast one after the other
    (a size that the parameter bounds), and each task keeps its k best of each query, so only k rows a query and task are
    shuffled.
    """
    kind = dict(vectors.dtypes)[id_column]
    queries = queries.select(F.col(query_id).alias("query_id"), F.col(column).alias("v"))
    rows = queries.toLocalIterator()
    out, held = None, []

    def search(found: list) -> DataFrame:
        ids = [r["query_id"] for r in found]
        q = np.array([r["v"] for r in found], np.float64)

        def work(batches):
            best: dict[int, list] = {i: [] for i in range(len(ids))}
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_pylist()
                x = np.array(b.column(1).to_pylist(), np.float64)
                for i in range(len(ids)):
                    diff = x - q[i]
                    d = np.einsum("ij,ij->i", diff, diff)
                    take = np.lexsort((np.array(own), d))[: k + 1] if len(own) > k else range(len(own))
                    best[i] = sorted(best[i] + [(float(d[j]), own[j]) for j in take if own[j] != ids[i]])[:k]
            rows_ = [(ids[i], v, s) for i, found_ in best.items() for s, v in found_]
            if rows_:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_)], names=["query_id", "id", "score"])

        return vectors.select(id_column, column).mapInArrow(work, f"query_id {kind}, id {kind}, score double")

    for r in rows:
        held.append(r)
        if len(held) == block:
            out, held = search(held) if out is None else out.unionByName(search(held)), []
    if held or out is None:
        last = search(held) if held else vectors.select(F.col(id_column).alias("query_id"), F.col(id_column).alias("id"), F.lit(0.0).alias("score")).where("false")
        out = last if out is None else out.unionByName(last)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


class VectorIndex:
    """Vectors in segments, one for each addition, with exact search that skips cells; a vector added again replaces the earlier one.

    A segment's rows lie in cells, each around a pivot (``cell=`` folders); a table of cells has the pivot, the radius and
    the number of rows.  The triangle inequality bounds the distance from a query to any row of a cell, so a search reads
    the nearest cells until they hold k rows, and then only those that may hold a nearer row.  What an addition replaces
    is noted, and left out of searches until ``compact`` writes one segment without it.
    """

    #: Pivots of a segment, at most.
    PIVOTS = 64

    def __init__(self, spark, path: str, id_column: str = "vec_id", column: str = "embedding"):
        self.spark, self.path, self.id_column, self.column = spark, path.rstrip("/"), id_column, column

    def _read(self, part: str, schema: str) -> DataFrame:
        """Rows of the folders of segments that are whole: the table of cells is written last."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _cells(self) -> DataFrame:
        """The cells of the segments that no compaction has taken up."""
        cells = self._read("cells", "cell int, pivot array<double>, radius double, n long, drops array<long>, segment long")
        return cells.join(F.broadcast(cells.select(F.explode("drops").alias("segment")).distinct()), "segment", "left_anti")  # a row a segment

    def _rows(self, kind: str) -> DataFrame:
        return self._read("rows", f"`{self.id_column}` {kind}, `{self.column}` array<double>, segment long, cell int")

    def _kind(self) -> str:
        return dict(self.spark.read.parquet(f"{self.path}/rows").dtypes)[self.id_column]

    def add(self, vectors: DataFrame) -> None:
        """Append a segment; of rows that share an id within it the one of largest hash stays."""
        one = F.max_by(F.col(self.column).cast("array<double>"), F.xxhash64(self.column))
        rows = vectors.where(F.col(self.id_column).isNotNull() & F.col(self.column).isNotNull()).groupBy(self.id_column).agg(one.alias(self.column))
        self._write(written(rows, "index-rows"))

    def _write(self, rows: DataFrame, drops: list[int] | None = None) -> None:
        segment = time.time_ns()
        few = rows.orderBy(F.xxhash64(self.id_column)).limit(self.PIVOTS).select(self.column).collect()
        if not few:
            return
        pivots = np.array([r[0] for r in few], np.float64)

        @arrow_function("struct<cell:int,distance:double>")
        def place(found: pd.Series) -> pd.DataFrame:
            x = np.array(found.tolist(), np.float64)
            d = np.sqrt(np.maximum(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0)) if len(x) < 64 else np.concatenate([np.sqrt(((x[i : i + 64, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(x), 64)])
            return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "distance": d.min(axis=1)})

        placed = rows.withColumn("_p", place(self.column))
        out = placed.select(self.id_column, self.column, F.lit(segment).alias("segment"), F.col("_p.cell").alias("cell"), F.col("_p.distance").alias("distance"))
        out = written(out, "index-placed")
        if drops is None and not (cells := self._cells()).isEmpty():
            kind = dict(rows.dtypes)[self.id_column]
            live = self._rows(kind).join(F.broadcast(cells.select("segment").distinct()), "segment", "left_semi")  # a row a segment
            old = live.join(rows.select(self.id_column), self.id_column, "left_semi").select(self.id_column, F.col("segment").alias("of"))
            old.withColumn("by", F.lit(segment)).write.mode("append").parquet(f"{self.path}/replaced")
        out.drop("distance").repartition("cell").write.mode("append").partitionBy("segment", "cell").parquet(f"{self.path}/rows")
        table = out.groupBy("segment", "cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
        centres = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
        table.join(F.broadcast(centres), "cell").select("cell", "pivot", "radius", "n", F.array(*map(F.lit, drops or [])).cast("array<long>").alias("drops"), "segment").coalesce(1).write.mode("append").partitionBy("segment").parquet(f"{self.path}/cells")  # PIVOTS rows

    def _live(self, rows: DataFrame, kind: str) -> DataFrame:
        """``rows`` without those that a later segment replaced; what a broken addition noted does not count."""
        noted = self._read("replaced", f"`{self.id_column}` {kind}, of long, `by` long")
        noted = noted.join(F.broadcast(self._cells().select(F.col("segment").alias("by")).distinct()), "by", "left_semi")
        if noted.isEmpty():
            return rows
        gone = noted.select(F.col(self.id_column).alias("_i"), F.col("of").alias("_s")).distinct()
        return rows.join(gone, (F.col(self.id_column) == F.col("_i")) & (F.col("segment") == F.col("_s")), "left_anti")

    def vectors(self) -> DataFrame:
        kind = self._kind()
        rows = self._rows(kind).join(F.broadcast(self._cells().select("segment").distinct()), "segment", "left_semi")
        return self._live(rows, kind).select(self.id_column, self.column)

    def compact(self) -> None:
        """One segment of all vectors; its table of cells names those that it takes the place of, whose rows are then deleted."""
        before = [r[0] for r in self._cells().select("segment").distinct().collect()]
        self._write(written(self.vectors(), "index-rows"), before)
        for s in before:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/segment={s}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", block: int = 256) -> DataFrame:
        """(query_id, id, score, rank), as ``top_k`` of all vectors."""
        return self.search_told(queries, k, query_id, block)[0]

    def search_told(self, queries: DataFrame, k: int, query_id: str = "query_id", block: int = 256) -> tuple[DataFrame, float]:
        """The same, and the share of rows that were skipped, over all queries.

        Blocks of queries are answered one after the other and written, so the plan does not grow with them; the
        table of cells, PIVOTS rows a segment, is held by the driver.
        """
        cells = self._cells().collect()
        kind = self._kind() if cells else dict(queries.dtypes)[query_id]
        pivots = np.array([c["pivot"] for c in cells], np.float64)
        radius, sizes = np.array([c["radius"] for c in cells]), np.array([c["n"] for c in cells], np.int64)
        paths, read, asked, parts = [(c["segment"], c["cell"]) for c in cells], 0, 0, []
        folder = f"{shared_dir(self.spark)}/arglake/{self.spark.sparkContext.applicationId}/found-{time.time_ns()}"
        held: list = []

        def nearest(rows_of: dict[int, set], found: list) -> DataFrame:
            """The k best of each query (by its place in the block) among the rows of its cells."""
            q, ids = np.array([r[1] for r in found], np.float64), [r[0] for r in found]
            wanted = {paths[c] for own in rows_of.values() for c in own}
            at = {paths[c]: [i for i, own in rows_of.items() if c in own] for c in {c for own in rows_of.values() for c in own}}
            chosen = F.array(*(F.struct(F.lit(s).cast("long").alias("segment"), F.lit(c).alias("cell")) for s, c in sorted(wanted)))
            rows = self._rows(kind).where(F.col("segment").isin(sorted({s for s, _ in wanted})) & F.col("cell").isin(sorted({c for _, c in wanted})))
            rows = self._live(rows.where(F.array_contains(chosen, F.struct("segment", "cell"))), kind).select(self.id_column, self.column, "segment", "cell")

            def work(batches):
                best: dict[int, list] = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    own, x, where = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.float64), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
                    places: dict[tuple, list] = {}
                    for i, w in enumerate(where):
                        places.setdefault(w, []).append(i)
                    for w, some in places.items():
                        for i in at.get(w, ()):
                            diff = x[some] - q[i]
                            d = np.einsum("ij,ij->i", diff, diff).tolist()
                            best[i] = sorted(best.get(i, []) + [(s, own[j]) for s, j in zip(d, some) if own[j] != ids[i]])[:k]
                rows_ = [(i, v, s) for i, found_ in best.items() for s, v in found_]
                if rows_:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_)], names=["q", "id", "score"])

            rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
            return rows.mapInArrow(work, f"q long, id {kind}, score double").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

        def answer(found: list) -> None:
            nonlocal read, asked
            q = np.array([r[1] for r in found], np.float64)
            d = np.sqrt(((q[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
            low = np.maximum(d - radius * (1 + 1e-12) - 1e-12, 0)
            first = {}
            for i in range(len(found)):
                order = np.argsort(d[i])
                first[i] = set(order[: 1 + int(np.searchsorted(np.cumsum(sizes[order]), k + 1))].tolist())
            bars = {r["q"]: r["bar"] for r in nearest(first, found).where(F.col("rank") == k).select("q", F.col("score").alias("bar")).collect()}  # a row a query of the block
            reach = {i: set(np.flatnonzero(low[i] ** 2 <= bars.get(i, np.inf) * (1 + 1e-9)).tolist()) for i in range(len(found))}
            asked += len(found) * int(sizes.sum())
            read += sum(int(sizes[list(own)].sum()) for own in reach.values())
            names = self.spark.createDataFrame([(i, r[0]) for i, r in enumerate(found)], f"q long, query_id {kind}")
            nearest(reach, found).join(F.broadcast(names), "q").select("query_id", "id", "score", "rank").write.parquet(f"{folder}/{len(parts)}")  # ``block`` rows
            parts.append(f"{folder}/{len(parts)}")

        if cells:
            for r in queries.select(query_id, self.column).toLocalIterator():
                held.append(r)
                if len(held) == block:
                    answer(held)
                    held = []
            if held:
                answer(held)
        schema = f"query_id {kind}, id {kind}, score double, rank long"
        out = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return out, 1 - read / asked if asked else 0.0


#: Characters of quotes that one pass holds.
QUOTES = 2_000_000


def contained(quotes: DataFrame, docs: DataFrame, quote_id: str, doc_id: str, quote: str = "quote", text: str = "text", most: int = QUOTES) -> DataFrame:
    """(quote_id, doc_id) of every quote that a text holds, once each; null quotes and texts are in nothing, an empty quote is in every text.

    The stated quotes are matched together, by an Aho-Corasick automaton in every task; quotes of more than ``most``
    characters in all are dealt over several passes, so what is broadcast is bounded.
    """
    kinds = quotes.schema[quote_id].dataType, docs.schema[doc_id].dataType
    context = docs.sparkSession.sparkContext

    def search(held: list) -> DataFrame:
        by_text: dict[str, list] = {}
        for i, q in held:
            by_text.setdefault(q, []).append(i)
        known = context.broadcast(by_text)

        def work(batches):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for q in known.value:
                if q:
                    machine.add_word(q, q)
            machine.make_automaton()
            for b in batches:
                out = []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if t is not None:
                        found = {q for _, q in machine.iter(t)} if len(machine) else set()
                        out += [(i, doc) for q in found | ({""} & known.value.keys()) for i in known.value[q]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], schema.field(0).type), pa.array([x[1] for x in out], schema.field(1).type)], schema=schema)

        schema = to_arrow_schema(StructType().add("quote_id", kinds[0]).add("doc_id", kinds[1]))
        return docs.select(doc_id, text).mapInArrow(work, f"quote_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}")

    out, held, size = None, [], 0
    for r in quotes.where(F.col(quote).isNotNull()).select(quote_id, quote).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size > most:
            out = search(held) if out is None else out.unionByName(search(held))
            held, size = [], 0
    if held or out is None:
        out = search(held) if out is None else out.unionByName(search(held))
    return out


def centroid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row with the mean vector (none without vectors): every task adds its vectors up, and passes on one row."""

    def work(batches):
        n, total = 0, None
        for b in batches:
            x = b.column(0).drop_null()
            if len(x):
                rows = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
                n, total = n + len(rows), rows.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "total"])

    sums = vectors.select(column).mapInArrow(work, "n long, total array<double>")
    places = sums.select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centroid")).where(F.size("centroid") > 0)


def centroid_ranking(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, similarity): cosine to the mean vector."""
    return vectors.join(F.broadcast(centroid(vectors, column))).select(id_column, cosine(F.col(column), F.col("centroid")).alias("similarity"))  # one row


def bottom_share(df: DataFrame, key: str, score: str, share: float = 0.03, small: int = 10_000, buckets: int = 1024) -> DataFrame:
    """The rows with the lowest scores: max(1, floor(share * n)) of them, ties by key; null scores are left out.

    The cut is found by counting scores in buckets, and again inside the bucket that holds it, until that is ``small`` or
    all its scores are equal: only that bucket's rows are sorted and limited, all lower ones are filtered.
    """
    rows = df.where(F.col(score).isNotNull())
    n, low, high = rows.agg(F.count("*"), F.min(score), F.max(score)).first()
    need = max(1, int(share * n))
    inside, lower = rows, rows.where("false")
    x = F.col(score).cast("double")
    while n > small and low < high:
        place = F.least(F.floor((x - float(low)) * buckets / (float(high) - float(low))), F.lit(buckets - 1))
        counts = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).collect())  # at most ``buckets`` rows
        taken = 0
        for _, k, lo, hi in counts:
            if taken + k >= need:
                break
            taken += k
        if (k, lo, hi) == (n, low, high):
            break
        lower = lower.unionByName(inside.where(F.col(score) < lo))
        inside = inside.where(F.col(score).between(lo, hi))
        need, n, low, high = need - taken, k, lo, hi
    return lower.unionByName(inside.orderBy(score, key).limit(need))


def hash_embedding(text: str, size: int = 64) -> list[float]:
    """A deterministic stand-in for a model: signed hashed words, unit length."""
    v = np.zeros(size)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % size] += 1 if h >> 63 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).astype("float32").tolist()


def embed(df: DataFrame, text: str, embedder=hash_embedding) -> DataFrame:
    """``df`` with a column ``embedding`` of a pluggable embedder (a callable from text to vector)."""

    @arrow_function("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(embedder)

    return df.withColumn("embedding", vector(text))
