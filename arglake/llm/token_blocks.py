"""Token ids as patched frame-of-reference blocks.

File format (little endian), one file to a shard:

    "PFOR0002" | n_ids u64 | n_docs u32 | n_blocks u32
    block starts   (n_blocks + 1) x u32   offsets into the body
    doc ids        n_docs x i64
    null bitmap    (n_docs + 7) / 8 bytes, least bit first: documents without an id
    doc lengths    n_docs x u32           ids of each document, the end id included
    body           the blocks

A block holds 128 ids (the last one of a file is padded with its own minimum):

    minimum u32 | width u8 | n_exceptions u8 | packed 16 * width bytes
    | exception places n x u8 | exception high parts n x u32

The minimum is subtracted; the width is the one that a chosen percentile of the block's differences
fits; what is above keeps its low bits in the packed part and its high bits in the exception list.
Packing is vertical: 4 lanes of 32 values.

A file is one binary value of a Parquet table (shard, part, bytes): Spark's commit protocol then makes
the write safe against lost executors on any store, and ``export`` lays them down as plain files.

Edge cases: a null text counts as empty and has the end id only; a document is never split over files,
however long; rows with equal ids are ordered by text; an empty table writes no file and reads back as
no row; ids up to 2**32 - 1 are kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arglake.llm.common import partitions, work_path

MAGIC = b"PFOR0002"
BLOCK = 128
#: The percentile of a block's differences that its width must hold.
PERCENTILE = 90
#: A file is closed once it holds so many ids.
FILE_IDS = 1 << 20
#: Chunks of text that a worker remembers.
KNOWN = 1_000_000


# --- the format -----------------------------------------------------------------------------------


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(k, 128) values below 2**width to (k, 4 * width) words."""
    lanes = v.reshape(len(v), 32, 4)
    out = np.zeros((len(v), width, 4), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, word] |= lanes[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(v), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), width, 4)
    out = np.empty((len(words), 32, 4), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        x = lanes[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | lanes[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = x & mask
    return out.reshape(len(words), BLOCK)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One file for the concatenated ``ids`` of documents."""
    named = pa.array(doc_ids, pa.int64())
    nulls = np.packbits(named.is_null().to_numpy(zero_copy_only=False), bitorder="little")
    n = len(ids)
    k = -(-n // BLOCK)
    v = np.empty(k * BLOCK, np.uint32)
    v[:n] = ids
    if n % BLOCK:
        v[n:] = v[n - n % BLOCK : n].min()
    v = v.reshape(k, BLOCK)
    low = v.min(axis=1, initial=0xFFFFFFFF) if k else np.empty(0, np.uint32)
    v = v - low[:, None]
    bits = _bits(v)
    at = (BLOCK * percentile + 99) // 100 - 1
    width = np.partition(bits, at, axis=1)[:, at] if k else np.empty(0, np.uint8)
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    sizes = 6 + 16 * width.astype(np.int64) + 5 * n_over
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    body = np.zeros(int(starts[-1]), np.uint8)
    head = np.zeros((k, 6), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(k, 4)
    head[:, 4], head[:, 5] = width, n_over
    body[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            low_bits = v[rows] & np.uint32((1 << int(w)) - 1) if w < 32 else v[rows]
            packed = _pack(low_bits, int(w)).astype("<u4").view(np.uint8).reshape(len(rows), -1)
            body[starts[rows][:, None] + 6 + np.arange(packed.shape[1])] = packed
    r, c = np.nonzero(over)
    if len(r):
        nth = np.arange(len(r)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = starts[r] + 6 + 16 * width[r].astype(np.int64)
        body[base + nth] = c
        high = (v[r, c] >> width[r].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(base + n_over[r] + 4 * nth)[:, None] + np.arange(4)] = high
    return b"".join([MAGIC, struct.pack("<QII", n, len(doc_ids), k), starts.astype("<u4").tobytes(), named.fill_null(0).to_numpy().astype("<i8").tobytes(), nulls.tobytes(), np.asarray(lengths, "<u4").tobytes(), body.tobytes()])


class TokenFile:
    """Reads a file: ``doc_ids``, ``lengths``, ``ids(first_block, last_block)``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, n_docs, k = struct.unpack_from("<QII", data, 8)
        at = 24
        self.starts = np.frombuffer(data, "<u4", k + 1, at).astype(np.int64)
        at += 4 * (k + 1)
        nulls = np.frombuffer(data, np.uint8, (n_docs + 7) // 8, at + 8 * n_docs)
        nulls = np.unpackbits(nulls, count=n_docs, bitorder="little").astype(bool)
        self.doc_ids = pa.array(np.frombuffer(data, "<i8", n_docs, at), pa.int64(), mask=nulls)
        at += 8 * n_docs + (n_docs + 7) // 8
        self.lengths = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, -1, at + 4 * n_docs)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks ``first`` to before ``last``."""
        last = len(self.starts) - 1 if last is None else last
        starts, body = self.starts[first:last], self.body
        k = len(starts)
        head = body[starts[:, None] + np.arange(6)]
        low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint32)
        width, n_over = head[:, 4], head[:, 5].astype(np.int64)
        v = np.zeros((k, BLOCK), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                packed = body[starts[rows][:, None] + 6 + np.arange(16 * int(w))]
                v[rows] = _unpack(packed.view("<u4").astype(np.uint32, copy=False), int(w))
        if n_over.any():
            r = np.repeat(np.arange(k), n_over)
            nth = np.arange(len(r)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
            base = starts[r] + 6 + 16 * width[r].astype(np.int64)
            high = body[(base + n_over[r] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.uint32)
            v[r, body[base + nth]] |= high << width[r].astype(np.uint32)
        v += low[:, None]
        return v.reshape(-1)[: self.n_ids - first * BLOCK]


# --- encoding -------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of pieces; new ones are numbered on from ``next`` and noted.  With ``strict``, pieces that are empty or
    have white space at an end get -1."""

    def __init__(self, encoder: ChunkEncoder, strict: bool):
        super().__init__()
        self.encoder, self.strict, self.new = encoder, strict, []

    def __missing__(self, piece: str) -> int:
        if self.strict and (not piece or piece[0].isspace() or piece[-1].isspace()):
            return -1
        n = self[piece] = self.encoder.next
        self.encoder.next = n + 1
        self.new.append(piece)
        return n


class ChunkEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece once, as long as it is remembered.

    The pre-tokenizer of these vocabularies never joins what stands before a single space to it when
    characters other than white space are on both sides, so texts are cut there.  New pieces go to the
    library many at a time, in one string; the ids of each begin where a token begins with a space.  A text
    that holds the string of an added token goes to the library whole.

    Pieces have numbers, and their ids are in one flat array, so a batch of texts is put together by numpy.
    """

    def __init__(self, tokenizer_file: str, end_id: int = 0, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")
        self.known = known
        self.after_space, self.plain = _Numbers(self, True), _Numbers(self, False)
        # Piece i has the ids flat[start[i] : start[i] + length[i]]; number 0 is the end of a text.
        self.next, self.n_flat = 1, 1
        self.flat = np.full(1 << 16, end_id, np.uint32)
        self.start, self.length, self.used = (np.zeros(1 << 14, t) for t in (np.int64, np.int64, np.int32))
        self.length[0] = 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, first: int, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the pieces numbered on from ``first``."""
        last = first + len(lengths)
        while last > len(self.start):
            self.start, self.length, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.used))
        if self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.start[first:last] = self.n_flat + np.cumsum(lengths) - lengths
        self.length[first:last] = lengths
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.n_flat += len(ids)

    def learn(self) -> None:
        """The library's ids of all new pieces."""
        new, self.after_space.new = self.after_space.new, []
        got: dict[int, np.ndarray] = {}
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            first, ids = self.after_space[some[0]], self.encode([" " + " ".join(some)])[0]
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(some) and self.after_space[some[-1]] == first + len(some) - 1:
                self._store(first, np.diff(at, append=len(ids)), ids)
            else:  # numbers of both kinds alternate, or a piece has a space inside
                got |= zip(map(self.after_space.__getitem__, some), self.encode([" " + w for w in some]))
        new, self.plain.new = self.plain.new, []
        got |= zip(map(self.plain.__getitem__, new), self.encode(new))
        for number, ids in got.items():
            self._store(number, np.array([len(ids)]), ids)

    def forget(self) -> None:
        """Keep the pieces that were used most, half of the limit at most; the use of each is halved."""
        least, self.used[0] = 2, 0
        while True:
            keep = np.flatnonzero(self.used[: self.next] >= least)
            if len(keep) <= self.known // 2 and self.length[keep].sum() <= 4 * self.known:
                break
            least *= 2
        renumbered = np.zeros(self.next, np.int64)
        renumbered[keep] = np.arange(1, len(keep) + 1)
        lengths, starts, used = self.length[keep], self.start[keep], self.used[keep] >> 1
        ids = self.flat[_places(starts, lengths)]
        for numbers in (self.after_space, self.plain):
            left = [(w, renumbered[n]) for w, n in numbers.items() if renumbered[n]]
            numbers.clear()
            numbers.update((w, int(n)) for w, n in left)
        self.next, self.n_flat = 1, 1
        self._store(1, lengths, ids)
        self.next = 1 + len(keep)
        self.used[:] = 0
        self.used[1 : self.next] = used

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (each with the end id after it), and the length of each."""
        if self.next > self.known or self.n_flat > 8 * self.known:
            self.forget()
        after, plain = self.after_space, self.plain
        flat, sizes, whole = [], [], set()
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                whole.add(i)
                text = ""
            pieces = text.split(" ")
            sizes.append(len(pieces))
            flat += pieces
        sizes = np.array(sizes, np.int64)
        begins = np.cumsum(sizes) - sizes
        numbers = np.fromiter(map(after.__getitem__, flat), np.int64, len(flat))
        uneven = np.unique(np.searchsorted(begins, np.flatnonzero(numbers < 0), "right") - 1).tolist()
        heads = begins.tolist()
        numbers[begins] = [plain[flat[b]] for b in heads]
        parts, at = [], 0
        for i in uneven:
            pieces = [texts[i]] if i in whole else self.chunks(texts[i])
            own = [plain[p] for p in pieces[:1]]
            for p in pieces[1:]:
                n = after[p[1:]]
                own.append(n if n >= 0 else plain[p])
            parts += [numbers[at : heads[i]], np.array(own, np.int64)]
            at = heads[i] + int(sizes[i])
            sizes[i] = len(own)
        numbers = np.concatenate([*parts, numbers[at:]])
        numbers = np.insert(numbers, np.cumsum(sizes), 0)  # the ends
        long_ = [(x, p) for x in (after, plain) for p in x.new if len(p) > 100]
        self.learn()
        self.used[: self.next] += np.bincount(numbers, minlength=self.next).astype(np.int32)
        lengths = self.length[numbers]
        ids = self.flat[_places(self.start[numbers], lengths)]
        ends = np.cumsum(sizes + 1)
        totals = np.add.reduceat(lengths, ends - sizes - 1) if len(texts) else np.zeros(0, np.int64)
        for pieces, p in long_:  # not remembered
            self.used[pieces.pop(p)] = 0
        return ids, totals

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks that concatenate to the text, cut only before a space between two characters that are not white space."""
        return [c for c in _CUT.split(text) if c]


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(2)
def chunk_encoder(tokenizer_file: str, end_id: int) -> ChunkEncoder:
    """One for each worker process."""
    return ChunkEncoder(tokenizer_file, end_id)


_FILE = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_ids", pa.int64()), ("bytes", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0, file_ids: int = FILE_IDS, percentile: int = PERCENTILE) -> None:
    """Write token files of ``docs`` under ``path`` in ascending order of id: shards follow each other, and the parts of a shard."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        encode = chunk_encoder(tokenizer_file, end_id)
        docs_: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        n = 0

        def close():
            data = encode_file(np.concatenate(held), docs_, np.concatenate(lengths), percentile)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, part, n, data), _FILE)], schema=_FILE)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            i = 0
            while i < len(ids):
                z, chars = i, 0  # some hundred texts at a time, and few if they are long
                while z < len(ids) and z < i + 500 and chars < 4_000_000:
                    chars += len(texts[z])
                    z += 1
                tokens, of_each = encode(texts[i:z])
                a = begun = 0
                for k, size in enumerate(np.cumsum(of_each).tolist()):
                    if n + size - begun >= file_ids or k + 1 == len(of_each):
                        docs_ += ids[i + a : i + k + 1]
                        held.append(tokens[begun:size])
                        lengths.append(of_each[a : k + 1])
                        n, a, begun = n + size - begun, k + 1, size
                        if n >= file_ids:
                            yield close()
                            docs_, held, lengths, n, part = [], [], [], 0, part + 1
                i = z
        if docs_:
            yield close()

    rows.mapInArrow(work, "shard int, part int, n_ids long, bytes binary").write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of the files under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and token_ids if ``keep_ids``."""
    files = spark.read.schema("shard int, part int, n_ids long, bytes binary").parquet(path)
    # A sum for each shard (as many as there were tasks) is added up on the driver, the parts of a shard by a window.
    sums = sorted((r[0], r[1]) for r in files.groupBy("shard").agg(F.sum("n_ids")).collect())
    before = dict(zip([s for s, _ in sums], accumulate([0] + [n for _, n in sums])))
    from pyspark.sql import Window

    parts = files.select("shard", "part", "n_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("shard", "part", F.coalesce(inside, F.lit(0)).alias("inside"))
    base = spark.createDataFrame([(s, n) for s, n in before.items()], "shard int, base long")
    offsets = offsets.join(F.broadcast(base), "shard").select("shard", "part", (F.col("base") + F.col("inside")).alias("start"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.list_(pa.int64()))] * keep_ids
    schema = pa.schema(fields)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * keep_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, value in zip(b.column(0).to_pylist(), b.column(1)):
                file = TokenFile(value.as_buffer().to_pybytes())
                ids = file.ids().astype("<u4", copy=False)
                ends = np.cumsum(file.lengths)
                begins = ends - file.lengths
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                columns = [file.doc_ids, pa.array(begins + start), pa.array(file.lengths), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return files.select("shard", "part", "bytes").join(F.broadcast(offsets) if len(sums) < 100_000 else offsets, ["shard", "part"]).select("start", "bytes").mapInArrow(work, ddl)


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Lay the files under ``path`` down as plain files in a mounted ``folder``; returns how many."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in spark.read.parquet(path).toLocalIterator():
        with open(f"{folder}/{r['shard']:06d}-{r['part']:06d}.pfor", "wb") as f:
            f.write(r["bytes"])
        n += 1
    return n


def token_table(docs: DataFrame, tokenizer_file: str, keep_ids: bool = False, **options) -> DataFrame:
    """Write the files and read them back."""
    path = work_path(docs.sparkSession, "token-blocks")
    write_token_files(docs, path, tokenizer_file, **options)
    return read_token_files(docs.sparkSession, path, keep_ids)
