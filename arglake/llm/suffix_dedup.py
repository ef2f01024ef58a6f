"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a string of LENGTH bytes that also starts anywhere else is removed.

* Anchors bring equal strings together: the anchor of a string is the place in it whose GRAM-byte gram
  has the least hash (the leftmost of equals).  Equal strings have equal anchors at equal places, so
  strings are dealt by the hash of their anchor's gram, and an anchor that is found once needs no sorting.
* A context is the text of consecutive strings of one anchor.  Equal contexts are folded into one with a
  list of places; all its strings repeat.  Different contexts of one anchor are sorted.
* Two-stage suffix sorting of the contexts' strings: those smaller than their successor (type B) are
  sorted directly by their LENGTH bytes, the rest (type A) are induced: a scan over the buckets of first
  bytes, in order, puts the predecessor of each string, if it is of type A, at the end of the filled part of
  its own bucket.  Strings whose common prefix with a neighbour reaches LENGTH repeat.
* An anchor found HOT times or more is dealt further by the distance of the string from its anchor and by
  the bytes that all strings of about that distance share, which are equal for equal strings.
* Hot groups.  Of an anchor that is in a buffer HOT_BUFFER times only its count and two places go to the task
  that owns it, the other places are spread.  A context that a task holds twice repeats whatever others hold:
  the runs of its places are spread over all tasks, and only one place goes on to be sorted.

Edge cases: null counts as empty; a text of under LENGTH bytes is kept whole; matches never cross
documents; overlapping repeats inside one document count; rows that repeat id and text are repeats of
each other; an empty table gives an empty result; sorting is exact, hashes only bring strings together.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.llm.common import materialise, mix64, partitions

LENGTH = 200
GRAM = 32
#: Bytes of texts that are hashed at once, and of a slice of a longer text.
BUFFER = 1 << 17
#: An anchor found so often is dealt by distance too, in steps of STEP.
HOT, STEP = 20_000, 16
#: Places of an anchor in a buffer from which on they are spread over all tasks.
HOT_BUFFER = 256
#: Anchors up to which a table of those is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of contexts that are sorted at once.
SORTED_BYTES = 3 << 20
#: Anchors, and bytes of contexts, that a task holds before it passes them on.
HELD_ANCHORS, HELD_BYTES = 2_000_000, 32 << 20

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64((1 << 24) - 1)
_NONE = np.uint64(2**64 - 1)
_NONE_INT = 2**64 - 1


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams, by doubling."""
    h, width, factor = _BYTE[text], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % 2**64
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, anchor, first, last) of the contexts in concatenated texts that end at ``ends``: strings start from ``first`` to before ``last``."""
    empty = np.empty(0, np.int64)
    if len(text) < LENGTH:
        return np.empty(0, np.uint64), empty, empty, empty
    h = gram_hashes(text)
    n, width = len(h), LENGTH - GRAM + 1
    v = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, _NONE)
    padded[:n] = v
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - width + 1
    at = (np.minimum(right[:strings], left[width - 1 : width - 1 + strings]) & _LOW).astype(np.int64)
    begins = np.append(0, ends[:-1])
    inside = np.zeros(strings + 1, np.int64)
    whole = ends - begins >= LENGTH
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:strings]) > 0
    new = np.append(True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], strings)
    good = inside[first]
    first, last = first[good], last[good]
    return h[at[first]], at[first], first, last


def buffers(items: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """Concatenated texts of about BUFFER bytes: (bytes, ends, [(item, offset of the slice)]); longer texts come in slices that share LENGTH - 1 bytes."""
    parts, owners, size = [], [], 0
    for item in items:
        data = item[0]
        if len(data) < LENGTH:
            continue
        for low in range(0, max(1, len(data) - LENGTH + 1), BUFFER):
            piece = data[low : low + BUFFER + LENGTH - 1]
            parts.append(piece)
            owners.append((item, low))
            size += len(piece)
            if size >= BUFFER:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), owners
                parts, owners, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), owners


# --- sorting --------------------------------------------------------------------------------------


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type A, greater than its successor; what ends in equal bytes is of type B."""
    kind = np.sign(text[:-1].astype(np.int16) - text[1:])
    decided = np.append(np.flatnonzero(kind), len(text) - 1)
    kind = np.append(kind, -1)
    return kind[decided[np.searchsorted(decided, np.arange(len(text)))]] > 0


def sort_strings(text: np.ndarray, starts: np.ndarray, is_a: np.ndarray) -> np.ndarray:
    """Order of the strings of LENGTH bytes at ``starts``, by two-stage sorting.

    Behind each string of type A (``is_a``) comes its successor.  Equal strings come together, in any order.
    """
    n = len(starts)
    head = text[starts].astype(np.int16)
    direct = np.flatnonzero(~is_a)
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    rows = np.ascontiguousarray(windows[starts[direct]]).view(f"S{LENGTH}").ravel()
    direct = direct[np.argsort(rows, kind="stable")]
    del rows
    b_of = np.split(direct, np.searchsorted(head[direct], np.arange(1, 256)))  # type B by first byte
    a_of: list[list[np.ndarray]] = [[] for _ in range(256)]
    before = np.full(n, -1, np.int64)  # the predecessor, if it is to be induced
    induced = np.flatnonzero(is_a)
    before[induced + 1] = induced
    order = []
    for c in range(256):
        done, queue = 0, a_of[c]

        def induce(found: np.ndarray) -> None:
            p = before[found]
            p = p[p >= 0]
            if len(p):
                to = head[p]
                ranked = np.argsort(to, kind="stable")
                p, to = p[ranked], to[ranked]
                cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
                for group, byte in zip(np.split(p, cuts), to[np.append(0, cuts)].tolist()):
                    a_of[byte].append(group)

        while done < len(queue):  # a bucket's own strings may induce more of it
            found = queue[done]
            done += 1
            order.append(found)
            induce(found)
        order.append(b_of[c])
        induce(b_of[c])
    return np.concatenate(order)


def common_prefix_reaches(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the strings at ``a`` and ``b`` have a common prefix of LENGTH bytes, compared word by word."""
    same = np.zeros(len(a), bool)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    left = np.arange(len(a))
    at = 0
    while at < LENGTH and len(left):
        k = min(at, LENGTH - 8)
        x = np.ascontiguousarray(words[a[left] + k]).view(np.uint64).ravel()
        y = np.ascontiguousarray(words[b[left] + k]).view(np.uint64).ravel()
        left = left[x == y]
        at += 8
    same[left] = True
    return same


def repeated(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its strings are equal to another one of these contexts (which differ from each other).

    A context whose last string is of type A lends the suffixes behind it, up to one of type B, to the sorting: they
    run on into the next context, which does not part strings with a common prefix inside their own.
    """
    text = np.frombuffer(b"".join(contexts) + bytes(2 * LENGTH), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    offsets = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    type_a = types(text)
    b_places = np.flatnonzero(~type_a)
    last = offsets + counts - 1
    lent = b_places[np.searchsorted(b_places, last)] - last
    all_counts = counts + lent
    total = int(all_counts.sum())
    within = np.arange(total) - np.repeat(np.cumsum(all_counts) - all_counts, all_counts)
    starts = np.repeat(offsets, all_counts) + within
    own = within < np.repeat(counts, all_counts)
    order = sort_strings(text, starts, type_a[starts])
    order = order[own[order]]
    equal = common_prefix_reaches(text, starts[order[:-1]], starts[order[1:]])
    out = np.zeros(total, bool)
    out[order[:-1][equal]] = True
    out[order[1:][equal]] = True
    return np.split(out[own], np.cumsum(counts)[:-1])


# --- distributed ----------------------------------------------------------------------------------


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, bytes): row is a hash of id and text."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return docs.select(F.xxhash64("id", "text").alias("row"), "id", F.col("text").cast("binary").alias("bytes"))


def _anchor_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(part, kind, block): keys and rows of all anchors, dealt by key (kind 0); of keys that are frequent in a buffer
    only two, the others by row (kind 1), and their numbers by key (kind 2)."""

    def blocks(part: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(part, kind="stable")
        a, b, part = a[order], b[order], part[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for i, z in zip(starts, [*starts[1:], len(a)]):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[i])], pa.int32()), pa.array([kind], pa.int32()), pa.array([a[i:z].tobytes() + b[i:z].tobytes()], pa.binary())], names=["part", "kind", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        rows_: list[np.ndarray] = []
        held = 0

        def out():
            if not keys:
                return
            k, r = np.concatenate(keys), np.concatenate(rows_)
            order = np.argsort(k)
            k, r = k[order], r[order]
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            n = np.diff(starts, append=len(k))
            many = n >= HOT_BUFFER
            if many.any():
                spread = np.repeat(many, n) & (np.arange(len(k)) - np.repeat(starts, n) >= 2)
                yield from blocks(_part(r[spread].view(np.uint64), parts), 1, k[spread], r[spread])
                yield from blocks(_part(k[starts[many]], parts), 2, k[starts[many]], n[many] - 2)
                k, r = k[~spread], r[~spread]
            yield from blocks(_part(k, parts), 0, k, r)
            keys.clear()
            rows_.clear()

        for b in batches:
            items = [(v.as_buffer().to_pybytes(), r) for r, v in zip(b.column(0).to_pylist(), b.column(2)) if v.as_buffer().size >= LENGTH]
            for text, ends, owners in buffers(items):
                key, _, first, _ = anchors(text, ends)
                of = np.array([o[0][1] for o in owners], np.int64)
                keys.append(key)
                rows_.append(of[np.searchsorted(ends, first, side="right")])
                held += len(key)
            if held > HELD_ANCHORS:
                yield from out()
                held = 0
        yield from out()

    return rows.mapInArrow(work, "part int, kind int, block binary")


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((mix64(keys) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _frequent(blocks: DataFrame, parts: int) -> DataFrame:
    """(row, key, hot) of the anchors that are found twice or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[list, list], ...] = (([], []), ([], []), ([], []))

        def out(r, k, hot):
            for i in range(0, len(k), 200_000):
                columns = [x if isinstance(x, pa.Array) else pa.array(x[i : i + 200_000]) for x in (r, k, hot)]
                yield pa.RecordBatch.from_arrays([x[i : i + 200_000] if len(x) > 200_000 else x for x in columns], names=["row", "key", "hot"])

        for b in batches:
            for kind, block in zip(b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(block.as_buffer(), np.int64)
                first, second = x[: len(x) // 2], x[len(x) // 2 :]
                if kind == 1:  # whether they are hot is known to the key's owner
                    yield from out(second, first, np.full(len(first), -1, np.int8))
                else:
                    held[kind][0].append(first)
                    held[kind][1].append(second)
        if not held[0][0]:
            return
        k, r = map(np.concatenate, held[0])
        order = np.argsort(k)
        k, r = k[order], r[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        n = np.diff(np.append(first, len(k)))
        total = n.copy()
        if held[2][0]:
            more, times = map(np.concatenate, held[2])
            np.add.at(total, np.searchsorted(k[first], more), times)
            some = np.unique(np.searchsorted(k[first], more))
            yield from out(np.full(len(some), -1, np.int64), k[first][some], (total[some] >= HOT).astype(np.int8) + 2)
        times = np.repeat(total, n)
        yield from out(r[times > 1], k[times > 1], (times[times > 1] >= HOT).astype(np.int8))

    found = materialise(blocks.repartitionById(parts, F.col("part")).mapInArrow(work, "row long, key long, hot byte"), "suffix-anchors")
    known = found.where("hot >= 2").select("key", (F.col("hot") == 3).alias("hot"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    spread = found.where("hot = -1").select("row", "key").join(known, "key").select("row", "key", "hot")
    return found.where("hot between 0 and 1").select("row", "key", (F.col("hot") == 1).alias("hot")).unionByName(spread)


def _block(part: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["part", "kind", "block"])


def _pack(contexts: dict, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks, compressed: contexts with one place each and whether there are more (kind 0, dealt by key), and the runs of all places but those (kind 1)."""
    import zstandard

    by_part: dict[int, list] = {}
    runs = []
    keys = np.array([k for k, _ in contexts], np.uint64)
    for p, (key, text), places in zip(_part(keys, parts).tolist(), contexts, contexts.values()):
        by_part.setdefault(p, []).append((key, text, places))
        if len(places) > 1:
            runs += [(row, doc, first, first + len(text) - LENGTH + 1) for row, doc, first in places[1:]]
    squeeze = zstandard.ZstdCompressor(level=1)
    if runs:
        found = np.array(runs, np.int64)
        part = _part(found[:, 0].view(np.uint64), parts)
        for p in np.unique(part).tolist():
            yield _block(p, 1, squeeze.compress(found[part == p].tobytes()))
    for p, found in by_part.items():
        head = np.array([(k, len(t), len(w) > 1, *(x & _NONE_INT for x in w[0])) for k, t, w in found], np.uint64)
        block = struct.pack("<Q", len(found)) + head.tobytes() + b"".join(t for _, t, _ in found)
        yield _block(p, 0, squeeze.compress(block))


def _contexts(marked: DataFrame, parts: int) -> DataFrame:
    """(part, kind, block): the contexts of the marked anchors of ``marked`` (row, id, bytes, keys, hot)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[tuple[int, bytes], list] = {}
        size = 0
        for b in batches:
            items = [(data, row, doc, keys, hot) for row, doc, data, keys, hot in zip(*(b.column(i).to_pylist() for i in range(5)))]
            marks = {}
            for _, row, _, keys, hot in items:
                k = np.array(keys, np.int64).view(np.uint64)
                order = np.argsort(k)
                marks[row] = (k[order], np.array(hot, bool)[order])
            for text, ends, owners in buffers(items):
                key, at, first, last = anchors(text, ends)
                begins = np.append(0, ends[:-1])
                owner = np.searchsorted(ends, first, side="right")
                raw = text.tobytes()
                cuts = np.searchsorted(owner, np.arange(len(owners) + 1))
                for o, (item, low) in enumerate(owners):
                    a, z = int(cuts[o]), int(cuts[o + 1])
                    if a == z:
                        continue
                    known, hot = marks[item[1]]
                    place = np.minimum(np.searchsorted(known, key[a:z]), len(known) - 1)
                    shift = low - int(begins[o])
                    for i in (np.flatnonzero(known[place] == key[a:z]) + a).tolist():
                        k, f, l, anchor = int(key[i]), int(first[i]), int(last[i]), int(at[i])
                        pieces = [(k, f, l)]
                        if hot[place[i - a]]:
                            pieces = []
                            while f < l:  # cut where the distance from the anchor passes a multiple of STEP
                                step = (anchor - f) // STEP
                                end = min(l, anchor - step * STEP + 1)
                                core = raw[anchor - step * STEP : anchor - (step + 1) * STEP + LENGTH + 1]  # all strings at this step have it
                                pieces.append((xxhash.xxh3_64_intdigest(core, k ^ (step + 1)), f, end))
                                f = end
                        for k2, f2, l2 in pieces:
                            c = raw[f2 : l2 + LENGTH - 1]
                            places = held.get((k2, c))
                            if places is None:
                                held[k2, c] = [(item[1], item[2], f2 + shift)]
                                size += len(c) + 300
                            else:
                                places.append((item[1], item[2], f2 + shift))
                                size += 120
                if size > HELD_BYTES:
                    yield from _pack(held, parts)
                    held.clear()
                    size = 0
        if held:
            yield from _pack(held, parts)

    return marked.mapInArrow(work, "part int, kind int, block binary")


def _repeats(blocks: DataFrame, parts: int) -> DataFrame:
    """(row, id, first, last): runs of strings, by start, that repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        groups: dict[int, dict[bytes, list]] = {}
        out: list[np.ndarray] = []
        waiting: list[tuple[bytes, list]] = []
        size = 0

        def emit(places: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> None:
            where = np.array(places, np.int64)
            for a, z in runs:
                out.append(np.column_stack([where[:, :2], where[:, 2] + a, where[:, 2] + z]))

        def sort() -> None:
            if not waiting:
                return
            for (text, (many, places)), flags in zip(waiting, repeated([t for t, _ in waiting])):
                if many:
                    flags[:] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                if len(edges):
                    emit(places, list(zip(edges[::2].tolist(), edges[1::2].tolist())))
            waiting.clear()

        def rows():
            found = np.concatenate(out)
            out.clear()
            for i in range(0, len(found), 100_000):
                part = found[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, i]) for i in range(4)], names=["row", "id", "first", "last"])

        for b in batches:
            for kind, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = expand.decompress(block)
                if kind == 1:
                    out.append(np.frombuffer(data, np.int64).reshape(-1, 4))
                    yield from rows()
                    continue
                (n,) = struct.unpack_from("<Q", data)
                at = 8 + 48 * n
                for key, length, many, row, doc, first in np.frombuffer(data, np.int64, 6 * n, 8).reshape(n, 6).tolist():
                    texts = groups.setdefault(key, {})
                    text = data[at : at + length]
                    at += length
                    if (known := texts.get(text)) is None:
                        texts[text] = [bool(many), [(row, doc, first)]]
                    else:
                        known[0] = True
                        known[1].append((row, doc, first))

        for texts in groups.values():
            if len(texts) == 1:
                for text, (many, places) in texts.items():
                    if many:
                        emit(places, [(0, len(text) - LENGTH + 1)])
                continue
            new = sum(map(len, texts))
            if size + new > SORTED_BYTES:
                sort()
                size = 0
            waiting.extend(texts.items())
            size += new
            if len(out) > 20_000:
                yield from rows()
        sort()
        if out:
            yield from rows()

    return blocks.repartitionById(parts, F.col("part")).mapInArrow(work, "row long, id long, first long, last long")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep_text``, kept (bytes) and spans of each row."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = _rows(docs, id_column, text_column)
    marks = _frequent(_anchor_blocks(rows, parts), parts)
    marks = marks.groupBy("row").agg(F.collect_set(F.struct("key", "hot")).alias("marks"))
    marks = marks.select("row", F.col("marks.key").alias("keys"), F.col("marks.hot").alias("hot"))
    named = F.coalesce("id", F.lit(-(2**63)))  # a null id's own stand-in: what has the same row hash beside differs in text
    marked = rows.join(marks, "row").select("row", named.alias("id"), "bytes", "keys", "hot")
    repeats = materialise(_repeats(_contexts(marked, parts), parts), "suffix-repeats")
    runs = repeats.groupBy("row", "id").agg(F.collect_set(F.struct("first", "last")).alias("runs")).withColumnsRenamed({"row": "r", "id": "i"})
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] * keep_text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, data, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = data.as_buffer().to_pybytes()
                spans: list[list[int]] = []
                for x in sorted((r["first"], r["last"] + LENGTH - 1) for r in found or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                kept = data
                if spans:
                    cuts = [0, *(x for s in spans for x in s), len(data)]
                    kept = b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                row = [doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                if keep_text:
                    row += [kept, [{"start": a, "end": z} for a, z in spans]]
                out.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * keep_text
    joined = rows.join(runs, (F.col("row") == F.col("r")) & (named == F.col("i")), "left")
    return joined.select("id", "bytes", "runs").mapInArrow(work, ddl)
