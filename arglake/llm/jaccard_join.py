"""Exact join of documents whose shingle sets have a Jaccard similarity of at least 0.8.

1 - similarity is a metric, d.  The join works on distinct sets (copies meet by a digest of their set):

* Sieve.  If A links to B, at most a fifth of A's shingles are not in B.  So a set of which more than a
  fifth of the shingles are in no other set has no link.  This is counted on a fixed part of the shingle
  space (sets of under FULL shingles: on all of it), with shingles as hashes in binary blocks.  A set of
  both spaces shares perhaps only one of them with its partner, so each space is counted and keyed by itself.
* Regions.  Of what is left, each set is keyed by its rarest counted shingles, just so many that two linked
  sets must share a key.  Sets that are connected by keys form a region; no link leaves it.
* Voronoi cells.  Every region gets pivots, one for each CELL sets (at most PIVOTS), and all distances of its
  sets to them.  A set that is linked to pivots is settled, in the cell of one of them; settled sets of one cell
  are connected and need not meet.  Another set is in the cell of one of the pivots that are at most SPREAD
  farther than the nearest (so that a pivot in the middle does not get all).  Windows: if x and y are linked and
  y is unsettled in cell i, then d(x, i) <= d(x, nearest) + 2 * threshold + SPREAD (triangle inequality); if y is
  settled there, d(x, i) <= 2 * threshold.  By that an unsettled set visits earlier cells, and later ones for
  their settled sets; a settled set visits settled sets of earlier cells whose pivots are not connected to its
  own.  Pivots at distance 1 tell nothing: sets at a distance of at least 1 - 2 * threshold - SPREAD from all
  pivots also form a cell of their own.  A settled set leaves if all strangers in its cell are beyond
  d + threshold of the pivot, a visitor if it is beyond the cell's radius + threshold.
* Recursion.  Cells with more than JOINED sets of their own are regions of the next level, with other pivots.
  The others are joined: own sets are indexed, visitors stream past them in slices.  A cell that LEVELS levels
  of pivots have not split is cut into blocks by key, whose own sets all others visit: this is exact and bounded
  in memory too, and quadratic for such cells only.
* Components of all links are then the classes.

Nothing is approximated: every link is decided on whole sets of 64-bit shingle hashes.

Edge cases: null counts as empty; an empty text or one of white space has no shingles and is linked with
nothing; a text of fewer than five words is one shingle; equal texts link; a row with a null id takes
part through equal sets only (its component is that of its class, null if all its rows have null ids);
rows that repeat an id share a component if their sets do; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arglake.llm.common import WordHasher, lower_ascii, materialise, mix64, partitions, release, shingles, strings, words

WIDTH = 5
#: Linked if 100 * intersection >= SIMILAR * union; so at most (100 - SIMILAR) % of a linked set is outside the other.
SIMILAR = 80
THETA = 1 - SIMILAR / 100
#: Sets of fewer shingles are keyed on the whole shingle space, sets of at least PART_FROM on a part of it (some on both,
#: so that two linked sets always share a space).
FULL, PART_FROM, PART = 320, 256, 0.4
#: Pairs that a task holds before it passes them on.
HELD_PAIRS = 600_000
#: Occurrences of a shingle among the sets of a buffer from which on its pairs are spread over all tasks.
HOT = 64
#: Sets to a pivot; pivots of a region, at most; sets of its own with which a cell is joined.
CELL, PIVOTS, JOINED = 12, 96, 512
#: Rows of a slice of a region, and of a cell's visitors; levels of pivots.
SLICE, VISITORS, LEVELS = 256, 2048, 6
#: How much farther than its nearest pivot a set's own may be.
SPREAD = 0.1
#: Rows of a table of counts or pivots up to which it is broadcast.
BROADCAST_ROWS = 200_000

_hasher = WordHasher()


def shingle_set(text: str) -> np.ndarray:
    return shingles(_hasher(words(lower_ascii(text))), WIDTH)


def digest(s: np.ndarray, seed: int) -> int:
    """64 bits of the set, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed)).astype(np.int64))


def check_digest(s: np.ndarray) -> int:
    """Other 64 bits of the set, to tell sets with equal digests apart."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 977)).astype(np.int64))


_SPACE = np.uint64(0x5851F42D4C957F2D)


def part_of(s: np.ndarray, share: float) -> np.ndarray:
    """The shingles of a sorted set in the part of the space that is counted for large sets."""
    return s if share >= 1 else s[: np.searchsorted(s, np.uint64(int(share * 2**64)))]


def keyed_parts(s: np.ndarray, share: float) -> list[tuple[bool, np.ndarray]]:
    """(whether it is the part, counted shingles of a set) for each space that it belongs to."""
    out = [(False, s)] if len(s) < FULL else []
    if len(s) >= PART_FROM:
        out.append((True, part_of(s, share) ^ _SPACE))
    return out


def outside(n: int) -> int:
    """How many shingles of a linked set of ``n`` may be outside the other."""
    return n * (100 - SIMILAR) // 100


def _sets(docs: DataFrame, seed: int, share: float) -> DataFrame:
    """doc_id, n, key, proof and n_part (counted shingles in the second space) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("proof", pa.int64()), ("n_part", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in map(shingle_set, strings(b.column(1))):
                rows.append((len(s), digest(s, seed), check_digest(s), len(part_of(s, share)) if len(s) >= PART_FROM else 0))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    return docs.mapInArrow(work, "doc_id long, n long, key long, proof long, n_part long")


def _pairs(docs: DataFrame, seed: int, share: float, parts: int) -> DataFrame:
    """(part, in_part, hot, block): counted shingles and the keys of their sets; a block is of one space and has all shingles, then all keys.

    Pairs are dealt by shingle.  Of a shingle that is in HOT sets of a buffer only two pairs are, which tell that it is
    shared; the others (hot) are dealt by key.
    """
    schema = pa.schema([("part", pa.int32()), ("in_part", pa.bool_()), ("hot", pa.bool_()), ("block", pa.binary())])

    def blocks(part: np.ndarray, h: np.ndarray, k: np.ndarray, in_part: bool, hot: bool) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for a, z in zip(starts, [*starts[1:], len(h)]):
            block = h[a:z].tobytes() + k[a:z].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([in_part]), pa.array([hot]), pa.array([block], pa.binary())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[bool, tuple[list[np.ndarray], list[np.ndarray]]] = {False: ([], []), True: ([], [])}
        held = 0
        seen: set[int] = set()

        def out():
            for in_part, (hs, ks) in spaces.items():
                if not hs:
                    continue
                h, k = np.concatenate(hs), np.concatenate(ks)
                hs.clear()
                ks.clear()
                h = h << np.uint64(32) | h >> np.uint64(32)  # the upper half of a shingle's bits is not even in a part of the space
                order = np.argsort(h)
                h, k = h[order], k[order]
                starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                n = np.diff(starts, append=len(h))
                hot = np.repeat(n >= HOT, n) & (np.arange(len(h)) - np.repeat(starts, n) >= 2)
                if hot.any():
                    part = (mix64(k[hot].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                    order = np.argsort(part, kind="stable")
                    yield from blocks(part[order], h[hot][order], k[hot][order], in_part, True)
                    h, k = h[~hot], k[~hot]
                yield from blocks((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), h, k, in_part, False)

        for b in batches:
            for s in map(shingle_set, strings(b.column(1))):
                if not len(s):
                    continue
                key = digest(s, seed)
                if key in seen:  # a copy of a set that this task has dealt out
                    continue
                seen.add(key)
                for in_part, counted in keyed_parts(s, share):
                    if not len(counted):
                        continue
                    spaces[in_part][0].append(counted)
                    spaces[in_part][1].append(np.full(len(counted), key, np.int64))
                    held += len(counted)
                if held > HELD_PAIRS:
                    yield from out()
                    held = 0
                    if len(seen) > 200_000:  # only between buffers: a buffer has no key twice
                        seen.clear()
        yield from out()
        seen.clear()
        release()

    return docs.mapInArrow(work, "part int, in_part boolean, hot boolean, block binary")


def _repeated(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ``h`` and their ``k`` what has an equal neighbour."""
    wanted = np.zeros(len(h), bool)
    again = np.flatnonzero(h[1:] == h[:-1])
    wanted[again] = True
    wanted[again + 1] = True
    return h[wanted], k[wanted]


def _shared(pairs: DataFrame, parts: int) -> DataFrame:
    """(h, key, in_part) of the shingles that are in two sets of a space or more; a pair may be there twice, if a copy's shingle was hot and another's was not."""
    schema = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("in_part", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(in_part, hot): ([], []) for in_part in (False, True) for hot in (False, True)}
        for b in batches:
            for in_part, hot, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                x = np.frombuffer(block.as_buffer(), np.int64)
                hs, ks = held[in_part, hot]
                hs.append(x[: len(x) // 2])
                ks.append(x[len(x) // 2 :])
        b = block = x = None  # the batches go with their last block
        for in_part, hot in list(held):
            hs, ks = held.pop((in_part, hot))
            if not hs:
                continue
            h, k = np.concatenate(hs), np.concatenate(ks)
            del hs, ks
            if not hot:
                order = np.argsort(h)
                h, k = _repeated(h[order], k[order])
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            first = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])) if len(h) else np.zeros(0, bool)
            h, k = h[first], k[first]
            if not hot:
                h, k = _repeated(h, k)
            for i in range(0, len(h), 100_000):
                n = len(h[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + n]), pa.array(k[i : i + n]), pa.array(np.full(n, in_part))], schema=schema)
            del h, k
        release()

    return pairs.repartitionById(parts, F.col("part")).mapInArrow(work, "h long, key long, in_part boolean")


def components(edges: DataFrame, name: str = "components", most: int = 200) -> DataFrame:
    """(node, label): for each node of ``edges`` (a, b) the smallest node of its component.

    Alternating large-star and small-star steps, until nothing changes (their number is logarithmic in the size of
    the largest component; an error after ``most``); each step's edges are written to the shared folder.
    """

    def least(e: DataFrame) -> DataFrame:
        """For each node the smallest of itself and its neighbours in ``e`` (u, v)."""
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(most):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), name)
        m = least(large)
        small = large.join(m, "u").select(F.col("v").alias("x"), "m").unionByName(m.select(F.col("u").alias("x"), "m"))
        current = materialise(small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), name)
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most} steps")
    # every node now points at the smallest one
    out = current.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return out.unionByName(roots)


# --- joining a region -----------------------------------------------------------------------------


def linked(both: np.ndarray, a, b) -> np.ndarray:
    return 100 * both >= SIMILAR * (a + b - both)


class Index:
    """An inverted index of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        self.values, self.starts = ranked[first], np.append(first, len(flat))
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def shared_with(self, s: np.ndarray) -> np.ndarray:
        """How many items of ``s`` each set has."""
        at = np.searchsorted(self.values, s)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == s]
        a, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owners[places], minlength=len(self.sizes))


class Classes:
    """Union of numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        a, b = sorted((self.root(i), self.root(j)))
        self.parent[b] = a
        return a != b


_EPS = 1e-9
#: The number of the cell of sets that are far from all pivots.
_FAR = -1


class Pivots:
    """Pivots of a region, and which cells a set belongs to and visits."""

    def __init__(self, keys: list[int], sets: list[np.ndarray]):
        self.keys, self.number = keys, {k: i for i, k in enumerate(keys)}
        self.index = Index(sets)
        classes = Classes(len(keys))
        for i, s in enumerate(sets):
            for j in np.flatnonzero(linked(self.index.shared_with(s), len(s), self.index.sizes)).tolist():
                classes.unite(i, j)
        self.connected = np.array([classes.root(i) for i in range(len(keys))])

    def links(self) -> list[tuple[int, int]]:
        return [(self.keys[i], self.keys[j]) for i, j in enumerate(self.connected.tolist()) if i != j]

    def place(self, key: int, s: np.ndarray, own: bool) -> tuple[list[tuple[int, bool, bool, float]], list[int]]:
        """((cell, whether its own, whether settled, distance) for each cell of ``s``, keys of pivots that it links to)."""
        both = self.index.shared_with(s)
        d = 1 - both / (self.index.sizes + len(s) - both)
        least = d.min()
        reach = np.flatnonzero((d < 1) & (d <= least + 2 * THETA + SPREAD + _EPS)).tolist()
        far = bool(least >= 1 - 2 * THETA - SPREAD - _EPS)
        if not own:
            return [(i, False, False, float(d[i])) for i in reach] + [(_FAR, False, False, 1.0)] * far, []
        near = linked(both, len(s), self.index.sizes)
        settled = bool(near.any())
        may = np.flatnonzero(near if settled else (d < 1) & (d <= least + SPREAD))
        out, to = [], []
        if len(may):
            c = self.number.get(key, int(may[key % len(may)]))
            out.append((c, True, settled, float(d[c])))
            if settled:
                classes, first = np.unique(self.connected[near], return_index=True)
                to = [self.keys[i] for i in np.flatnonzero(near)[first].tolist()]
                out += [(i, False, False, float(d[i])) for i in reach if i < c and d[i] <= 2 * THETA + _EPS and self.connected[i] not in classes]
            else:
                out += [(i, False, False, float(d[i])) for i in reach if i < c or (i > c and d[i] <= 2 * THETA + _EPS)]
        if far:
            out.append((_FAR, True, False, 1.0))
        return out, to


_MEMBERS = "cell long, own boolean, settled boolean, key long, items binary"


def _groups(batches: Iterator[pa.RecordBatch], more: int) -> Iterator[tuple]:
    """(whether a group begins, the columns between, key, set as bytes) of rows that are sorted by (cell, slice, ..., key); the last column is the set.
    A row that repeats the one before it is left out."""
    at, last = None, None
    for b in batches:
        for cell, slice_, *between, key, items in zip(*(b.column(i).to_pylist() for i in range(3 + more)), b.column(3 + more)):
            row = (cell, slice_, *between, key)
            if row == last:
                continue
            last = row
            yield (cell, slice_) != at, cell, slice_, *between, key, items.as_buffer().to_pybytes()
            at = (cell, slice_)


def _small(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, with a broadcast hint if it has few rows."""
    made = materialise(df, name)
    return F.broadcast(made) if made.count() <= BROADCAST_ROWS else made


def _sliced(rows: DataFrame, n: DataFrame, size: int) -> tuple[DataFrame, Column, Column]:
    """``rows`` with the column ``slices`` (of ``size``, from the counts ``n``), a row's slice and all slices of its cell."""
    rows = rows.join(n, "cell", "left").withColumn("slices", F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("n"), F.lit(0)) / size)).cast("int"))
    return rows, F.pmod(F.xxhash64("key", F.lit("slice")), F.col("slices")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1))


def _voronoi(members: DataFrame, level: int, cell_sets: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One level: (cell, own, settled, key, items) of what has to meet in the cells of the regions ``members``, and links (a, b) to pivots."""
    parts = partitions(members.sparkSession)
    n = members.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("n_own"))
    n = _small(n, "jaccard-regions-n")
    rows, slice_, all_slices = _sliced(members, n, SLICE)
    order = F.xxhash64("key", F.lit(level))
    k = F.least(F.lit(pivots), F.ceil(F.col("n_own") / cell_sets))
    chosen = members.select("cell", "own", "key").join(n, "cell").where("own").groupBy("cell", F.pmod(order, k).alias("pivot")).agg(F.min(F.struct(order.alias("o"), "key")).alias("x"))
    chosen = chosen.select("cell", F.col("pivot").cast("int"), F.col("x.key").alias("key"))
    rows = rows.join(_small(chosen, "jaccard-pivots"), ["cell", "key"], "left")
    ordinary = rows.select("cell", slice_.alias("slice"), F.lit(-1).alias("pivot"), "own", "key", "items")
    everywhere = rows.where("own and pivot is not null").select("cell", all_slices.alias("slice"), "pivot", "own", "key", "items")
    dealt = ordinary.unionByName(everywhere).repartition(parts, "cell", "slice").sortWithinPartitions("cell", "slice", F.col("pivot") < 0, "pivot", F.col("own").desc(), "key")
    schema = pa.schema([("region", pa.int64()), ("sub", pa.int32()), ("own", pa.bool_()), ("settled", pa.bool_()), ("d", pa.float64()), ("key", pa.int64()), ("items", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, found, out = [], [], None, []
        for begins, region, slice_, pivot, own, key, items in _groups(batches, 2):
            if begins:
                keys, sets, found = [], [], None
            x = np.frombuffer(items, np.uint64)
            if pivot >= 0:
                keys.append(key)
                sets.append(x)
                continue
            if found is None:
                found = Pivots(keys, sets)
                if slice_ == 0:
                    out += [(region, None, None, None, None, None, None, a, b) for a, b in found.links()]
            cells, to = found.place(key, x, own)
            out += [(region, sub, mine, settled, d, key, items, None, None) for sub, mine, settled, d in cells]
            out += [(region, None, None, None, None, None, None, key, p) for p in to if p != key]
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    found = materialise(dealt.mapInArrow(work, "region long, sub int, own boolean, settled boolean, d double, key long, items binary, a long, b long"), "jaccard-cells")
    links = found.where("a is not null").select("a", "b")
    cells = found.where("key is not null").select(F.xxhash64("region", "sub", F.lit(level)).alias("cell"), "own", "settled", "d", "key", "items")
    stranger = ~F.col("settled")
    limits = cells.groupBy("cell").agg(F.min(F.when(stranger, F.col("d"))).alias("edge"), F.max(F.when(F.col("own"), F.col("d"))).alias("radius"), F.count("*").alias("rows"))
    limits = limits.where("rows > 1 and edge is not null and radius is not null")
    needed = F.when(F.col("settled"), F.col("d") >= F.col("edge") - THETA - _EPS).when(F.col("own"), F.lit(True)).otherwise(F.col("d") <= F.col("radius") + THETA + _EPS)
    return cells.join(_small(limits, "jaccard-limits"), "cell").where(needed).select("cell", "own", "settled", "key", "items"), links


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Cells that pivots do not split, in blocks by key: a block's own sets, which the sets of later blocks and all visitors visit."""
    n = members.where("own").groupBy("cell").agg(F.count("*").alias("n"))
    rows = members.join(n, "cell").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.when(F.col("own"), F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks"))).otherwise(F.col("blocks")).cast("int")
    rows = rows.select("cell", "key", "items", "blocks", "own", mine.alias("mine"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("mine"), F.col("blocks") - 1))).alias("at"))
    return rows.select(F.xxhash64("cell", "at", F.lit("block")).alias("cell"), (F.col("own") & (F.col("at") == F.col("mine"))).alias("own"), F.lit(False).alias("settled"), "key", "items")


def _join_cells(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is connected in each cell through a set of its own."""
    visitors = members.where("not own").groupBy("cell").agg(F.count("*").alias("n"))
    rows, slice_, all_slices = _sliced(members, _small(visitors, "jaccard-visitors"), VISITORS)
    own = rows.where("own").select("cell", all_slices.alias("slice"), "own", "settled", "key", "items")
    rows = own.unionByName(rows.where("not own").select("cell", slice_.alias("slice"), "own", "settled", "key", "items"))
    rows = rows.repartition(partitions(members.sparkSession), "cell", "slice").sortWithinPartitions("cell", "slice", F.col("own").desc(), "settled", "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, settled_, index, classes, out = [], [], [], None, None, []

        def own_links(first: bool) -> None:
            nonlocal index, classes
            index, classes = Index(sets), Classes(len(sets))
            settled = np.flatnonzero(settled_).tolist()
            for i in settled[1:]:
                classes.unite(settled[0], i)  # by way of the pivot
            for i, s in enumerate(sets):
                if not settled_[i]:
                    for j in np.flatnonzero(linked(index.shared_with(s), len(s), index.sizes)).tolist():
                        if classes.unite(i, j) and first:
                            out.append((keys[i], keys[j]))

        def flush(all_: bool) -> Iterator[pa.RecordBatch]:
            if len(out) > 5000 or (all_ and out):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out.clear()

        first = True
        for begins, _, slice_, own, settled, key, items in _groups(batches, 2):
            if begins:
                if sets and index is None:
                    own_links(first)
                keys, sets, settled_, index, first = [], [], [], None, slice_ == 0
                yield from flush(False)
            x = np.frombuffer(items, np.uint64)
            if own:
                keys.append(key)
                sets.append(x)
                settled_.append(settled)
                continue
            if not sets:
                continue
            if index is None:
                own_links(first)
            roots = {classes.root(j): j for j in np.flatnonzero(linked(index.shared_with(x), len(x), index.sizes)).tolist()}
            out.extend((key, keys[j]) for j in roots.values())
        if sets and index is None:
            own_links(first)
        yield from flush(True)

    return rows.mapInArrow(work, "a long, b long")


def _region_links(members: DataFrame, cell_sets: int, pivots: int, joined: int, levels: int) -> DataFrame:
    """Links (a, b) that connect the linked sets of each region of ``members`` (cell, own, settled, key, items)."""
    found: list[DataFrame] = []
    for level in range(levels):
        cells, links = _voronoi(members, level, cell_sets, pivots)
        found.append(links)
        cells = materialise(cells, "jaccard-meet")
        large = cells.where("own").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > joined).select("cell")
        if large.isEmpty():
            found.append(_join_cells(cells))
            break
        large = _small(large, "jaccard-large")
        found.append(_join_cells(cells.join(large, "cell", "left_anti")))
        members = cells.join(large, "cell", "left_semi")
    else:
        found.append(_join_cells(_blocks(members, joined)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _with_sets(docs: DataFrame, survivors: DataFrame, seed: int) -> DataFrame:
    """Members of regions: the whole sets of ``survivors`` (key, rep, region), read from the texts of their representatives."""
    schema = pa.schema([("cell", pa.int64()), ("own", pa.bool_()), ("settled", pa.bool_()), ("key", pa.int64()), ("items", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for region, key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(shingle_set, strings(b.column(2)))):
                if digest(s, seed) == key:  # else another row with the representative's id
                    out.append((region, True, False, key, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    joined = docs.join(survivors.withColumnRenamed("rep", "doc_id"), "doc_id").select("region", "key", "text")
    return joined.mapInArrow(work, _MEMBERS)


def link_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cell_sets: int = CELL, pivots: int = PIVOTS, joined: int = JOINED, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; the other parameters change the way, not the result."""
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    share = PART
    for seed in range(8):
        rows = materialise(_sets(docs, seed, share), "jaccard-sets")
        short = (F.col("n") >= PART_FROM) & (F.col("n_part") <= F.floor(F.col("n") * (100 - SIMILAR) / 100))
        classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("n_part").alias("n_part"), (F.min("proof") != F.max("proof")).alias("clash"), F.max(short).alias("short"))
        classes = materialise(classes, "jaccard-classes")
        clash, few = classes.agg(F.coalesce(F.max("clash"), F.lit(False)), F.coalesce(F.max("short"), F.lit(False))).first()
        if few:  # a set with too few shingles in the part: count the whole space
            share = 1.0
        elif not clash:  # else another seed: two different sets have one digest
            break
    else:
        raise RuntimeError("digests of different sets clash for every seed")
    shared = materialise(_shared(_pairs(docs, seed, share, parts), parts), "jaccard-shared")
    # the sieve: sets that have too many shingles of their own in a space go from it, as linked sets share all they have in a common space but ``may``
    total = F.when(F.col("in_part"), F.col("n_part")).otherwise(F.col("n"))
    may = F.floor(F.col("n") * (100 - SIMILAR) / 100)
    counted = shared.groupBy("key", "in_part").agg(F.count("*").alias("m"))
    sieve = counted.join(classes.where("rep is not null"), "key").select("key", "rep", "in_part", total.alias("total"), "m", may.alias("may"))
    sieve = materialise(sieve.where(F.col("total") - F.col("m") <= F.col("may")), "jaccard-sieve")
    keyed = materialise(shared.join(sieve.select("key", "in_part", "may", "total"), ["key", "in_part"]), "jaccard-keyed")
    df = keyed.groupBy("h", "in_part").agg(F.count("*").alias("df")).where("df > 1")
    own = keyed.join(df, ["h", "in_part"])
    of_set = Window.partitionBy("key", "in_part")
    ranked = own.withColumn("place", F.row_number().over(of_set.orderBy("df", "h"))).withColumn("m", F.count("*").over(of_set))
    # A set's shingles of its own come first; of the shared ones the rarest complete the prefix, in each space.
    length = F.col("may") + 1 - (F.col("total") - F.col("m"))
    prefix = materialise(ranked.where(F.col("place") <= length).select("h", "key"), "jaccard-prefix")
    least = prefix.groupBy("h").agg(F.min("key").alias("least"))
    edges = prefix.join(least, "h").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    regions = components(edges, "jaccard-regions")
    survivors = sieve.select("key", "rep").distinct().join(regions.select(F.col("node").alias("key"), F.col("label").alias("region")), "key")
    members = materialise(_with_sets(docs, survivors, seed), "jaccard-members")
    found = components(_region_links(members, cell_sets, pivots, joined, levels), "jaccard-links")
    # keys to the smallest id of their component
    named = classes.select("key", "rep").join(found.select(F.col("node").alias("key"), "label"), "key", "left")
    named = named.select("key", "rep", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("key", "component_id")
    out = rows.join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their component (rows that share an id stay if one of them does)."""
    found = link_components(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep_id")).distinct()
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")), "left_semi")
