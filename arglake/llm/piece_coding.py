"""Exact encoding and decoding for merge-type (BPE) sentencepiece models by backtracking.

Aho-Corasick finds every piece that starts at a position; the longest is tried first.  A piece is
accepted after its left neighbour only if merging the two pieces' characters anew gives these two
pieces again, and only if the position behind it has not failed; otherwise shorter pieces are tried, and
then the last accepted piece is taken back.  Positions that failed are marked in a bitfield, so each is
left for good at most once.

Texts are cut where no piece can reach across: before a "▁" that follows another character, and between
letters and other characters if no piece has both.  Runs of "▁", whose pieces share one score, are merged
by the merge rule itself.  Encoded words are remembered in dictionaries of bounded size: a full one is
kept beside a new one, to which its words move as they come again.

Edge cases: null counts as empty; an empty text has the end id only; characters without a piece become
byte pieces (or the unknown piece in a model without them); any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.llm.common import strings

SPACE = "▁"
#: Letters, and what stands between them; SPACE at the start of a unit goes with what follows it.
PART = re.compile(rf"{SPACE}*[^\W\d_²³¹¼½¾]+|[\W\d_²³¹¼½¾]+")
#: Remembered by a worker: uncut words and parts of words (half in the newer dictionaries), words that are cut, and pairs of pieces.
UNITS, COMPOUNDS, PAIRS = 400_000, 100_000, 400_000
#: Positions whose pieces are looked up at once.
BLOCK = 2048


def merge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """The merge rule: join the neighbours whose union has the best score, the leftmost of equals, while any union is a piece."""
    n = len(symbols)
    text, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (s := scores.get(a + b)) is not None]
    heapify(heap)
    while heap:
        _, i, union = heappop(heap)
        j = right[i] if text[i] is not None else n
        if j >= n or text[i] + text[j] != union:
            continue
        text[i], text[j] = union, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (s := scores.get(union + text[k])) is not None:
                heappush(heap, (-s, i, union + text[k]))
        h = left[i]
        if h >= 0 and (s := scores.get(text[h] + union)) is not None:
            heappush(heap, (-s, h, text[h] + union))
    return [t for t in text if t is not None]


class Remembered(dict):
    """Ids of words by the word; a word that is not here is asked of ``ask``."""

    def __init__(self, ask: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.ask(word)


class PieceEncoder:
    """Encodes with the pieces of a sentencepiece BPE model with identity normalisation."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m, ids = self.model, range(self.model.get_piece_size())
        self.end = m.eos_id()
        self.ids = {m.id_to_piece(i): i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = all(m.is_byte(i) for i in self.bytes)
        self.unknown = m.unk_id()
        self.decimal = [str(i) for i in ids]
        #: Only pieces that the merge rule itself can make are looked for.
        made = [p for p in self.ids if len(p) == 1 or merge(list(p), self.scores) == [p]]
        #: The code of a piece is its id; any character without a piece has the code ``other``.
        self.other = len(self.decimal)
        self.lengths = [1] * (self.other + 1)
        self.single = {p: (1, self.ids[p]) for p in made if len(p) == 1}
        self.made, self.piece = set(made), {i: p for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in made:
            if p.strip(SPACE) and len(p) > 1:
                self.lengths[self.ids[p]] = len(p)
                self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.longest = max(map(len, made), default=1)
        inner = [p for p in self.ids if SPACE in p[1:]]
        lowest = min(self.scores.values(), default=0.0)
        #: Whether texts may be cut before each SPACE: pieces have it at their start only, but for runs of it that merge last.
        self.cuts = all(not p.strip(SPACE) and self.scores[p] == lowest for p in inner) and not any(s == lowest and p.strip(SPACE) and len(p) > 1 for p, s in self.scores.items())
        #: Whether units may be cut between PARTs: but for SPACE at its start no piece has more than one.
        self.parts = self.cuts and all(len(PART.findall(p.lstrip(SPACE))) < 2 for p in self.ids)
        #: Words behind one SPACE, which is left out; parts of words that have none before them; words of several parts.
        self.words, self.older_words = Remembered(self.word), {}
        self.inner, self.older_inner = Remembered(self.inner_part), {}
        self.compounds: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.run = lru_cache(1000)(self._run)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge rule on the characters of the pieces with codes ``a`` and ``b`` gives these two."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        ok = self.other in (a, b)
        if not ok:
            first, second = self.piece[a], self.piece[b]
            ok = first + second not in self.made and merge(list(first + second), self.scores) == [first, second]
        self.pairs[a * len(self.lengths) + b] = ok
        return ok

    def codes(self, unit: str) -> list[int] | None:
        """Codes of the pieces of a unit without inner SPACE runs, by backtracking; none if there is no way through."""
        n, known, lengths, base = len(unit), self.pairs, self.lengths, len(self.lengths)
        other, block_of = (1, self.other), {}

        def pieces_from(low: int) -> list[list[tuple[int, int]]]:
            """(length, code) of the pieces that start at each position, longest last; a character without a piece counts as one."""
            found = [[self.single.get(c, other)] for c in unit[low : low + BLOCK]]
            size = len(found)
            for end, piece in self.automaton.iter(unit if n <= BLOCK else unit[low : low + BLOCK + self.longest]):
                if (start := end - piece[0] + 1) < size:
                    found[start].append(piece)
            return found

        def starting(pos: int) -> list[tuple[int, int]]:
            k = pos // BLOCK
            if k not in block_of:
                if len(block_of) > 2:
                    block_of.clear()
                block_of[k] = pieces_from(k * BLOCK)
            return block_of[k][pos - k * BLOCK]

        if n <= BLOCK:
            starting = pieces_from(0).__getitem__

        failed = bytearray((n >> 3) + 1)  # a bit for each position
        out: list[int] = []
        pos, last = 0, -1
        while pos < n:
            left = starting(pos)  # those tried are gone; if their block is looked up again they fail again
            while left:
                length, code = left.pop()
                end = pos + length
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    if (ok := known.get(last * base + code)) is None:
                        ok = self.fits(last, code)
                    if ok:
                        break
            else:  # every length fails here: leave this position for good and shorten the piece before it
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:  # no way through; a model whose merges follow ``merge`` has one
                    return None
                pos -= lengths[out.pop()]
                last = out[-1] if out else -1
                continue
            out.append(code)
            pos, last = end, code
        return out

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a unit without inner SPACE runs."""
        if (codes := self.codes(unit)) is None:
            return merge(list(unit), self.scores)
        ends = list(accumulate(map(self.lengths.__getitem__, codes), initial=0))
        return [unit[i:j] for i, j in zip(ends, ends[1:])]

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _run(self, n: int) -> list[str]:
        return merge([SPACE] * n, self.scores)

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that is cut no more: a run of SPACE, then characters other than it."""
        body = unit.lstrip(SPACE)
        run = len(unit) - len(body)
        if run < 2 and body:
            codes = self.codes(unit)
            return tuple(codes if codes is not None and self.other not in codes else self._ids(self.pieces(unit)))
        if not body:
            return tuple(self._ids(self.run(run)))
        pieces = self.pieces(SPACE + body)  # the last of the run goes with the body if any piece takes it
        return tuple(self._ids(self.run(run) + pieces[1:] if pieces[0] == SPACE else self.run(run - 1) + pieces))

    def cut(self, unit: str) -> list[str]:
        return PART.findall(unit) if self.parts else [unit]

    def spaced(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that begins with SPACE."""
        first, *rest = self.cut(unit)
        ids = self.words[first[1:]] if len(first) > 1 and first[1] != SPACE else self.unit(first)
        return ids + tuple(chain.from_iterable(map(self.inner.__getitem__, rest)))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of SPACE and a word that is not in ``words``."""
        if (ids := self.compounds.get(word)) is not None:
            return ids
        if (ids := self.older_words.get(word)) is None:
            if len(self.cut(SPACE + word)) > 1:
                ids = self.spaced(SPACE + word)
                if len(word) < 200:
                    if len(self.compounds) >= COMPOUNDS:
                        self.compounds.clear()
                    self.compounds[word] = ids
                return ids
            ids = self.unit(SPACE + word)
        if len(word) < 200:
            self._make_room()
            self.words[word] = ids
        return ids

    def inner_part(self, part: str) -> tuple[int, ...]:
        """Ids of a part without SPACE that is not in ``inner``."""
        if (ids := self.older_inner.get(part)) is None:
            ids = self.unit(part)
        if len(part) < 200:
            self._make_room()
            self.inner[part] = ids
        return ids

    def _make_room(self) -> None:
        if 2 * (len(self.words) + len(self.inner)) >= UNITS:
            self.words, self.older_words = Remembered(self.word), dict(self.words)
            self.inner, self.older_inner = Remembered(self.inner_part), dict(self.inner)

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them, with the end id."""
        if not text:
            return [self.end]
        if not self.cuts:
            return [*self._ids(self.pieces(SPACE + text.replace(" ", SPACE))), self.end]
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            out = list(chain.from_iterable(map(self.words.__getitem__, words)))
        else:  # an empty word lengthens the run of SPACE before the next
            out, run = [], 0
            for w in words:
                run += 1
                if w:
                    out += self.words[w] if run == 1 else self.spaced(SPACE * run + w)
                    run = 0
            if run:
                out += self.unit(SPACE * run)
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(2)
def encoder(model_file: str) -> PieceEncoder:
    """One for each worker process."""
    return PieceEncoder(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode and decode each text.

    Columns: doc_id, n_tokens, then token_ids and decoded if ``keep_ids``, ids_sha256 and decoded_sha256 if ``digests``.
    Ids end with the end id; decoded is what the library's decode gives for them.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())] * keep_ids
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] * digests
    schema = pa.schema(fields)
    ddl = "doc_id long, n_tokens long" + ", token_ids array<int>, decoded string" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model_file)
        hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows: list[tuple] = []
            size = 0
            docs_, texts = b.column(0).to_pylist(), strings(b.column(1))
            for doc, text in zip(docs_, texts):
                ids = code.encode(text)
                decoded = code.decode(ids)
                row = (doc, len(ids))
                if keep_ids:
                    row += (ids, decoded)
                if digests:
                    row += (hexed(" ".join(map(code.decimal.__getitem__, ids))), hexed(decoded))
                rows.append(row)
                size += len(ids) * keep_ids
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, ddl)
