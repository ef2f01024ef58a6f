"""Similarity of many pairs of texts at once: count filters, then bit-parallel common subsequences in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs whose rows are held in arrays at once (elements of the widest).
CELLS = 1 << 22
#: Buckets of letters and of bigrams in the count filter.
LETTERS, BIGRAMS = 32, 256
_PAD_LONG, _PAD_SHORT = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(rows: list[np.ndarray], width: int, pad: int) -> np.ndarray:
    out = np.full((len(rows), width), pad, np.uint32)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    out[np.arange(width) < lengths[:, None]] = np.concatenate(rows) if rows else 0
    return out


def _lcs_block(long: list[np.ndarray], short: list[np.ndarray]) -> np.ndarray:
    """Lengths of longest common subsequences of rows; a row of ``long`` is a bit string of 64-bit words, of ``short`` a step each."""
    words = -(-max(map(len, long)) // 64)
    a, b = _padded(long, 64 * words, _PAD_LONG), _padded(short, max(map(len, short)), _PAD_SHORT)
    top = 1 + max(int(np.where(x == pad, 0, x).max()) for x, pad in ((a, _PAD_LONG), (b, _PAD_SHORT)))
    used = np.zeros(top, bool)
    for x, pad in ((a, _PAD_LONG), (b, _PAD_SHORT)):
        used[x[x != pad]] = True
    if used.sum() < 254:  # narrower codes compare faster
        code = np.zeros(top + 2, np.uint8)
        code[:top] = np.cumsum(used)
        code[top:] = 254, 255
        a, b = (code[np.where(x == pad, top + i, x)] for i, (x, pad) in enumerate(((a, _PAD_LONG), (b, _PAD_SHORT))))
    state = np.full((len(long), words), ~np.uint64(0))
    for step in range(b.shape[1]):
        match = np.packbits(a == b[:, step, None], axis=1, bitorder="little").view(np.uint64)
        hit = state & match
        total = state + hit
        if words > 1:
            carry = total[:, 0] < hit[:, 0]
            for w in range(1, words):
                over = total[:, w] < hit[:, w]
                total[:, w] += carry
                carry = over | (carry & (total[:, w] == 0))
        state = total | (state & ~match)
    ones = np.bitwise_count(state).sum(axis=1).astype(np.int64)
    return 64 * words - ones  # bits beyond the text never match, so stay set


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    rows = [(code_points(x), code_points(y)) for x, y in zip(a, b)]
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in rows]
    order = [i for i in sorted(range(len(pairs)), key=lambda i: (-(-len(pairs[i][0]) // 64), len(pairs[i][1]))) if len(pairs[i][1])]
    start = 0
    while start < len(order):
        words, end = -(-len(pairs[order[start]][0]) // 64), start + 1
        most = max(1, CELLS // (1024 * words))
        while end < len(order) and end - start < most and -(-len(pairs[order[end]][0]) // 64) == words and len(pairs[order[end]][1]) <= 2 * len(pairs[order[start]][1]) + 8:
            end += 1
        block = order[start:end]
        out[block] = _lcs_block([pairs[i][0] for i in block], [pairs[i][1] for i in block])
        start = end
    return out


def _counts(texts: list[str], width: int) -> np.ndarray:
    """How often each bucket of letters (LETTERS) or bigrams (BIGRAMS) occurs in each text."""
    codes = [code_points(t).astype(np.int64) for t in texts]
    if width == BIGRAMS:
        codes = [(c[:-1] * 31 + c[1:]) for c in codes]
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(codes)), lengths)
    return np.bincount(rows * width + flat % width, minlength=len(codes) * width).reshape(len(codes), width).astype(np.int32)


def may_reach(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether counts of letters and bigrams allow each pair a ratio of ``least``: false only where it is out of reach.

    At a ratio r the common subsequence has r * (la + lb) / 2 letters, which both texts hold; the la + lb - 2 * lcs letters
    outside it break at most two bigrams each.
    """
    texts = list(dict.fromkeys([*a, *b]))
    at = {t: i for i, t in enumerate(texts)}
    i, j = (np.fromiter(map(at.__getitem__, x), np.int64, len(x)) for x in (a, b))
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    both = n[i] + n[j]
    need = np.ceil(least * both / 2 - 1e-9)
    ok = np.minimum(n[i], n[j]) >= need
    for width in (LETTERS, BIGRAMS):
        bar = need if width == LETTERS else np.maximum(n[i], n[j]) - 1 - 2 * (both - 2 * need)
        rest = np.flatnonzero(ok & (bar > 0))
        if len(rest):
            counts = _counts(texts, width)
            for start in range(0, len(rest), CELLS // width):
                some = rest[start : start + CELLS // width]
                ok[some] = np.minimum(counts[i[some]], counts[j[some]]).sum(axis=1) >= bar[some]
    return ok


def ratios(a: list[str | None], b: list[str | None], least: float = 0.0) -> np.ndarray:
    """2 * LCS / (len a + len b) of each pair, 0 if either is blank; with ``least``, smaller ratios may come out as 0."""
    out = np.zeros(len(a))
    where: dict[tuple[str, str], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y and not x.isspace() and not y.isspace():
            if x == y:
                out[i] = 1.0
            else:
                where.setdefault((x, y) if x <= y else (y, x), []).append(i)
    pairs = list(where)
    if least > 0 and pairs:
        ok = may_reach([x for x, _ in pairs], [y for _, y in pairs], least)
        pairs = [p for p, good in zip(pairs, ok) if good]
    if pairs:
        lengths = lcs_lengths([x for x, _ in pairs], [y for _, y in pairs])
        for (x, y), n in zip(pairs, lengths.tolist()):
            out[where[x, y]] = 2 * n / (len(x) + len(y))
    return out


def scores_of_lists(a: pa.Array, b: pa.Array, least: float = 0.0, strip: bool = False) -> Iterator[np.ndarray]:
    """For each row, the ``ratios`` of all texts of its list in ``a`` with all of its list in ``b``, in the order of the first.

    Equal pairs of a block's texts, of up to CELLS pairs or one row, are compared once.
    """
    n, m = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    ends = np.cumsum(n * m)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
        flat = [x.slice(start, end - start).flatten() for x in (a, b)]
        known: dict[str | None, int] = {}
        codes = []
        for x in flat:
            coded = x.dictionary_encode(null_encoding="encode")
            own = [(t or "").strip() if strip else t for t in coded.dictionary.to_pylist()]
            codes.append(np.array([known.setdefault(t, len(known)) for t in own], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64))
        wide = np.repeat(m[start:end], n[start:end])  # partners of each text of a
        first = np.repeat(np.cumsum(m[start:end]) - m[start:end], n[start:end])
        within = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        pairs, place = np.unique(np.repeat(codes[0], wide) * max(1, len(known)) + codes[1][np.repeat(first, wide) + within], return_inverse=True)
        texts = list(known)
        i, j = np.divmod(pairs, max(1, len(texts)))
        found = ratios([texts[x] for x in i.tolist()], [texts[x] for x in j.tolist()], least)[place]
        yield from np.split(found, ends[start : end - 1] - (ends[start - 1] if start else 0))
        start = end


# --- a text in a document -------------------------------------------------------------------------


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - q + 1), np.int64)
    for i in range(q):
        out = (out << 21) | codes[i : len(codes) - q + 1 + i]
    return out


def seeded_starts(text: np.ndarray, document: np.ndarray, threshold: float) -> np.ndarray:
    """Starts of the windows of the text's length that may have a ratio of ``threshold``: all that do are among them.

    At most ``d`` letters of the text, and as many of the window, lie outside the common subsequence.  Each of the former breaks
    at most q of the text's q-grams and each of the latter q - 1; the others are found in the window, at most d places away
    from where the text has them.
    """
    n, m = len(text), len(document)
    d = int(n * (1 - threshold) + 1e-9)
    q = next((q for q in (3, 2, 1) if n - q + 1 - d * (2 * q - 1) >= min(q, 2)), 0)
    if not q:
        return np.arange(m - n + 1)
    own, there = _grams(text, q), _grams(document, q)
    order = np.argsort(own, kind="stable")
    left, right = np.searchsorted(own[order], there, "left"), np.searchsorted(own[order], there, "right")
    places = np.flatnonzero(right > left)
    times = (right - left)[places]
    on = np.zeros(m + n + 1, np.int64)  # seeds by diagonal: place in the document less place in the text
    ends = np.cumsum(times)
    start = 0
    while start < len(places):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
        k = times[start:end]
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        in_text = order[np.repeat(left[places[start:end]], k) + within]
        on += np.bincount(np.repeat(places[start:end], k) - in_text + n, minlength=len(on))
        start = end
    sums = np.concatenate([[0], np.cumsum(on)])
    starts = np.arange(m - n + 1)
    low, high = np.maximum(starts - d + n, 0), np.minimum(starts + d + n + 1, len(on))
    return starts[sums[high] - sums[low] >= n - q + 1 - d * (2 * q - 1)]


def fuzzy_span(text: str, document: str, threshold: float = 0.85) -> tuple[int, int] | None:
    """The window of the text's length with the best ratio of at least ``threshold``, the earliest of equals; seeds first, then
    exact ratios of the windows that they leave, those with most letters in common first."""
    n = len(text)
    if not n or not document or text.isspace():
        return None
    if len(document) <= n:
        return (0, len(document)) if ratios([text], [document])[0] >= threshold else None
    own, there = code_points(text), code_points(document)
    starts = seeded_starts(own, there, threshold)
    shared = np.zeros(len(starts), np.int64)
    for letter, k in zip(*np.unique(own, return_counts=True)):
        sums = np.concatenate([[0], np.cumsum(there == letter)])
        shared += np.minimum(k, sums[starts + n] - sums[starts])
    keep = shared / n >= threshold
    starts, shared = starts[keep], shared[keep]
    order = np.lexsort((starts, -shared))
    best, where, size = threshold, None, 16
    at = 0
    while at < len(order):
        some = order[at : at + size]
        some = some[shared[some] / n >= best]
        if not len(some):
            break
        found = ratios([text] * len(some), [document[s : s + n] for s in starts[some].tolist()])
        for s, r in zip(starts[some].tolist(), found.tolist()):
            if r > best or r >= best and (where is None or s < where):
                best, where = r, s
        at, size = at + size, min(4 * size, 4096)
    return None if where is None else (where, where + n)
