"""Repair of UTF-8 that was decoded by a one-byte code, once or several times, in whole or in parts of a text.

A best-first search over decoding steps.  A step takes one code and decodes all places of the text that are UTF-8 in it; a
state's cost is how many of its characters are implausible, and a little for each step.  The search ends with the least cost.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata

#: Codes that are tried, and what a character of a place that one of them explains costs.
CODES = {"cp1252": 1.0, "latin-1": 1.0, "cp1250": 0.6, "mac-roman": 0.6}
STEP, LOST, CONTROL = 0.02, 2.0, 1.0
#: What a character costs by its general category: what prose rarely has costs more.
RARE = {"M": 0.5, "Sk": 0.5, "Lm": 0.5, "Cn": 0.5, "Co": 0.5, "Sm": 0.15, "Sc": 0.15, "N": 0.15, "P": 0.08, "L": 0.1}
#: States that are looked at, at most.
STATES = 60


@functools.cache
def _code(name: str) -> tuple[dict[str, int], re.Pattern]:
    """Characters of the bytes from 80 on (bytes without one stand for themselves), and the places that are UTF-8 in them."""
    of = {}
    for b in range(0x80, 0x100):
        try:
            of[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            of[chr(b)] = b
    byte = {b: re.escape(c) for c, b in of.items()}
    some = lambda low, high: "[" + "".join(byte[b] for b in range(low, high + 1)) + "]"
    rest = some(0x80, 0xBF)
    # a no-break space often comes as a plain one
    after = "[" + rest[1:-1] + " ]"
    pattern = f"{some(0xC3, 0xC3)} |{some(0xC2, 0xDF)}{rest}|{some(0xE0, 0xEF)}{rest}{after}|{some(0xF0, 0xF4)}{rest}{rest}{rest}"
    return of, re.compile(pattern)


#: A text without any of these is left alone: the first bytes' characters in one of the codes, or controls.
_SUSPECT = re.compile("[" + "".join(sorted({re.escape(c) for n in CODES for c, b in _code(n)[0].items() if 0xC2 <= b <= 0xF4})) + "\x80-\x9f�]")
#: A capital's word may end in a quotation mark or dash: no place of two characters begins there.
_CLOSING = re.compile("[‘-„–—›]")


def _decoded(name: str, text: str) -> str:
    of, places = _code(name)

    def one(m: re.Match) -> str:
        found = m[0]
        before = text[m.start() - 1 : m.start()]
        if len(found) == 2 and before.isupper() and (_CLOSING.match(found[1]) or found[1] == " "):
            return found
        plain = found.endswith(" ") and " " not in of
        raw = bytes(of.get(c, 0xA0) for c in found)
        try:
            return raw.decode("utf-8") + (" " if plain and len(found) == 2 else "")
        except UnicodeDecodeError:
            return found

    return places.sub(one, text)


@functools.lru_cache(1 << 16)
def _rarity(c: str) -> float:
    if c == "�":
        return LOST
    if "\x80" <= c <= "\x9f":
        return CONTROL
    kind = unicodedata.category(c)
    if kind[0] == "L" and kind != "Lm":
        return 0.05 if c <= "ÿ" else RARE["L"] + 0.02 * unicodedata.name(c, "").startswith("LATIN")
    return RARE.get(kind, RARE.get(kind[0], 0.1))


def cost(text: str) -> float:
    """How implausible a text is: characters of places that a code explains, and those that prose rarely has."""
    explained = max((w * sum(len(m[0]) for m in _code(n)[1].finditer(text) if _decoded(n, m[0]) != m[0]) for n, w in CODES.items()), default=0.0)
    return explained + sum(map(_rarity, filter(lambda c: c > "\x7f", text)))


def repaired(text: str | None) -> str | None:
    """The text of least cost that decoding steps lead to; null stays null."""
    if not text or not _SUSPECT.search(text):
        return text
    best = (cost(text), text)
    queue, seen = [(best[0], 0, text)], {text}
    while queue and len(seen) < STATES:
        total, steps, at = heapq.heappop(queue)
        if total < best[0]:
            best = (total, at)
        for name in CODES:
            new = _decoded(name, at)
            if new not in seen:
                seen.add(new)
                heapq.heappush(queue, (cost(new) + STEP * (steps + 1), steps + 1, new))
    for total, _, at in queue:
        if total < best[0]:
            best = (total, at)
    return best[1]
