"""Required trigrams of regular expressions, and an index of chunks by them.

A regular expression can only match a text that holds the trigrams of its literal parts. They are derived from the parsed
expression as alternatives (any of) of conjunctions (all of). The index of a batch of chunks keeps postings for the trigrams
that some expression requires: the chunks that hold each. Intersecting postings leaves the candidates of an expression.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser

import numpy as np

#: More alternatives than this are not worth keeping apart: the part then requires nothing.
MAX_ALTERNATIVES = 400

#: Character classes of at most so many members are spelled out, up to so many strings.
MAX_CLASS, MAX_STRINGS = 12, 64

Need = list[frozenset[str]] | None  # any of these sets, all trigrams of it; None: no requirement


def _choices(items) -> list[str] | None:
    """The characters of a small class, lower case; None for a large or negated one."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        elif op is C.CATEGORY and arg is C.CATEGORY_DIGIT:
            out |= set("0123456789")
        else:
            return None
    return sorted(out) if len(out) <= MAX_CLASS else None


def _grams(strings: set[str]) -> Need:
    if not strings or any(len(x) < 3 for x in strings):
        return None
    return [frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings]


def _both(a: Need, b: Need) -> Need:
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) <= MAX_ALTERNATIVES:
        return list(dict.fromkeys(x | y for x in a for y in b))
    return a if len(a) <= len(b) else b


def _need(items) -> Need:
    best: Need = None
    exact: set[str] = {""}  # what the characters since the last break can be

    def flush() -> None:
        nonlocal best, exact
        best, exact = _both(best, _grams(exact)), {""}

    for op, arg in items:
        if op is C.LITERAL:
            exact = {x + chr(arg).lower() for x in exact}
        elif op is C.IN and (chars := _choices(arg)) and len(exact) * len(chars) <= MAX_STRINGS:
            exact = {x + ch for x in exact for ch in chars}
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            flush()
            if op is C.SUBPATTERN:
                best = _both(best, _need(arg[3]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                best = _both(best, _need(arg[2]))
            elif op is C.BRANCH:
                got: Need = []
                for branch in arg[1]:
                    sub = _need(branch)
                    if sub is None or len(got) + len(sub) > MAX_ALTERNATIVES:
                        got = None
                        break
                    got += sub
                best = _both(best, got)
    flush()
    return best


def required(pattern: str, flags: int = 0) -> Need:
    """Sets of lower-case trigrams, one of which every matching text holds entirely; None if nothing is required."""
    return _need(parser.parse(pattern, flags))


class TrigramIndex:
    """Postings of the trigrams that a set of expressions requires, over a batch of chunks."""

    def __init__(self, needs: list[Need]) -> None:
        grams = sorted({t for need in needs if need for alt in need for t in alt})
        self.number = {t: i for i, t in enumerate(grams)}
        self.needs = needs
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            a, b, c = (ord(x) & 0xFF for x in t)
            self.table[a << 16 | b << 8 | c] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, chunks: list[bytes]) -> np.ndarray:
        """held[trigram, chunk]."""
        held = np.zeros((len(self.number), len(chunks)), bool)
        if not chunks:
            return held
        data = self.lower[np.frombuffer(b"\0\0".join(chunks), np.uint8)].astype(np.int32)
        if len(data) < 3:
            return held
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        gram = self.table[code]
        at = np.flatnonzero(gram >= 0)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 2
        chunk = np.searchsorted(np.cumsum(size), at, side="right")
        held[gram[at], chunk] = True
        return held

    def candidates(self, chunks: list[bytes]) -> np.ndarray:
        """hit[expression, chunk]: whether the chunk may match the expression."""
        held = self.postings(chunks)
        out = np.zeros((len(self.needs), len(chunks)), bool)
        for e, need in enumerate(self.needs):
            if need is None:
                out[e] = True
                continue
            for alt in need:
                rows = [self.number[t] for t in alt]
                out[e] |= held[rows].all(axis=0)
        return out
