"""Skip-and-fold hashing: characters pass through one lookup table straight into polynomial hashes.

The table gives, for every code point, how many characters it folds to (0: skipped, as white space and signs are) and which
(letter case removed). A batch of strings is one array of code points; its hashes come from segment sums of folded characters
times powers of a base, modulo two primes. Records are grouped by what neither signs nor order can change, the bag of their folded
characters, and then compared exactly: as streams by two pointers, and by a canonical form with named attributes in order.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np

#: Two primes under 2^31 and a base for each.
PRIMES = ((2147483647, 1000003), (2147483629, 9176801))
_POINTS = 0x110000


@lru_cache(maxsize=1)
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """(count, folded): code point c folds to folded[c, :count[c]]."""
    count = np.zeros(_POINTS, np.uint8)
    folded = np.zeros((_POINTS, 3), np.int32)
    for c in range(_POINTS):
        ch = chr(c)
        if ch.isalnum():
            to = ch.casefold()
            count[c] = len(to)
            for j, x in enumerate(to):
                folded[c, j] = ord(x)
    return count, folded


def stream(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded characters, for each the index in `points` it came from)."""
    count, folded = fold_table()
    n = count[points]
    if n.max(initial=0) <= 1:
        src = np.flatnonzero(n)
        return folded[points[src], 0], src
    src = np.repeat(np.arange(len(points)), n)
    nth = np.arange(len(src)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
    return folded[points[src], nth], src


@lru_cache(maxsize=4)
def _powers(prime: int, base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.int64)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * pow(base, 1 << k, prime) % prime
    return out


def segment_hashes(chars: np.ndarray, seg: np.ndarray, n_seg: int) -> list[np.ndarray]:
    """A hash of each segment for each prime; `seg` is the ascending segment of each character. Empty segments hash to 0."""
    size = np.bincount(seg, minlength=n_seg)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size)
    full = size > 0
    starts = (np.cumsum(size) - size)[full]
    out = []
    for prime, base in PRIMES:
        power = _powers(prime, base, max(12, int(size.max(initial=1)).bit_length()))
        term = (chars.astype(np.int64) + 7) * power[place] % prime
        h = np.zeros(n_seg, np.int64)
        if len(starts):
            h[full] = (np.add.reduceat(term, starts) + size[full]) % prime
        out.append(h)
    return out


_SIGN = re.compile(r"[(),;\"'“”„‘’{}\[\]]")
_NAMED = re.compile(r"\s*(?:[\"'`][^\W\d][\w.$-]*[\"'`]|[^\w\s\"'`(){}\[\],;=:]*[^\W\d][\w.$-]*)\s*[=:]")
_CLOSES = {'"': '"', "'": "'", "“": "“”\"", "”": "”“", "„": "“”„", "‘": "’‘", "’": "’‘"}
_SKIPPED = re.compile(r"[\W_]+")


def _named(text: str, cuts: list[int]) -> list[tuple[int, int, int]]:
    """(start, end of the name, end) of the named attributes between separators, if there are two or more."""
    got: list[list[int]] = []
    for a, b in zip(cuts, cuts[1:]):
        if m := _NAMED.match(text, a, b):
            got.append([a, m.end(), b])
        elif got:
            got[-1][2] = b
    return [(a, n, b) for a, n, b in got] if len(got) > 1 else []


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), size


def _mix(h: list[np.ndarray], salt: int) -> np.ndarray:
    """One 64-bit value of a segment's two hashes."""
    x = (h[0].astype(np.uint64) << np.uint64(32)) ^ h[1].astype(np.uint64) ^ np.uint64(salt)
    for mul, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def plain_hash(texts: list[str | None]) -> np.ndarray:
    """A 64-bit hash of each text's folded characters; null has its own."""
    points, size = _points(texts)
    chars, src = stream(points)
    row = np.repeat(np.arange(len(texts)), size)[src] if len(points) else src
    out = _mix(segment_hashes(chars, row, len(texts)), 0x5BD1)
    out[[t is None for t in texts]] = np.uint64(0x9E3779B97F4A7C15)
    return out


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    """A 64-bit value for each code point."""
    points = np.arange(_POINTS, dtype=np.int64)
    return _mix([points + 1, points * 3 + 5], 0x27D4)


def bag_hash(texts: list[str | None]) -> np.ndarray:
    """A 64-bit hash of each text's folded characters in any order; null has its own."""
    points, size = _points(texts)
    chars, src = stream(points)
    out = np.zeros(len(texts), np.uint64)
    if len(src):
        row = np.repeat(np.arange(len(texts)), size)[src]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(_weights()[chars], starts)
    out[[t is None for t in texts]] = np.uint64(0x9E3779B97F4A7C15)
    return out


def record_hash(texts: list[str | None]) -> np.ndarray:
    """A 64-bit hash of each text's canonical form; null has its own."""
    out = [0x9E3779B97F4A7C15 if t is None else int.from_bytes(hashlib.blake2b(canonical(t).encode("utf-8", "surrogatepass"), digest_size=8).digest()) for t in texts]
    return np.array(out, np.uint64)


def same_stream(a: str | None, b: str | None) -> bool:
    """Two pointers over both texts, skipping signs and folding letters: do they agree?"""
    if a is None or b is None:
        return a is b
    if a == b:
        return True
    count, folded = fold_table()
    i = j = 0
    left: list[int] = []
    right: list[int] = []
    while True:
        while not left and i < len(a):
            c = ord(a[i])
            left, i = folded[c, : count[c]].tolist(), i + 1
        while not right and j < len(b):
            c = ord(b[j])
            right, j = folded[c, : count[c]].tolist(), j + 1
        if not left or not right:
            return not left and not right
        if left.pop(0) != right.pop(0):
            return False


def structured(text: str | None) -> bool:
    """Whether a text may have attributes that can be reordered."""
    return bool(text) and "(" in text and ("," in text or ";" in text)


def same_record(a: str | None, b: str | None) -> bool:
    """As same_stream, with named attributes of one pair of parentheses matched in any order."""
    if a is None or b is None:
        return a is b
    if a == b:
        return True
    return canonical(a) == canonical(b) if structured(a) or structured(b) else same_stream(a, b)


def folded(text: str | None) -> str | None:
    """The characters that same_stream compares."""
    return None if text is None else _SKIPPED.sub("", text).casefold()


@lru_cache(maxsize=1024)
def canonical(text: str | None) -> str | None:
    """The folded text with the named attributes of each pair of parentheses, at any depth, in order.

    Commas and semicolons separate, but not inside quotes or inner brackets. What follows a separator and has no name belongs to the
    attribute before it. Inner pairs are done first and count as a part of the value they stand in.
    """
    if not structured(text):
        return folded(text)
    Done = list[tuple[int, int, str]]  # finished pairs: (start, end, canonical form)

    def render(a: int, b: int, inner: Done) -> str:
        out = []
        for x, y, form in inner:
            if a <= x and y <= b:
                out += [folded(text[a:x]), form]
                a = y
        return "".join([*out, folded(text[a:b])])

    frames: list[tuple[bool, list[int], Done]] = [(False, [], [])]
    quote = ""
    for m in _SIGN.finditer(text):
        ch = m.group()
        if quote:
            if ch in quote:
                quote = ""
        elif ch in _CLOSES:
            if len(frames) > 1 and any(text.find(x, m.end()) >= 0 for x in _CLOSES[ch]):
                quote = _CLOSES[ch]
        elif ch in "([{":
            frames.append((ch == "(", [m.end()], []))
        elif ch in ")]}":
            if len(frames) > 1:
                round_, cuts, inner = frames.pop()
                named = _named(text, [*cuts, m.end()]) if round_ and len(cuts) > 1 else []
                if named:
                    units, k = [], 0
                    for a, n, b in named:
                        while k < len(inner) and inner[k][0] < a:
                            k += 1
                        first = k
                        while k < len(inner) and inner[k][0] < b:
                            k += 1
                        units.append(folded(text[a:n]) + "\x03" + render(n, b, inner[first:k]))
                    start, end = named[0][0], named[-1][2]
                    inner = [x for x in inner if x[0] < start] + [(start, end, "\x01" + "\x02".join(sorted(units)) + "\x06")]
                frames[-1][2].extend(inner)
        elif frames[-1][0]:
            frames[-1][1].append(m.end())
    return render(0, len(text), [x for f in frames for x in f[2]])
