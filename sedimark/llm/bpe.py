"""Byte-level BPE of a public vocabulary in numpy.

The text is cut into pretokens by the vocabulary's public pattern. Distinct pieces are encoded once per worker: pretokens of
similar length form a padded matrix, and in every round each row merges its leftmost pair of least rank, looked up in a hash
table; then the rows are compacted. A piece that was seen before costs one dictionary lookup.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

#: Fixed value: the pattern that splits a text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Folder of the public vocabularies; SEDIMARK_TOKENIZERS overrides it.
TOKENIZER_DIR = os.environ.get("SEDIMARK_TOKENIZERS", "/opt/tokenizers")

#: Pieces a worker remembers before it starts afresh (bounds its memory, never its results).
CACHE_PIECES = 200_000

#: Rows longer than this merge every occurrence of their least pair in one round, not only the leftmost. The result is the
#: same where every pair made by a merge has a later rank than that merge; other vocabularies merge one pair a round (`in_order`).
LONG_ROW = 64

#: Stands for a space that isn't a cut: a lone surrogate, which no text from a column can hold.
_KEPT = "\ud800"
_EDGE = re.compile(r" (?:(?=\s|\Z)|(?<=\s )|(?<=\A ))").sub
_ODD_BLANK = re.compile(r"[^\S \n]").search

_MUL = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file, by the published rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Pair of ids -> rank and merged id, as an open-addressed hash table over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, bits: int = 18) -> None:
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.keys = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, np.iinfo(np.int32).max, np.int32)
        self.to = np.zeros(self.size, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.rank[slots], self.to[slots] = keys[put], put, merged[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            todo = todo[~placed[todo]]
            at[todo] = (at[todo] + 1) % self.size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MUL) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(keys)
        out = np.full(keys.shape, -1, np.int64)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            held = self.keys[at[todo]]
            out[todo[held == keys[todo]]] = at[todo[held == keys[todo]]]
            todo = todo[(held != keys[todo]) & (held != -1)]
            at[todo] = (at[todo] + 1) % self.size
        return out


class Encoder:
    """Encodes texts; holds the vocabulary and the pieces seen so far."""

    def __init__(self, path: str | None = None) -> None:
        with open(path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.fromiter((vocab[x] for x in xs), np.int64, len(pairs)) for xs in (*zip(*pairs), map("".join, pairs)))
        self.pairs = PairTable(left, right, merged)
        # the latest merge that makes an id comes before the first one that uses it
        made, used = np.full(len(vocab), -1, np.int64), np.full(len(vocab), len(pairs), np.int64)
        np.maximum.at(made, merged, np.arange(len(pairs)))
        for side in (left, right):
            np.minimum.at(used, side, np.arange(len(pairs)))
        self.in_order = bool((made < used).all())
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        self.split = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.inner: dict[str, int] = {}  # pieces that follow a space, without it
        self.first: dict[str, int] = {}  # pieces at the start of a text, or with blanks at an edge
        self.words: dict[str, np.ndarray] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- merging -----------------------------------------------------------------------------------------------------

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (one pretoken each), by padded matrices of words of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = int((sizes == 0).sum())
        while at < len(order):
            n = int(sizes[order[at]])
            top = max(n, min(2 * n, n + 8))
            end = int(np.searchsorted(sizes[order], top, side="right"))
            end = min(end, at + max(1, 4_000_000 // top))
            for rows, ids in self._matrix([words[i] for i in order[at:end]], int(sizes[order[end - 1]])):
                for r, x in zip(rows, ids):
                    out[order[at + r]] = x
            at = end
        return out

    def _matrix(self, words: list[bytes], width: int):
        m = np.full((len(words), width), -1, np.int32)
        for i, w in enumerate(words):
            m[i, : len(w)] = self.byte_id[np.frombuffer(w, np.uint8)]
        live = np.arange(len(words))
        none = np.iinfo(np.int32).max
        while m.shape[1] > 1:
            a, b = m[:, :-1], m[:, 1:]
            slot = np.full(a.shape, -1, np.int64)
            both = b >= 0
            slot[both] = self.pairs.find(a[both], b[both])
            rank = np.where(slot >= 0, self.pairs.rank[slot], none)
            least = rank.min(axis=1)
            done = least == none
            if done.any():
                yield live[done], [x[x >= 0] for x in m[done]]
                keep = ~done
                m, live, slot, rank, least = m[keep], live[keep], slot[keep], rank[keep], least[keep]
                if not len(live):
                    return
            if m.shape[1] > LONG_ROW and self.in_order:
                hit = rank == least[:, None]
                hit = _leftmost_disjoint(hit)
            else:
                hit = np.zeros(rank.shape, bool)
                hit[np.arange(len(live)), rank.argmin(axis=1)] = True
            r, c = np.nonzero(hit)
            m[r, c] = self.pairs.to[slot[r, c]]
            m[r, c + 1] = -2
            m = _compact(m)
        if len(live):
            yield live, [x[x >= 0] for x in m]

    # -- texts -------------------------------------------------------------------------------------------------------

    def _learn(self, pieces: list[str], into: dict[str, int], lead: str) -> None:
        """Encodes pieces that are new and gives each a place in the flat store."""
        parts = [self.split(lead + p.replace(_KEPT, " ")) for p in pieces]
        fresh = list(dict.fromkeys(w for ws in parts for w in ws if w not in self.words))
        self.words.update(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        ids = [np.concatenate([self.words[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in parts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        base = len(self.start)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size])
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32, copy=False)
        into.update(zip(pieces, range(base, base + len(pieces))))

    def _cut(self, text: str) -> list[str]:
        """The text cut before single spaces between two non-blank characters, where a pretoken always begins."""
        if not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _ODD_BLANK(text)):
            return text.split(" ")
        return _EDGE(_KEPT, text).split(" ")

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces of each text, and the place of every piece in turn."""
        if len(self.start) > CACHE_PIECES:
            self._reset()
        cuts = [self._cut(t) if t else [] for t in texts]
        heads = [c[0] for c in cuts if c]
        tails = [p for c in cuts for p in c[1:]]
        if new := list(dict.fromkeys(p for p in heads if p not in self.first)):
            self._learn(new, self.first, "")
        if new := [p for p in dict.fromkeys(tails) if p not in self.inner]:
            self._learn(new, self.inner, " ")
        count = np.fromiter(map(len, cuts), np.int64, len(cuts))
        place = np.empty(len(heads) + len(tails), np.int64)
        ends = np.cumsum(count)
        is_head = np.zeros(len(place), bool)
        is_head[(ends - count)[count > 0]] = True
        place[is_head] = np.fromiter(map(self.first.__getitem__, heads), np.int64, len(heads))
        place[~is_head] = np.fromiter(map(self.inner.__getitem__, tails), np.int64, len(tails))
        return count, place

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]; null and empty texts have none."""
        count, place = self._places(texts)
        size = self.length[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - size, size) + np.repeat(self.start[place], size)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(count)]])
        return offsets, self.flat[at]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        count, place = self._places(texts)
        ends = np.concatenate([[0], np.cumsum(self.length[place])])[np.cumsum(count)]
        return np.diff(np.concatenate([[0], ends]))


def _leftmost_disjoint(hit: np.ndarray) -> np.ndarray:
    """Of each run of adjacent hits the first, third, ...: overlapping pairs such as aa in aaa merge from the left."""
    h = hit.astype(np.int64)
    col = np.arange(1, h.shape[1] + 1)
    before = np.maximum.accumulate(np.where(hit, 0, col), axis=1)
    return hit & ((col - before) % 2 == 1)


def _compact(m: np.ndarray) -> np.ndarray:
    """Moves the ids of each row to the left over the merged places; drops columns that are empty in all rows."""
    keep = m >= 0
    size = keep.sum(axis=1)
    out = np.full((len(m), int(size.max()) if len(m) else 0), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = m[keep]
    return out
