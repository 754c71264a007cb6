"""Arrow batches in parts of bounded size, whatever the length of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters that a worker handles at once.
CHUNK_CHARS = 4_000_000


def parts(*columns: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows with about `chars` characters in all columns; a longer row is a part of its own."""
    n = len(columns[0])
    size = np.zeros(n, np.int64)
    for texts in columns:
        size += np.fromiter((len(t) if t else 0 for t in texts), np.int64, n)
    ends, at = np.cumsum(size), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, side="right")))
        yield at, to
        at = to
