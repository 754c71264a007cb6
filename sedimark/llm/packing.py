"""Filling containers of fixed capacity with whole items.

Sizes are integers up to the capacity, so a corpus of any size is a histogram of at most `capacity` counts. The packing is
computed on that histogram: a Martello-Toth reduction fixes sets of sizes that dominate every other set that a size could share
a container with, as often as the counts allow, and best fit places what remains, again by counts. The result is a short list
of container patterns with multiplicities. Items then find their container from their rank among the items of their size,
without any item leaving its partition for the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.session import cut

#: Items of one size that a task ranks: a size that more items share is split into so many buckets that each has about as many.
ITEMS_A_BUCKET = 250_000
#: Bits of a size and of a bucket in a cell's number; the rest numbers the container kinds.
SIZE_BITS, BUCKET_BITS = 31, 20


@dataclass
class Packing:
    """Patterns ({size: quantity}, containers of that pattern)."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    reduced: int = 0  # containers fixed by dominance

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.patterns)


class _Counts:
    """Counts by size with the sizes that are left in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: int(c) for s, c in counts.items() if c > 0 and s > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, many: int) -> None:
        self.n[size] -= many
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def at_most(self, x: int, without: int = 0) -> int:
        """The largest size left of at most x, one item of size `without` aside; 0 if none."""
        i = bisect_right(self.sizes, x) - 1
        if i >= 0 and self.sizes[i] == without and self.n[without] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items left, one item of size `without` aside."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - (s == without))
            if len(out) >= k:
                break
        return out


def _dominating(left: _Counts, s: int, capacity: int) -> list[int] | None:
    """The companions that provably serve an item of size s at least as well as any others, or None where that isn't proven."""
    room = capacity - s
    best = left.at_most(room, s)
    if not best:
        return []
    if best == room:
        return [best]
    low = left.smallest(3, s)
    if len(low) < 2 or low[0] + low[1] > room:  # no two others fit: the largest single one dominates
        return [best]
    if len(low) < 3 or sum(low) > room:  # at most two others fit
        top = 0
        for a in left.sizes[: bisect_right(left.sizes, room // 2)]:
            if left.n[a] - (a == s) < 1:
                continue
            b = left.at_most(room - a, s)
            if b and (b != a or left.n[a] - (a == s) >= 2):
                top = max(top, a + b)
        if best >= top:
            return [best]
        second = left.at_most(room - best, s)
        spare = left.n.get(second, 0) - (second == s) - (second == best)
        half = left.at_most(room // 2, s)
        if second and spare >= 1 and second >= half:  # covers any single item by best, any pair by best and second
            return [best, second]
    return None


def pack_counts(counts: dict[int, int], capacity: int) -> Packing:
    """Packs `counts[size]` items of each size into containers of `capacity`."""
    left, out = _Counts(counts), Packing(capacity)
    if left.sizes and left.sizes[-1] > capacity:
        raise ValueError("an item is larger than the capacity")
    changed = True
    while changed and left.sizes:
        changed = False
        for s in reversed(list(left.sizes)):
            while s in left.n:
                mates = _dominating(left, s, capacity)
                if mates is None:
                    break
                need: dict[int, int] = defaultdict(int)
                for x in [s, *mates]:
                    need[x] += 1
                many = min(left.n[x] // k for x, k in need.items())
                for x, k in need.items():
                    left.take(x, many * k)
                out.patterns.append((dict(need), many))
                out.reduced += many
                changed = True
    # best fit, largest first; open containers by the room they have left
    rooms: list[int] = []
    open_by: dict[int, list[tuple[dict[int, int], int]]] = {}

    def shelve(room: int, pattern: dict[int, int], many: int) -> None:
        if room == 0:
            out.patterns.append((pattern, many))
            return
        if room not in open_by:
            insort(rooms, room)
            open_by[room] = []
        open_by[room].append((pattern, many))

    for s in reversed(list(left.sizes)):
        n = left.n[s]
        while n:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, many = open_by[room].pop()
                if not open_by[room]:
                    del open_by[room]
                    rooms.pop(i)
            else:
                room, pattern, many = capacity, {}, n
            fit = room // s
            full = min(many, n // fit)
            if full:
                shelve(room - fit * s, pattern | {s: fit}, full)
                n -= full * fit
            if full < many and n and n < fit:
                shelve(room - n * s, pattern | {s: n}, 1)
                n, full = 0, full + 1
            if full < many and pattern:
                shelve(room, pattern, many - full)
    for room in rooms:
        out.patterns += open_by[room]
    return out


class Slots:
    """Rank of an item among the items of its size -> container, for all capacities at once, as sorted arrays."""

    def __init__(self, packings: list[Packing], cells: np.ndarray, counts: np.ndarray) -> None:
        """counts of items by cell (container kind, size, bucket), in ascending order of cells."""
        self.cells, self.before = cells, np.cumsum(counts) - counts
        ends = np.concatenate([self.before, [int(counts.sum())]])
        start, first, each = [], [], []
        for k, p in enumerate(packings):
            by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            at = 0
            for pattern, many in p.patterns:
                for s, qty in pattern.items():
                    by_size[s].append((at, qty, many))
                at += many
            low, high = (int(np.searchsorted(cells, cell_of(k, s, 0))) for s in (0, 1))
            if ends[high] > ends[low]:
                by_size[0].append((0, int(ends[high] - ends[low]), 1))
            for s, slots in sorted(by_size.items()):
                rank = int(ends[np.searchsorted(cells, cell_of(k, s, 0))])
                for at, qty, many in slots:
                    start.append(rank)
                    first.append(at)
                    each.append(qty)
                    rank += qty * many
        self.start, self.first, self.each = (np.array(x, np.int64) for x in (start, first, each))

    def container(self, pack: np.ndarray, size: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = self.before[np.searchsorted(self.cells, cell_of(pack, size, bucket))] + rank
        slot = np.searchsorted(self.start, at, side="right") - 1
        return self.first[slot] + (at - self.start[slot]) // self.each[slot]


def cell_of(pack, size, bucket):
    """The number of a cell."""
    pack, size, bucket = (x if isinstance(x, int) else np.asarray(x, np.int64) for x in (pack, size, bucket))
    return (pack << (SIZE_BITS + BUCKET_BITS)) | (size << BUCKET_BITS) | bucket


def _capacities(packs: DataFrame) -> list[tuple[int, int]]:
    """(pack_id, capacity) of the container kinds, a table of parameters: each kind has one capacity."""
    got = sorted((r[0], r[1]) for r in packs.select("pack_id", "capacity_tokens").where("pack_id is not null and capacity_tokens > 0").distinct().collect())
    if len({k for k, _ in got}) < len(got) or any(c >= 1 << SIZE_BITS for _, c in got) or len(got) >= 1 << (63 - SIZE_BITS - BUCKET_BITS):
        raise ValueError("each container kind needs one capacity that is a 32-bit integer")
    return got


def _pieces(sizes: DataFrame, caps: list[tuple[int, int]], id_col: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).cast("long").alias("c")) for i, (_, c) in enumerate(caps)])
    n, c = F.col("n_tokens"), F.col("kind.c")
    return (
        sizes.select(id_col, "n_tokens", F.explode(kinds).alias("kind"))
        .select(id_col, "n_tokens", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(n / c) - 1))).alias("piece_no"))
        .select(id_col, F.col("kind.k").alias("k"), "piece_no", F.least(c, n - F.col("piece_no") * c).alias("size"))
    )


def _cell() -> Column:
    """The number of a piece's first cell."""
    return F.shiftleft(F.col("k").cast("long"), SIZE_BITS + BUCKET_BITS).bitwiseOR(F.shiftleft("size", BUCKET_BITS))


def _bucketed(pieces: DataFrame, hot: dict[int, int], id_col: str) -> DataFrame:
    """`pieces` with their bucket: 0, but for the sizes that more than ITEMS_A_BUCKET items share, by their first cell."""
    if not hot:
        return pieces.withColumn("bucket", F.lit(0).cast("long"))
    many = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])
    return pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece_no"), F.coalesce(many[_cell()], F.lit(1).cast("long"))))


def pack_corpus(sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Places every item of `sizes` (id, n_tokens) into containers of every kind of `packs` (pack_id, capacity_tokens).

    Result: (pack_id, id, piece_no, n_tokens, container_id), one row for each item that is not longer than the capacity; a longer
    one is cut into full containers and a rest, a row each. Container ids count from 0 in each pack. Items of length 0 (null
    and empty texts) take no room and come with container 0. Null lengths count as 0. Repeated rows are separate items.
    """
    return _placed(sizes, _capacities(packs), id_col, [])


def _placed(sizes: DataFrame, caps: list[tuple[int, int]], id_col: str, fixed: list[Packing]) -> DataFrame:
    """As pack_corpus; the packings are appended to `fixed`."""
    kind = sizes.schema[id_col].dataType.simpleString()
    if not caps:
        return sizes.sparkSession.createDataFrame([], f"pack_id int, `{id_col}` {kind}, piece_no int, n_tokens int, container_id bigint")
    sizes = cut(sizes.select(id_col, F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")))
    pieces, slots, packings = plan(_pieces(sizes, caps, id_col), [c for _, c in caps], id_col)
    fixed += packings
    shared = sizes.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf("bigint")
    def container(k: pd.Series, size: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(shared.value.container(k.to_numpy(), size.to_numpy(), bucket.to_numpy(), rank.to_numpy()))

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("k", "size", "bucket").orderBy(id_col, "piece_no")) - 1)
    ids = F.array(*[F.lit(p) for p, _ in caps])
    return ranked.select(
        ids[F.col("k")].cast("int").alias("pack_id"), id_col, F.col("piece_no").cast("int").alias("piece_no"),
        F.col("size").cast("int").alias("n_tokens"), container("k", "size", "bucket", "rank").alias("container_id"),
    )


def plan(pieces: DataFrame, caps: list[int], id_col: str) -> tuple[DataFrame, Slots, list[Packing]]:
    """(pieces with their bucket, where each goes, the packings). One count for each size that occurs reaches the driver, at most
    sum(capacities), and one for each bucket of a size with several."""
    rows = pieces.groupBy("k", "size").agg(F.count("*").alias("n")).toPandas().to_numpy(np.int64).tolist()
    counts: list[dict[int, int]] = [{} for _ in caps]
    for k, s, n in rows:
        counts[k][s] = n
    hot = {cell_of(k, s, 0): min(-(-n // ITEMS_A_BUCKET), 1 << BUCKET_BITS) for k, s, n in rows if n > ITEMS_A_BUCKET}
    placed, cells = _bucketed(pieces, hot, id_col), {cell_of(k, s, 0): n for k, s, n in rows if n <= ITEMS_A_BUCKET}
    if hot:
        split = placed.where(_cell().isin(list(hot))).groupBy("k", "size", "bucket").agg(F.count("*").alias("n")).toPandas().to_numpy(np.int64).tolist()
        cells |= {cell_of(k, s, b): n for k, s, b, n in split}
    order = sorted(cells)
    packings = [pack_counts({s: n for s, n in of.items() if s}, c) for of, c in zip(counts, caps)]
    return placed, Slots(packings, np.array(order, np.int64), np.array([cells[c] for c in order], np.int64)), packings


def pack_report(sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per pack: containers, how many of them dominance fixed, pieces, tokens, the fullest container, the fewest containers that could
    hold the tokens, and the share of room in use. Packs without any item of some length have no row."""
    caps = _capacities(packs)
    fixed: list[Packing] = []
    placed = _placed(sizes, caps, id_col, fixed)
    kinds = sizes.sparkSession.createDataFrame([(p, c, f.reduced) for (p, c), f in zip(caps, fixed)], "pack_id int, cap bigint, n_fixed bigint")
    by = placed.where("n_tokens > 0").groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return (
        by.groupBy("pack_id")
        .agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
        .join(kinds, "pack_id")
        .select("pack_id", F.col("cap").alias("capacity_tokens"), "n_containers", "n_fixed", "n_pieces", "n_tokens", "fullest",
                F.ceil(F.col("n_tokens") / F.col("cap")).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("cap"))).alias("fill"))
    )
