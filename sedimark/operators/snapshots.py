"""Changes between full snapshots of a keyed table.

The last snapshot is kept as an index: one entry for each key with two 64-bit hashes of its values, stored in buckets of the key's
hash. A delivery is reduced to entries, placed in the same buckets and probed against the index bucket by bucket, so the index is
read where it lies and never shuffled. What comes out is stored as the next index, with the kind of change beside each entry; it
takes the old one's place. Values are fetched for changed keys only (`with_values`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.session import bounded, bucketed, cut, is_small

SEEDS = (0, 0x5EED)
KEY = ["kh0", "kh1"]


def _hashes(columns: list[str], names: list[str]) -> list[Column]:
    """A hash of the columns for each seed; null differs from every value and equals null."""
    marked: list[Column] = []
    for c in columns:
        marked += [F.col(c).isNull(), F.col(c)]
    return [F.xxhash64(F.lit(s), *marked).alias(n) for s, n in zip(SEEDS, names)]


def snapshot_index(delivery: DataFrame, scope: list[str], key: list[str], values: list[str], loaded: str = "loaded_at") -> DataFrame:
    """(kh0, kh1, scope, key, h0, h1): one entry for each key of a delivery, of the row loaded last.

    Keys meet by 128 bits of hash. Of rows with the same key and loaded time the greater value hash counts, so the result doesn't
    depend on their order; a null loaded time is earlier than any other. Rows with a null key part are kept and null equals null.
    Rows of one key are aggregated map-side before they are shuffled.
    """
    rows = delivery.select(*scope, *key, F.col(loaded).alias("at"), *_hashes([*scope, *key], KEY), *_hashes(values, ["h0", "h1"]))
    last = rows.groupBy(*KEY).agg(F.max(F.struct("at", "h0", "h1")).alias("last"), *[F.max(c).alias(c) for c in [*scope, *key]])
    return last.select(*KEY, *scope, *key, F.col("last.h0").alias("h0"), F.col("last.h1").alias("h1"))


def successions(df: DataFrame, scope: list[str], snapshot: str = "snapshot_no") -> DataFrame:
    """(scope, snap): the snapshots that hold rows of a scope; rows without a snapshot are dropped."""
    return df.where(F.col(snapshot).isNotNull()).select(*scope, F.col(snapshot).alias("snap")).distinct()


def advance(index: DataFrame | None, delivery: DataFrame, scope: list[str], key: list[str], values: list[str], loaded: str = "loaded_at", flags: DataFrame | None = None) -> DataFrame:
    """One step, stored in buckets (`probe` says what it holds): the index that takes the place of `index`, with the delivery's changes."""
    return bucketed(probe(index, delivery, scope, key, values, loaded, flags), KEY)


def probe(index: DataFrame | None, delivery: DataFrame, scope: list[str], key: list[str], values: list[str], loaded: str = "loaded_at", flags: DataFrame | None = None) -> DataFrame:
    """A delivery against the index of the last snapshot (None before the first delivery).

    The rows are (kh0, kh1, scope, key, h0, h1, change_kind): what `entries` gives is the new index, what `changed` gives are the
    changes of this delivery. Entries of scopes that the delivery lacks stay as they are; a scope that the index doesn't know
    yet gives no changes. `flags`: (scope, came, known), derived from both sides if it isn't given.
    """
    new = snapshot_index(delivery, scope, key, values, loaded)
    if index is None:
        return new.withColumn("change_kind", F.lit(None).cast("string"))
    if flags is None:
        came, known = delivery.select(*scope).distinct().withColumn("came", F.lit(True)), index.select(*scope).distinct().withColumn("known", F.lit(True))
        met = came.alias("c").join(known.alias("k"), _same("c", "k", scope), "full_outer")
        flags = bounded(cut(met.select(*[F.when(F.col("came"), F.col(f"c.{s}")).otherwise(F.col(f"k.{s}")).alias(s) for s in scope], F.coalesce("came", F.lit(False)).alias("came"), F.coalesce("known", F.lit(False)).alias("known"))))
    old, fresh = index.withColumn("was", F.lit(True)).alias("a"), new.withColumn("now", F.lit(True)).alias("b")
    both = old.join(fresh, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer")
    pick = lambda c: F.when(F.col("b.now"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    moved = (F.col("a.h0") != F.col("b.h0")) | (F.col("a.h1") != F.col("b.h1"))
    kind = F.when(F.col("a.was").isNull(), "added").when(F.col("b.now").isNull(), "removed").when(moved, "changed")
    probed = both.select(*[pick(c).alias(c) for c in [*KEY, *scope, *key, "h0", "h1"]], kind.alias("change_kind"))
    told = probed.alias("p").join(flags.alias("f"), _same("p", "f", scope), "left")
    quiet = ((F.col("change_kind") == "added") & ~F.col("f.known")) | ((F.col("change_kind") == "removed") & ~F.col("f.came"))
    return told.select(*[F.col(f"p.{c}") for c in [*KEY, *scope, *key, "h0", "h1"]], F.when(~quiet, F.col("change_kind")).alias("change_kind"))


def entries(step: DataFrame) -> DataFrame:
    """The index that a step left: every key that it holds."""
    return step.where("change_kind is null or change_kind <> 'removed'").drop("change_kind")


def changed(step: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """(scope, key, change_kind): the changes of a step."""
    return step.where("change_kind is not null").select(*scope, *key, "change_kind")


def changes(df: DataFrame, scope: list[str], key: list[str], values: list[str], snapshot: str = "snapshot_no", loaded: str = "loaded_at") -> DataFrame:
    """(scope, key, snapshot, change_kind): the added, removed and changed keys of each snapshot against the scope's preceding one.

    The deliveries go through `advance` one after the other. `snapshot` is the later of the two. The first snapshot of a scope
    gives no rows, nor does a snapshot that lacks the scope. An empty table gives none. Columns beside those named are not read.
    """
    seen = cut(successions(df, scope, snapshot))
    few = is_small(seen)
    found, index = [], None
    for (n,) in seen.select("snap").distinct().orderBy("snap").collect():
        flags = seen.where(F.col("snap") <= n).groupBy(*scope).agg(F.max(F.col("snap") == n).alias("came"), F.max(F.col("snap") < n).alias("known"))
        step = advance(index, df.where(F.col(snapshot) == n), scope, key, values, loaded, F.broadcast(flags) if few else flags)
        index = entries(step)
        found.append(changed(step, scope, key).select(*scope, *key, F.lit(n).cast(df.schema[snapshot].dataType).alias(snapshot), "change_kind"))
    if not found:
        return df.where("false").select(*scope, *key, snapshot, F.lit(None).cast("string").alias("change_kind"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_values(found: DataFrame, df: DataFrame, scope: list[str], key: list[str], values: list[str], snapshot: str = "snapshot_no", loaded: str = "loaded_at") -> DataFrame:
    """`found` with the values before and after as structs `old` and `new`; values are looked up for the changed keys only.

    Of rows with the same key, snapshot and loaded time the one with the greater hash counts, as in the index.
    """
    near = successions(df, scope, snapshot)
    near = near.alias("a").join(near.alias("b"), [*_same("a", "b", scope), F.col("b.snap") < F.col("a.snap")]).groupBy(*[F.col(f"a.{c}").alias(c) for c in scope], F.col("a.snap").alias("snap")).agg(F.max("b.snap").alias("prv"))
    wanted = found.alias("c").join(bounded(cut(near)).alias("s"), [*_same("c", "s", scope), F.col(f"c.{snapshot}") == F.col("s.snap")])
    wanted = wanted.select(*[F.col(f"c.{c}").alias(c) for c in [*scope, *key]], F.col(f"c.{snapshot}").alias(snapshot), "change_kind", F.explode(F.array("s.snap", "s.prv")).alias("snap"))
    rows = df.select(*scope, *key, F.col(snapshot).alias("snap"), F.struct(F.col(loaded).alias("at"), *_hashes(values, ["h0", "h1"]), F.struct(*values).alias("v")).alias("r"))
    got = wanted.alias("w").join(rows.alias("r"), [*_same("w", "r", [*scope, *key]), F.col("w.snap") == F.col("r.snap")], "left")
    same = F.col("w.snap") == F.col(f"w.{snapshot}")
    return (
        got.groupBy(*[F.col(f"w.{c}").alias(c) for c in [*scope, *key]], F.col(f"w.{snapshot}").alias(snapshot), F.col("w.change_kind").alias("change_kind"))
        .agg(F.max(F.when(~same, F.col("r.r"))).alias("a"), F.max(F.when(same, F.col("r.r"))).alias("b"))
        .select(*scope, *key, snapshot, "change_kind", F.col("a.v").alias("old"), F.col("b.v").alias("new"))
    )


def _same(a: str, b: str, cols: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
