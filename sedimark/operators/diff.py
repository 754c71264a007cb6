"""Differences of snapshots and bags, covering roots, rates and their fold into one index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.session import bounded, cut

#: Weights of the uncertainty index.
WEIGHTS = {"coll": 0.30, "join": 0.25, "lin": 0.30, "code": 0.15}


def latest(df: DataFrame, keys: list[str], values: list[str], loaded: str = "loaded_at") -> DataFrame:
    """Of rows with the same keys the values loaded last; of equal times the greater values."""
    return df.groupBy(*keys).agg(F.max(F.struct(loaded, *values)).alias("_l")).select(*keys, *[F.col(f"_l.{v}").alias(v) for v in values])


def neighbours(df: DataFrame, scope: str = "repo", snapshot: str = "snapshot_no") -> tuple[DataFrame, DataFrame]:
    """(old, new): the rows of every snapshot with a preceding one that holds rows of the same scope, and those of that one; in both
    the snapshot is the later one. Rows without a snapshot are left out."""
    steps = df.where(F.col(snapshot).isNotNull()).select(F.col(scope).alias("_s"), F.col(snapshot).alias("_n")).distinct().withColumn("_p", F.lag("_n").over(Window.partitionBy("_s").orderBy("_n"))).where("_p is not null")
    steps = bounded(cut(steps))
    side = lambda at: df.join(steps, F.col(scope).eqNullSafe(F.col("_s")) & (F.col(snapshot) == F.col(at))).withColumn(snapshot, F.col("_n")).drop("_s", "_n", "_p")
    return side("_p"), side("_n")


def file_status(signatures: DataFrame) -> DataFrame:
    """(snapshot_no, repo, path, status): unchanged, changed, deleted or added against the repo's preceding snapshot; null hashes are equal."""
    keys = ["snapshot_no", "repo", "path"]
    old, new = neighbours(latest(signatures, keys, ["sha256"]))
    sides = old.select(*keys, F.struct("sha256").alias("a"), F.lit(None).cast("struct<sha256:string>").alias("b")).unionByName(new.select(*keys, F.lit(None).cast("struct<sha256:string>").alias("a"), F.struct("sha256").alias("b")))
    both = sides.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "unchanged").otherwise("changed")
    return both.select(*keys, status.alias("status"))


def bag_match(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """C11: (keys, n_old, n_new, confirmed, drifted): citations matched as bags, each fresh row confirming one old row.

    Null keys match null keys. Counts are aggregated map-side, so a hot key costs one row a task.
    """
    sides = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    per = sides.groupBy(*keys).agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"))
    hit = F.least("n_old", "n_new")
    return per.where("n_old > 0").select(*keys, "n_old", "n_new", hit.alias("confirmed"), (F.col("n_old") - hit).alias("drifted"))


def set_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): rows only in `after` (added) or only in `before` (removed), as sets; nulls equal."""
    a, b = before.select(*keys), after.select(*keys)
    return b.subtract(a).select(F.lit("added").alias("side"), *keys).unionByName(a.subtract(b).select(F.lit("removed").alias("side"), *keys))


def residue(delta: DataFrame, relation: str, confined: list[str] | None = None) -> DataFrame:
    """rows of a delta that break a relation: unchanged, confined_to, confined_to_rules or grows_only."""
    if relation == "unchanged":
        return delta
    if relation == "grows_only":
        return delta.where("side = 'removed'")
    column = {"confined_to": "file", "confined_to_rules": "rule_id"}[relation]
    return delta.where(~F.coalesce(F.col(column).isin(confined or []), F.lit(False)))


def key_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, file, added, removed, verdict) of two key sets (repo, file, keys): structure or values-only."""
    none = F.expr("cast(array() as array<string>)")
    both = old.withColumnRenamed("keys", "a").join(new.withColumnRenamed("keys", "b"), ["repo", "file"], "full_outer")
    both = both.select("repo", "file", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    added, removed = F.array_sort(F.array_except("b", "a")), F.array_sort(F.array_except("a", "b"))
    return both.select("repo", "file", added.alias("added"), removed.alias("removed"), F.when((F.size(added) > 0) | (F.size(removed) > 0), "structure").otherwise("values-only").alias("verdict"))


def inventory_root(signatures: DataFrame, scope: str = "repo") -> DataFrame:
    """(scope, root): SHA-256 over the lines path NUL signature LF in path order, a missing signature empty.

    The hash is sequential by definition: a repo's rows stream through one task in sorted batches, and only the hash state is kept.
    """
    rows = signatures.where("path is not null").select(F.col(scope).alias("repo"), "path", F.coalesce("sha256", F.lit("")).alias("sha256")).distinct().repartition("repo").sortWithinPartitions("repo", "path", "sha256")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h, seen = None, None, False
        for pdf in batches:
            out = []
            for repo, path, sig in pdf.itertuples(index=False, name=None):
                if not seen or repo != at:
                    if seen:
                        out.append((at, h.hexdigest()))
                    at, h, seen = repo, hashlib.sha256(), True
                h.update(path.encode() + b"\0" + sig.encode() + b"\n")
            yield pd.DataFrame(out, columns=["repo", "root"])
        if seen:
            yield pd.DataFrame([(at, h.hexdigest())], columns=["repo", "root"])

    return rows.mapInPandas(run, "repo string, root string").withColumnRenamed("repo", scope)


def merkle_root(signatures: DataFrame, scope: tuple[str, ...] = ("repo",), buckets: int = 256) -> DataFrame:
    """(scope, root): a two-level root for repos of any size: hashes of the rows of each bucket, then the hash of those in order."""
    leaf = F.sha2(F.concat_ws("\0", "path", F.coalesce("sha256", F.lit(""))), 256)
    rows = signatures.where("path is not null").select(*scope, "path", "sha256").distinct().select(*scope, leaf.alias("leaf"), F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b"))
    word = lambda i: F.conv(F.substring("leaf", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    inner = rows.groupBy(*scope, "b").agg(*[F.sum(word(i)).alias(f"s{i}") for i in range(4)], F.count("*").alias("n"))
    each = F.struct("b", F.concat_ws(":", *[f"s{i}" for i in range(4)], "n").alias("h"))
    return inner.groupBy(*scope).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["h"]), "|"), 256).alias("root"))


def uncertainty(coll: Column, join: Column, lin: Column, code: Column, absent: Column, unproven: Column) -> Column:
    """(u, claim) of four rates: a weighted sum of residuals, missing rates as perfect; null where none was measured."""
    zero, one = F.lit(0.0), F.lit(1.0)
    u = WEIGHTS["coll"] * F.coalesce(coll, zero) + WEIGHTS["join"] * (1 - F.coalesce(join, one)) + WEIGHTS["lin"] * (1 - F.coalesce(lin, one)) + WEIGHTS["code"] * (1 - F.coalesce(code, one))
    measured = sum((c.isNotNull().cast("int") for c in (coll, join, lin, code)), F.lit(0))
    stamps = (absent > 0) | (unproven > 0)
    claim = (
        F.when((measured == 0) & stamps, "vacuous_no_support_with_s3_stamps")
        .when(measured == 0, "vacuous_no_support")
        .when(stamps, "comparison_index_with_unscored_s3")
        .when(measured < 4, "comparison_index_partial_support")
        .otherwise("comparison_index_full_support")
    )
    return F.struct(F.when(measured > 0, u).alias("u"), claim.alias("claim"))


def ratchet(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule_id, was, now, verdict) of counts by rule (rule_id, n): lost, grew, new, shrank or same."""
    both = before.withColumnRenamed("n", "was").join(after.withColumnRenamed("n", "now"), "rule_id", "full_outer").select("rule_id", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    verdict = F.when((F.col("was") > 0) & (F.col("now") == 0), "lost").when((F.col("was") == 0) & (F.col("now") > 0), "new").when(F.col("now") > F.col("was"), "grew").when(F.col("now") < F.col("was"), "shrank").otherwise("same")
    return both.withColumn("verdict", verdict)


def failure_budget(failures: DataFrame, keep: Column, order: list[str], budget: int) -> DataFrame:
    """(n, kept, loss): rows, those within the first `budget` by order, and the share of must-keep rows that fall outside."""
    head = failures.orderBy(*order).limit(budget)
    n, must = F.count("*"), F.count_if(keep)
    a = failures.agg(n.alias("n"), must.alias("must"))
    b = head.agg(n.alias("kept"), must.alias("kept_must"))
    return a.withColumn("k", F.lit(0)).join(b.withColumn("k", F.lit(0)), "k").select("n", "kept", F.when(F.col("must") > 0, 1 - F.col("kept_must") / F.col("must")).alias("loss"))
