"""Imports resolved to files, edges cut by a cover of groups, closures of edge tables, token-bounded grouping."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.text import java_package
from sedimark.operators.entities import class_of
from sedimark.operators.inventory import with_path
from sedimark.session import cut, staged


def parsed(files: DataFrame) -> DataFrame:
    """(repo, file, package, stem, imports): the Java files with what their text declares, stored once for all that follows."""
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    found = F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+((?:static\s+)?[\w.]+(?:\.\*)?)\s*;"), 1)
    return staged(java.select("repo", F.col("path").alias("file"), java_package(F.col("content")).alias("package"), class_of(F.col("path")).alias("stem"), found.alias("imports")))


def declarations(java: DataFrame) -> DataFrame:
    """(repo, package, stem, file): the file that declares a type; of several with one name the greatest path. `java`: parsed files."""
    return java.where("package <> ''").groupBy("repo", "package", "stem").agg(F.max("file").alias("file"))


def members(java: DataFrame) -> DataFrame:
    """(repo, package, file): all files that declare a package. `java`: parsed files."""
    return java.where("package <> ''").select("repo", "package", "file").distinct()


def imports(java: DataFrame) -> DataFrame:
    """(repo, file, qualified, static): the distinct imports of each Java file. `java`: parsed files."""
    rows = java.select("repo", "file", F.explode("imports").alias("x"))
    return rows.select("repo", "file", F.regexp_replace("x", r"^static\s+", "").alias("qualified"), F.col("x").startswith("static ").alias("static")).distinct()


def resolve(imported: DataFrame, declared: DataFrame, packaged: DataFrame) -> DataFrame:
    """(repo, file, qualified, static, target, confidence) for each file an import may mean; target null if unresolved.

    A wildcard means every file of its package. Another name is shortened one part at a time; at each step the type by that name
    counts (exact), else every file of the package (package-fanout); the longest name that gives anything wins. Each distinct name
    probes types and packages with its prefixes; only the package that wins is expanded to its files.
    """
    parts = F.split("qualified", r"\.")
    wild = F.col("qualified").endswith(".*")
    depth = F.explode(F.when(wild, F.array(F.size(parts) - 1)).otherwise(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))))
    names = imported.select("repo", "qualified").distinct()  # what a name means doesn't depend on who imports it
    probes = names.withColumn("parts", parts).withColumn("wild", wild).withColumn("depth", depth).where("size(parts) > 1")
    probes = probes.select("repo", "qualified", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), ".").alias("package"), F.when(~F.col("wild"), F.element_at("parts", F.col("depth") + 1)).alias("stem"))
    types = declared.withColumnRenamed("file", "exact")
    packages = packaged.select("repo", "package").distinct().withColumn("there", F.lit(True))
    met = probes.join(types, ["repo", "package", "stem"], "left").join(packages, ["repo", "package"], "left").where("exact is not null or there")
    best = met.groupBy("repo", "qualified").agg(F.max_by(F.struct("exact", "package"), "depth").alias("b")).select("repo", "qualified", "b.exact", "b.package")
    one = best.where("exact is not null").select("repo", "qualified", F.col("exact").alias("target"), F.lit("exact").alias("confidence"))
    many = best.where("exact is null").join(packaged, ["repo", "package"]).select("repo", "qualified", F.col("file").alias("target"), F.lit("package-fanout").alias("confidence"))
    out = imported.join(one.unionByName(many), ["repo", "qualified"], "left")
    return out.select("repo", "file", "qualified", "static", "target", F.coalesce("confidence", F.lit("unresolved")).alias("confidence"))


def cut_edges(resolved: DataFrame, membership: DataFrame) -> DataFrame:
    """(repo, file, target, qualified, confidence): resolved arcs whose ends share no group.

    membership: (repo, file, groups ARRAY): a cover, so a file may be in several groups; a file in none shares none.
    """
    arcs = resolved.where("target is not null and target <> file").select("repo", "file", "target", "qualified", "confidence").distinct()
    none = F.expr("cast(array() as array<int>)")
    a = membership.select("repo", "file", F.col("groups").alias("from_groups"))
    b = membership.select("repo", F.col("file").alias("target"), F.col("groups").alias("to_groups"))
    met = arcs.join(a, ["repo", "file"], "left").join(b, ["repo", "target"], "left")
    return met.where(~F.arrays_overlap(F.coalesce("from_groups", none), F.coalesce("to_groups", none))).select("repo", "file", "target", "qualified", "confidence")


def adjacency(packaged: DataFrame, groups: DataFrame) -> DataFrame:
    """(repo, package, group_id, n_inside, n_outside): packages with files in and out of a group; no pairs are formed."""
    sizes = packaged.groupBy("repo", "package").agg(F.count("*").alias("n")).where("n > 1")
    inside = packaged.join(groups.select("repo", "file", "group_id").distinct(), ["repo", "file"]).groupBy("repo", "package", "group_id").agg(F.count("*").alias("n_inside"))
    return inside.join(sizes, ["repo", "package"]).where("n_inside < n").select("repo", "package", "group_id", "n_inside", (F.col("n") - F.col("n_inside")).alias("n_outside"))


def group_files(ordered: DataFrame, max_tokens: int = 8000, overlap: float = 0.1) -> DataFrame:
    """G1: (repo, group_id, pos, path, tokens): files in walking order in overlapping groups of at most `max_tokens`.

    Groups are intervals of the order. One ends where the limit or, but for the last planned one, its even share of the total is
    reached, and the next begins up to `overlap` of its tokens earlier, never before its own first new file. A longer file has a
    group alone. Every interval depends on the one before it, so a repo is one sequence: its rows (path and tokens only) pass through
    one task in sorted batches, and only the rows of the open interval are held.
    """
    totals = ordered.groupBy("repo").agg(F.sum("tokens").alias("total"))
    rows = ordered.join(totals, "repo").select("repo", "pos", "path", "tokens", "total").repartition("repo").sortWithinPartitions("repo", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cover = None, None
        for pdf in batches:
            for repo, rows in pdf.groupby("repo", sort=False, dropna=False):
                if cover and not _same_name(cover.repo, repo):
                    yield cover.cut(held, len(held))
                    held, cover = None, None
                if cover is None:
                    cover = _Cover(repo, int(rows["total"].iloc[0]), max_tokens, overlap)
                held = rows[["path", "tokens"]] if held is None else pd.concat([held, rows[["path", "tokens"]]])
                sums = np.concatenate([[0], held["tokens"].to_numpy(np.int64).cumsum()])
                while (end := cover.end(sums)) is not None:
                    yield cover.cut(held, end)
                    start = cover.restart(sums, end)
                    held, sums = held.iloc[start:], sums[start:] - sums[start]
        if cover and len(held):
            yield cover.cut(held, len(held))

    return rows.mapInPandas(run, "repo string, group_id int, pos int, path string, tokens bigint")


def _same_name(a: object, b: object) -> bool:
    return a == b or (a is None or a != a) and (b is None or b != b)


class _Cover:
    """Where the intervals of one repo end and begin, from prefix sums of the tokens since the open one's first file."""

    def __init__(self, repo: str, total: int, most: int, overlap: float) -> None:
        self.repo, self.most, self.overlap = repo, most, overlap
        self.planned = max(1, -(-total // most))
        self.share = total / self.planned
        self.done = self.old = 0  # intervals that ended; files of the open one that the last one held as well

    def _least(self, size: float) -> bool:
        """Whether an interval of that size has its share, which the last planned one doesn't have to stop at."""
        return self.done != self.planned - 1 and size >= self.share

    def end(self, sums: np.ndarray) -> int | None:
        """The first place at which the open interval must end before another file, or None where all that is known fits."""
        low = max(self.old, 1)
        end = max(low, int(np.searchsorted(sums, self.most, side="right")) - 1)
        if self.done != self.planned - 1:
            end = min(end, max(low, int(np.searchsorted(sums, self.share))))
        return end if end < len(sums) - 1 else None

    def restart(self, sums: np.ndarray, end: int) -> int:
        """The first file of the next interval: of the files that are new in this one the longest tail whose files but the first are
        less than the overlap, and which is less than the limit. A tail that would end at once and is all of this interval is none."""
        size = int(sums[end])
        short = int(np.searchsorted(sums[: end + 1], size - size * self.overlap, side="right")) - 1
        start = min(end, max(short, int(np.searchsorted(sums[: end + 1], size - self.most, side="right")), self.old))
        if start == 0 and (int(sums[end + 1]) > self.most or self._least(size)):
            start = end
        self.old = end - start
        return start

    def cut(self, held: pd.DataFrame, end: int) -> pd.DataFrame:
        """The rows of the interval that ends here."""
        out = held.iloc[:end].assign(repo=self.repo, group_id=self.done, pos=range(end))
        self.done += 1
        return out[["repo", "group_id", "pos", "path", "tokens"]]


def membership(groups: DataFrame) -> DataFrame:
    """(repo, file, groups): the groups of each file, sorted."""
    return groups.groupBy("repo", F.col("path").alias("file")).agg(F.array_sort(F.collect_set("group_id")).alias("groups"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): strict reachability over `edges` (src, dst), with the least number of steps; cycles are fine.

    Only pairs found in the last round are extended. Lineage is cut in each round; rounds end when no pair is new, however
    long the paths are.
    """
    known = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    base = known.select("src", "dst")
    fresh = known
    for depth in count(2):
        step = fresh.select("src", F.col("dst").alias("mid")).join(base.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = cut(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        if depth % 16 == 0:
            known = cut(known)
    return known


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo, name): the names from which a target (name) can be reached over edges (repo, src, dst), cycles or not, by steps back from
    the targets; only names, never pairs, are kept."""
    known = fresh = cut(edges.join(targets.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("repo", F.col("src").alias("name")).distinct())
    while not fresh.isEmpty():
        step = edges.join(fresh.withColumnRenamed("name", "dst"), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("name")).distinct()
        fresh = cut(step.join(known, ["repo", "name"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def most_specific(candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """C17: rows of `candidates` (id, type) whose type reaches no other candidate type of the same id below it."""
    lower = candidates.select("id", F.col("type").alias("src")).join(reach.select("src", "dst"), "src").select("id", F.col("dst").alias("type")).distinct()
    return candidates.join(lower, ["id", "type"], "left_anti")


def unique_ids(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """`rows` with node: the base name, with _2, _3, ... for repeats in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("n", n).withColumn("node", F.when(F.col("n") > 1, F.concat_ws("_", base, "n")).otherwise(F.col(base))).drop("n")
