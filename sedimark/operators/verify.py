"""Re-verification, anchors, names contained in each other, summaries, fallbacks, slices and code metrics."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import posix, token_key
from sedimark.operators.evidence import BUCKETS
from sedimark.operators.inventory import with_path

#: Lines around a citation in which its symbol must stand, and the order in which an arm of scanners is trusted.
WINDOW = 8
ARMS = ("codeql", "astgrep", "filesystem")


def recheck(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, status, moved): confirmed if all fields are equal (nulls equal), drifted with the names of those that aren't, or missing."""
    a, b = old.alias("a"), new.withColumn("there", F.lit(True)).alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    moved = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    there = F.col("b.there").isNotNull()
    out = met.select(*[F.col(f"a.{k}").alias(k) for k in keys], there.alias("t"), moved.alias("m"))
    status = F.when(~F.col("t"), "missing").when(F.size("m") > 0, "drifted").otherwise("confirmed")
    return out.select(*keys, status.alias("status"), F.when(F.col("t"), F.array_join("m", ",")).alias("moved"))


def with_lines(rows: DataFrame, files: DataFrame, reach: int = 0) -> DataFrame:
    """`rows` (repo, path, line, ...) with near: the text of the lines from `reach` before to `reach` after each row's line, and n_lines.

    Each file is split once: its rows are first reduced to the distinct lines they name, so a file meets one list of lines, and the
    pieces go back to the rows by line. Rows whose file is unknown are left out; near is null for null lines and those outside of the file. Carriage
    returns are left out. Of a file delivered more than once the greatest file_id counts.
    """
    text = with_path(files).where("content is not null").groupBy("repo", "path").agg(F.max_by("content", "file_id").alias("content"))
    wanted = rows.groupBy("repo", "path").agg(F.array_sort(F.collect_set(F.coalesce("line", F.lit(0)))).alias("wanted"))
    split = wanted.join(text, ["repo", "path"]).withColumn("lines", F.split(F.regexp_replace("content", "\r", ""), "\n"))
    size = F.size("lines")
    start = lambda n: F.greatest(F.lit(1), n - reach)
    piece = lambda n: F.when((n > 0) & (n <= size), F.array_join(F.slice("lines", start(n), n + reach - start(n) + 1), "\n"))
    each = split.select("repo", "path", size.alias("n_lines"), F.explode_outer(F.transform("wanted", lambda n: F.struct(n.alias("line"), piece(n).alias("near")))).alias("e"))
    pieces = each.select("repo", "path", "n_lines", F.col("e.line").alias("line"), F.col("e.near").alias("near"))
    on = [F.col("r.repo") == F.col("p.repo"), F.col("r.path") == F.col("p.path"), F.coalesce(F.col("r.line"), F.lit(0)) == F.col("p.line")]
    return rows.alias("r").join(pieces.alias("p"), on).select("r.*", "p.near", "p.n_lines")


def anchors(evidence: DataFrame, files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(evidence_id, verdict): whether a row's longest word stands near its line (near), elsewhere in its file (far) or nowhere (absent).

    Rows whose file is unknown or without a word are left out. Whole files are searched only for the distinct words that don't stand near.
    """
    words = F.regexp_extract_all("match", F.lit(r"[A-Za-z_]\w{3,}"), 0)
    longest = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    rows = evidence.where("file is not null and line is not null and match is not null").select("evidence_id", "repo", posix(F.col("file")).alias("path"), "line", longest.alias("symbol")).where("symbol is not null")
    seen = with_lines(rows, files, window).select("evidence_id", "repo", "path", "symbol", F.coalesce(F.col("near").contains(F.col("symbol")), F.lit(False)).alias("close"))
    sought = seen.where("not close").groupBy("repo", "path").agg(F.collect_set("symbol").alias("sought"))
    text = with_path(files).where("content is not null").groupBy("repo", "path").agg(F.max_by("content", "file_id").alias("content"))
    far = sought.join(text, ["repo", "path"]).select("repo", "path", F.explode(F.filter("sought", lambda w: F.col("content").contains(w))).alias("symbol")).withColumn("far", F.lit(True))
    met = seen.join(far, ["repo", "path", "symbol"], "left")
    return met.select("evidence_id", F.when(F.col("close"), "near").when(F.col("far"), "far").otherwise("absent").alias("verdict"))


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """C20: (left_name, right_name): names of which one is part of the other, letter case aside; both sides (name).

    What is contained is looked up by its rarest run of three characters among the other side's, then checked: an equi-join of
    linear size that misses no pair. Names of fewer than three characters match whole names only; null and empty names nothing.
    """
    a = left.select(F.lower("name").alias("a")).where("a <> ''").distinct()
    b = right.select(F.lower("name").alias("b")).where("b <> ''").distinct()

    def grams(df: DataFrame, c: str) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3)))
        return df.where(F.length(c) > 2).select(c, F.explode(F.array_distinct(runs)).alias("g"))

    def inside(small: DataFrame, s: str, large: DataFrame, t: str) -> DataFrame:
        index = grams(large, t)
        seen = index.groupBy("g").agg(F.count("*").alias("n"))
        probe = grams(small, s).join(seen, "g", "left").groupBy(s).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))["g"].alias("g"))
        return probe.join(index, "g").where(F.col(t).contains(F.col(s))).select("a", "b")

    whole = a.join(b, F.col("a") == F.col("b")).select("a", "b")
    every = inside(a, "a", b, "b").union(inside(b, "b", a, "a")).union(whole).distinct()
    return every.select(F.col("a").alias("left_name"), F.col("b").alias("right_name"))


def file_roles(evidence: DataFrame) -> DataFrame:
    """(repo, path, role, n, first): each file's role, the first bucket in order that it has rows of, its rows and the least id of them."""
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    rows = evidence.where("file is not null").select("repo", posix(F.col("file")).alias("path"), "bucket", order.alias("o"), "evidence_id")
    per = rows.groupBy("repo", "path").agg(F.min(F.when(F.col("o") > 0, F.col("o"))).alias("o"), F.count("*").alias("n"), F.min("evidence_id").alias("first"))
    role = F.coalesce(F.try_element_at(F.array(*map(F.lit, BUCKETS)), F.col("o").cast("int")), F.lit("other"))
    return per.select("repo", "path", role.alias("role"), "n", "first")


def trusted_arm(evidence: DataFrame) -> DataFrame:
    """(repo, scanner, n): the first scanner in order of trust that has rows in a repo; repos with none have no row."""
    order = F.array_position(F.array(*map(F.lit, ARMS)), F.col("scanner"))
    per = evidence.where(order > 0).groupBy("repo", "scanner").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return per.groupBy("repo").agg(F.min(F.struct("o", "scanner", "n")).alias("m")).select("repo", "m.scanner", "m.n")


def with_fallback(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """(repo, path, sha256, source): the stored signature of a file, else one computed from its content; null without either."""
    own = with_path(files).groupBy("repo", "path").agg(F.max_by(F.sha2("content", 256), "file_id").alias("own"))
    known = signatures.groupBy("repo", "path").agg(F.max(F.struct("snapshot_no", "loaded_at", "sha256")).alias("k")).select("repo", "path", F.col("k.sha256").alias("stored"))
    met = own.join(known, ["repo", "path"], "left")
    return met.select("repo", "path", F.coalesce("stored", "own").alias("sha256"), F.when(F.col("stored").isNotNull(), "stored").when(F.col("own").isNotNull(), "computed").otherwise("none").alias("source"))


def slices(tokens: DataFrame, threshold: int) -> DataFrame:
    """(repo, n, total, mean, largest, warnings): token slices of a repo's modules against a threshold; mean is a whole number."""
    rows = tokens.groupBy("repo", F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).agg(F.sum("tokens").alias("t"))
    per = rows.groupBy("repo").agg(F.count("*").alias("n"), F.sum("t").alias("total"), F.floor(F.sum("t") / F.count("*")).alias("mean"), F.max("t").alias("largest"))
    warn = F.array(F.when(F.col("largest") > threshold, F.lit("slice over threshold")), F.when(F.col("largest") > 4 * F.col("mean"), F.lit("lopsided slices")), F.when(F.col("n") == 1, F.lit("single slice")))
    return per.withColumn("warnings", F.array_join(F.filter(warn, lambda x: x.isNotNull()), "; "))


def scaling(before: DataFrame, after: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """(keys, was, now) of what (keys, n) isn't `factor` times what it was."""
    met = before.withColumnRenamed("n", "was").join(after.withColumnRenamed("n", "now"), keys, "full_outer").select(*keys, F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    return met.where(F.col("now") != factor * F.col("was"))


def denied(files: DataFrame, tokens: list[str]) -> DataFrame:
    """(file_id, token, n): how often each file holds each token of a short list, letter case aside; only where it does."""
    low = F.lower("content")
    each = F.array(*[F.struct(F.lit(t).alias("token"), ((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("int").alias("n")) for t in tokens])
    return files.where("content is not null").select("file_id", F.explode(each).alias("e")).where("e.n > 0").select("file_id", "e.token", "e.n")


def claims_hold(claims: DataFrame, files: DataFrame) -> DataFrame:
    """`claims` (claim_id, predicate, repo, path, needle) with ok: path_exists, path_absent, contains, not_contains, unchanged_since
    (needle: a SHA-256) or called_by (needle: a name that is called in the file).

    A claim about a missing file's text doesn't hold; an unknown predicate is null. Each file answers its distinct questions once.
    """
    asked = claims.groupBy("repo", "path").agg(F.collect_set(F.struct("predicate", "needle")).alias("asked"))
    text = with_path(files).groupBy("repo", "path").agg(F.max_by(F.coalesce("content", F.lit("")), "file_id").alias("content"))
    text_of, there = F.col("content"), F.col("content").isNotNull()

    def holds(q: Column) -> Column:
        p, needle = q["predicate"], q["needle"]
        has = F.coalesce(text_of.contains(needle), F.lit(False))
        ok = F.when(p == "path_exists", there).when(p == "path_absent", ~there).when(p == "contains", there & has).when(p == "not_contains", there & ~has)
        ok = ok.when(p == "unchanged_since", there & (F.sha2(text_of, 256) == needle)).when(p == "called_by", there & F.coalesce(text_of.contains(F.concat(needle, F.lit("("))), F.lit(False)))
        return F.struct(p.alias("predicate"), needle.alias("needle"), ok.alias("ok"))

    answers = asked.join(text, ["repo", "path"], "left").select("repo", "path", F.explode(F.transform("asked", holds)).alias("a")).select("repo", "path", "a.*")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}")) for k in ("repo", "path", "predicate", "needle")]
    return claims.alias("c").join(answers.alias("a"), on).select("c.claim_id", "c.predicate", "a.ok")


def token_classes(files: DataFrame) -> DataFrame:
    """(level, n_files, n_classes): Java files by raw hash, by tokens (formatting and comments aside), and by their shape (names and literals aside as well)."""
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    shape = F.regexp_replace(F.regexp_replace(token_key(F.col("content")), "\"[^\"]*\"", "s"), r"(?<![\w$])(?!(?:class|interface|enum|record|extends|implements|return|if|else|for|while|switch|case|try|catch|finally|throw|new|public|private|protected|static|final|void|import|package)(?![\w$]))[A-Za-z0-9_$]+", "n")
    both = F.explode(F.array(F.struct(F.lit("raw").alias("level"), F.sha2("content", 256).alias("h")), F.struct(F.lit("t1").alias("level"), F.sha2(token_key(F.col("content")), 256).alias("h")), F.struct(F.lit("t2").alias("level"), F.sha2(shape, 256).alias("h"))))
    return java.select(both.alias("e")).groupBy("e.level").agg(F.count("*").alias("n_files"), F.count_distinct("e.h").alias("n_classes"))


def supertypes(files: DataFrame) -> DataFrame:
    """(repo, file, sub, super): types named after extends and implements in the head of each Java file's first type, generics left out."""
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    head = F.regexp_extract("content", r"(?m)^(?:public |final |abstract |sealed )*(?:class|interface|record|enum)\s+[^{]*", 0)
    flat = head
    for _ in range(4):
        flat = F.regexp_replace(flat, r"<[^<>]*>", "")
    sub = F.regexp_extract(flat, r"(?:class|interface|record|enum)\s+(\w+)", 1)
    named = F.regexp_replace(F.regexp_extract(flat, r"\b(?:extends|implements)\b([\s\S]*)", 1), r"\b(extends|implements|permits)\b", ",")
    supers = F.filter(F.transform(F.split(named, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(r"^[\w.]+$"))
    return java.select("repo", F.col("path").alias("file"), sub.alias("sub"), F.explode(supers).alias("super")).where("sub <> ''")


def blank_comments(text: Column) -> Column:
    """A text of the same length with block comments and // comments (not after a colon) as spaces; line ends and strings stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|/\*.*?\*/|(?<!:)//[^\n]*|.)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("/*") | (p.startswith("//") & (F.length(p) > 1)), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def maven(files: DataFrame) -> DataFrame:
    """(file_id, kind, group, name, version, scope) of plugins and dependencies in pom.xml; default group of plugins, default scope compile."""
    poms = with_path(files).where((F.col("base") == "pom.xml") & F.col("content").isNotNull()).select("file_id", F.regexp_replace("content", r"(?s)<!--.*?-->", "").alias("x"))
    rows = poms.select("file_id", F.explode(F.array_union(F.regexp_extract_all("x", F.lit(r"(?s)(<dependency>.*?</dependency>)"), 1), F.regexp_extract_all("x", F.lit(r"(?s)(<plugin>.*?</plugin>)"), 1))).alias("b"))
    part = lambda t: F.nullif(F.trim(F.regexp_extract("b", rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    plugin = F.col("b").startswith("<plugin>")
    return rows.select("file_id", F.when(plugin, "plugin").otherwise("dependency").alias("kind"), F.coalesce(part("groupId"), F.when(plugin, "org.apache.maven.plugins")).alias("group"), part("artifactId").alias("name"), part("version").alias("version"), F.when(~plugin, F.coalesce(part("scope"), F.lit("compile"))).alias("scope"))


def version_catalog(files: DataFrame) -> DataFrame:
    """(file_id, kind, key, value) of libs.versions.toml: versions, and libraries by module or by group and name."""
    rows = with_path(files).where((F.col("base") == "libs.versions.toml") & F.col("content").isNotNull())
    lines = rows.select("file_id", F.explode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("l"))
    key = F.regexp_extract("l", r"^\s*([\w.-]+)\s*=", 1)
    module = F.nullif(F.regexp_extract("l", r'\bmodule\s*=\s*"([^"]+)"', 1), F.lit(""))
    pair = F.when(F.col("l").rlike(r'\bgroup\s*=\s*"[^"]+"') & F.col("l").rlike(r'\bname\s*=\s*"[^"]+"'), F.concat_ws(":", F.regexp_extract("l", r'\bgroup\s*=\s*"([^"]+)"', 1), F.regexp_extract("l", r'\bname\s*=\s*"([^"]+)"', 1)))
    version = F.nullif(F.regexp_extract("l", r'^\s*[\w.-]+\s*=\s*"([^"]+)"\s*(?:#.*)?$', 1), F.lit(""))
    value = F.coalesce(module, pair, version)
    return lines.where(value.isNotNull() & (key != "")).select("file_id", F.when(F.coalesce(module, pair).isNotNull(), "library").otherwise("version").alias("kind"), key.alias("key"), value.alias("value"))


def python_metrics(files: DataFrame) -> DataFrame:
    """(file_id, n_functions, n_statements, deepest, most_branches, annotated) of Python files that parse; others have no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, text in pdf.itertuples(index=False, name=None):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                branches = [1 + sum(isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp)) for x in ast.walk(f)) for f in functions]
                args = [a for f in functions for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs)]
                depth, level = 0, [(n, 1) for n in tree.body]
                while level:
                    n, d = level.pop()
                    depth = max(depth, d)
                    level += [(x, d + 1) for f in ("body", "orelse", "finalbody") for x in (getattr(n, f, None) or []) if isinstance(x, ast.stmt)]
                rows.append((i, len(functions), sum(isinstance(n, ast.stmt) for n in ast.walk(tree)), depth, max(branches, default=0), sum(a.annotation is not None for a in args) / len(args) if args else None))
            yield pd.DataFrame(rows, columns=["file_id", "n_functions", "n_statements", "deepest", "most_branches", "annotated"])

    rows = with_path(files).where((F.lower("suffix") == ".py") & F.col("content").isNotNull()).select("file_id", "content")
    return rows.mapInPandas(run, "file_id bigint, n_functions int, n_statements int, deepest int, most_branches int, annotated double")
