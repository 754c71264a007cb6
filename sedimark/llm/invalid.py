"""Source files that do not parse, per file and as rates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.syntax import check
from sedimark.session import spread

#: Extensions with a checker, and the checker's language.
CHECKED = {".java": "java", ".py": "py", ".js": "js", ".json": "json", ".xml": "xml", ".yml": "yml"}


def extension(path: str = "rel_path") -> Column:
    """The extension that a path ends in, lower case with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"(\.[^./\\]+)$", 1))


def checked(files: DataFrame) -> DataFrame:
    """(file_id, reason, line_no): every file of a checked extension with text; reason and line are null for valid ones.

    The language is that of rel_path's extension, whatever the column ext says. Null, empty and blank contents and other
    extensions give no row. A file delivered twice gives two. Texts are read whole.
    """
    rows = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), extension().alias("x"), "content")
    rows = rows.where(F.col("x").isin(*CHECKED) & (F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s﻿]+", "") != ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check(CHECKED[x], text) for x, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.int32())], ["file_id", "reason", "line_no"]
            )

    return spread(rows).mapInArrow(run, "file_id bigint, reason string, line_no int")


def found(files: DataFrame) -> DataFrame:
    """(file_id): files whose content is not valid for their extension."""
    return checked(files).where("reason is not null").select("file_id")


def rates(files: DataFrame, languages: DataFrame) -> DataFrame:
    """(repo, code_language, n_files, n_checked, n_invalid, share): per repo and language of the extension.

    n_files counts all rows, n_checked those with text and a checker; share is null where none was checked. Extensions that the
    table of languages lacks have a null language, null repos are a group of their own.
    """
    got = checked(files)
    names = languages.select(F.lower("ext").alias("x"), "code_language").dropDuplicates(["x"])
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", extension().alias("x")).join(got, "file_id", "left").join(names, "x", "left")
    seen = rows.join(got.select("file_id", F.lit(1).alias("c")), "file_id", "left")
    return (
        seen.groupBy("repo", "code_language")
        .agg(F.count("*").alias("n_files"), F.count("c").alias("n_checked"), F.count("reason").alias("n_invalid"))
        .withColumn("share", F.try_divide("n_invalid", "n_checked"))
    )


def against_skipped(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """(verdict, n): files found here against those an earlier run skipped for a syntax reason, paths in either system's style."""
    path = lambda c: F.regexp_replace(F.col(c), r"\\", "/")
    mine = files.join(found(files), "file_id", "left_semi").select("repo", path("rel_path").alias("file")).distinct().withColumn("a", F.lit(1))
    theirs = skipped.where(F.lower("reason").rlike("syntax|parse|unbalanced|unterminated|conflict")).select("repo", path("file").alias("file")).distinct().withColumn("b", F.lit(1))
    both = mine.join(theirs, ["repo", "file"], "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "missed").when(F.col("a").isNull(), "wrong").otherwise("agreed").alias("verdict")).agg(F.count("*").alias("n"))
