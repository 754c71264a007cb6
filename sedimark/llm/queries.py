"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.llm import format_dups, invalid, packing, provenance, reading, secrets, tokens
from sedimark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not valid for their extension."""
    return invalid.found(table(spark, d, "files"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of invalid files by repo and language."""
    return invalid.rates(table(spark, d, "files"), table(spark, d, "ext_languages"))


def p1_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Agreement with the files that an earlier run skipped."""
    return invalid.against_skipped(table(spark, d, "files"), table(spark, d, "skipped_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that weren't written by hand for their repo."""
    return provenance.sorted_out(table(spark, d, "files")).select("file_id")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each such file, and what told it."""
    return provenance.sorted_out(table(spark, d, "files"))


def p3_repos(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repo by kind."""
    return provenance.by_repo(table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of evidence that repeat a record in other formatting."""
    return format_dups.copies(table(spark, d, "evidence"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, with its number of copies."""
    return format_dups.records(table(spark, d, "evidence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files and evidence with an embedded credential."""
    return secrets.find(table(spark, d, "files"), table(spark, d, "evidence"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold credentials, with every one hidden."""
    return secrets.redacted(table(spark, d, "files"), table(spark, d, "evidence"))


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """Lines found against the zones of an earlier scan, by repo."""
    return secrets.coverage(p5_found(spark, d), table(spark, d, "redaction_zones"), table(spark, d, "files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tokens by language tag."""
    return tokens.token_summary(table(spark, d, "documents"))


def p9_placements(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document (or piece of one) for each capacity."""
    return packing.pack_corpus(tokens.token_counts(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.pack_report(tokens.token_counts(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The estimated reading level of every document."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "doc_levels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Prose of reading level 4 or 5."""
    return reading.hard(p10_levels(spark, d))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by kind and level."""
    return reading.profile(p10_levels(spark, d), table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p1_skipped": p1_skipped,
    "p3_found": p3_found,
    "p3_kinds": p3_kinds,
    "p3_repos": p3_repos,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p5_zones": p5_zones,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_placements": p9_placements,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
}

SQL: dict[str, str] = {}
