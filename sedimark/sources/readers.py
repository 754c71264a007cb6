"""Readers and writers: source trees, JSON and JSON lines, CSV, interface specifications, fact ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.session import shared_dir  # noqa: F401  (re-exported for callers that place artifacts)


def source_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """A1: (repo, rel_path, full_path, name, ext, content, sha256) of every file below a folder; content is null where it isn't UTF-8."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "content")
    full = F.regexp_replace("path", "^file:/+", "/")
    rel = F.substring(full, len(base) + 2, 1 << 20)
    name = F.element_at(F.split(rel, "/"), -1)
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "utf-8"))
    return rows.select(F.lit(repo).alias("repo"), rel.alias("rel_path"), full.alias("full_path"), name.alias("name"), F.regexp_extract(name, r"^.+(\.[^.]*)$", 1).alias("ext"), text.alias("content"), F.sha2("content", 256).alias("sha256"))


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents or JSON lines by an explicit schema; a malformed one fails the read."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def counts_csv(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, n) of a CSV with a header; a leading byte order mark is dropped, a count that is no number is null."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    first, second = rows.columns[:2]
    return rows.select(F.col(f"`{first}`").alias("rule_id"), F.col(f"`{second}`").try_cast("bigint").alias("n"))


def openapi_operations(docs: DataFrame) -> DataFrame:
    """(name, verb, path) of interface specifications in YAML text (name, text): each verb under the last path key above it.

    The path is carried down the lines of one text by a fold, so a text stays in its row.
    """
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    start = F.struct(F.lit("").alias("path"), F.expr("cast(array() as array<struct<verb:string,path:string>>)").alias("ops"))

    def step(s, x):
        route = F.regexp_extract(x, r"^\s{2,4}[\"']?(/[^\"':]*(?::[^\"':\s]+)*)[\"']?\s*:\s*$", 1)
        verb = F.upper(F.regexp_extract(x, r"^\s{4,8}(get|put|post|delete|options|head|patch|trace)\s*:\s*$", 1))
        found = (verb != "") & (s["path"] != "")
        return F.struct(F.when(route != "", route).otherwise(s["path"]).alias("path"), F.when(found, F.concat(s["ops"], F.array(F.struct(verb.alias("verb"), s["path"].alias("path"))))).otherwise(s["ops"]).alias("ops"))

    ops = F.explode(F.aggregate(lines, start, step, lambda s: s["ops"]))
    return docs.where("text is not null").select("name", ops.alias("o")).select("name", "o.verb", "o.path").distinct()


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as JSON lines, checked while they are written: a subject is required and a line is at least 1."""
    ok = F.col("subject").isNotNull() & (F.col("line").isNull() | (F.col("line") >= 1))
    facts.withColumn("predicate", F.when(ok, F.col("predicate")).otherwise(F.raise_error(F.lit("illegal fact")))).write.mode("overwrite").json(path)
