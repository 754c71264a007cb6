"""Routes of code against operations of an interface specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import normal_route

#: The verbs that a mapping without one stands for.
VERBS = ("GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE")


def code_routes(evidence: DataFrame) -> DataFrame:
    """(repo, verb, path): distinct endpoints of mapping rows; a mapping without a verb stands for all."""
    pattern = r"^\s*@?(Get|Post|Put|Patch|Delete|Request)Mapping\s*\("
    rows = evidence.where(F.col("match").rlike(pattern))
    word = F.upper(F.regexp_extract("match", pattern, 1))
    path = F.regexp_extract("match", r'(?:path|value)?\s*[=:]?\s*"([^"]*)"', 1)
    verbs = F.when(word == "REQUEST", F.array(*map(F.lit, VERBS))).otherwise(F.array(word))
    return rows.where(path != "").select("repo", F.explode(verbs).alias("verb"), normal_route(path).alias("path")).distinct()


def join_routes(code: DataFrame, spec: DataFrame) -> DataFrame:
    """C14: (repo, verb, path, verdict): matched, code-only or spec-only; verbs are compared in capitals."""
    a = code.select("repo", F.upper("verb").alias("verb"), "path").distinct().withColumn("a", F.lit(1))
    b = spec.select("repo", F.upper("verb").alias("verb"), normal_route(F.col("path")).alias("path")).distinct().withColumn("b", F.lit(1))
    verdict = F.when(F.col("b").isNull(), "code-only").when(F.col("a").isNull(), "spec-only").otherwise("matched")
    return a.join(b, ["repo", "verb", "path"], "full_outer").select("repo", "verb", "path", verdict.alias("verdict"))
