"""Entities, repositories and queries in Java source; maps from several sources with contested entries; SQL lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import bind_params, fqcn, java_package, posix, snake_case, type_symbol
from sedimark.operators.inventory import with_path

CLASS_NAME = r"\bclass\s+(\w+)"


def entities(files: DataFrame) -> DataFrame:
    """(file_id, repo, file, class_name, table, table_name_source, package, fqcn, symbol) of classes marked as entities or tables.

    An @Table name is explicit; without one the class name in snake case is inferred. A missing package stays null.
    """
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").rlike(r"(?m)^\s*@(Entity|Table)\b"))
    text = F.col("content")
    name, explicit = F.regexp_extract(text, CLASS_NAME, 1), F.regexp_extract(F.regexp_extract(text, r"@Table\s*\(([^)]*)\)", 1), r'name\s*=\s*"([^"]+)"', 1)
    package = F.nullif(java_package(text), F.lit(""))
    rows = java.select("file_id", "repo", F.col("path").alias("file"), name.alias("class_name"), explicit.alias("explicit"), package.alias("package")).where("class_name <> ''")
    return rows.select(
        "file_id", "repo", "file", "class_name", F.when(F.col("explicit") != "", F.col("explicit")).otherwise(snake_case(F.col("class_name"))).alias("table"),
        F.when(F.col("explicit") != "", "explicit").otherwise("inferred-default-naming").alias("table_name_source"), "package",
        fqcn(F.col("package"), F.col("class_name")).alias("fqcn"), type_symbol(F.col("package"), F.col("class_name")).alias("symbol"),
    )


def entity_map(found: DataFrame) -> DataFrame:
    """(repo, class_name, file, table, status, n_candidates): one entry for each class; the smallest file's row counts.

    A class with different tables or files is contested.
    """
    per = found.groupBy("repo", "class_name").agg(
        F.min(F.struct("file", "table")).alias("first"), F.count_distinct("file", "table").alias("n_candidates"), F.count_distinct("file").alias("n_files")
    )
    return per.select("repo", "class_name", F.col("first.file").alias("file"), F.col("first.table").alias("table"), F.when(F.col("n_candidates") > 1, "contested").otherwise("single").alias("status"), "n_candidates")


def annotated_queries(files: DataFrame) -> DataFrame:
    """(file_id, repo, nth, query_kind, query) of @Query annotations on one line: native if nativeQuery is true, text of the first literal."""
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").contains("@Query("))
    found = F.regexp_extract_all("content", F.lit(r"@Query\(([^\n]*)\)"), 1)
    rows = java.select("file_id", "repo", F.posexplode(found).alias("nth", "args"))
    return rows.select("file_id", "repo", "nth", F.when(F.col("args").rlike(r"nativeQuery\s*=\s*true"), "native").otherwise("jpql").alias("query_kind"), F.nullif(F.regexp_extract("args", r'"([^"]*)"', 1), F.lit("")).alias("query"))


def evidence_queries(evidence: DataFrame) -> DataFrame:
    """B17 over evidence rows: (evidence_id, repo, query_kind, query) of rows that hold an @Query annotation, whatever its layout."""
    rows = evidence.where(F.col("match").rlike(r"(?i)^\s*@?Query\s*\("))
    return rows.select("evidence_id", "repo", F.when(F.col("match").rlike(r"(?i)nativeQuery\s*[=:]\s*true"), "native").otherwise("jpql").alias("query_kind"), F.nullif(F.regexp_extract("match", r'"([^"]*)"', 1), F.lit("")).alias("query"))


def jpql_refusal(query: Column) -> Column:
    """H7: why a query in the entity language is not rewritten, in the order of the checks; null if it can be."""
    scope = "multi-entity or unparseable FROM clause"
    alias = F.regexp_extract(query, r"(?i)\bFROM\s+\w+\s+(?:AS\s+)?(\w+)\b", 1)
    return (
        F.when(query.rlike(r"(?i)\bJOIN\b"), scope)
        .when(F.regexp_count(query, F.lit(r"(?i)\bFROM\s+\w+\s+(AS\s+)?\w+\b")) != 1, scope)
        .when(query.rlike(r"(?i)\b(SIZE|KEY|VALUE|INDEX|TYPE)\s*\("), "relationship function")
        .when(query.rlike(r"(?i)\bFROM\s+\w+\s+(AS\s+)?\w+\s*,"), scope)
        .when(F.expr("rlike(query, concat('\\\\b', regexp_extract(query, '(?i)\\\\bFROM\\\\s+\\\\w+\\\\s+(?:AS\\\\s+)?(\\\\w+)\\\\b', 1), '\\\\.\\\\w+\\\\.\\\\w+'))") & (alias != ""), "association path")
    )


def jpql_lineage(queries: DataFrame, entity_tables: DataFrame) -> DataFrame:
    """`queries` (repo, query, ...) with entity, table and reason: the table an entity query reads, or why that is left open."""
    entity = F.regexp_extract("query", r"(?i)\bFROM\s+(\w+)\s+(?:AS\s+)?\w+\b", 1)
    rows = queries.where("query is not null").withColumn("refused", jpql_refusal(F.col("query"))).withColumn("entity", F.when(F.col("refused").isNull(), entity))
    known = entity_tables.select("repo", F.col("class_name").alias("entity"), "table", "status")
    met = rows.join(known, ["repo", "entity"], "left")
    reason = F.coalesce("refused", F.when(F.col("status").isNull(), "unknown entity").when(F.col("status") == "contested", "contested entity"))
    return met.select(*[c for c in queries.columns], "entity", F.when(reason.isNull(), F.col("table")).alias("source_table"), reason.alias("reason"))


def sql_lineage(spark, statements: list[str]) -> list[dict]:
    """H6: source and target tables of SQL statements by Spark's own parser; available is False where it can't parse.

    For the distinct statements of a bounded report: parsing happens on the driver.
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    out = []
    for text in statements:
        try:
            import re

            plan = parser.parsePlan(re.sub(r"\?\d*", "1", re.sub(r"(?<![\w'\":]):(\w+)", "1", text)))
            shown = plan.toString()
            seen = sorted({m for m in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", shown)})
            names = [s.replace(", ", ".") for s in seen]
            target = names if re.match(r"\s*(insert|update|delete|merge)\b", text, re.I) else []
            head = re.match(r"\s*(?:insert\s+(?:into|overwrite)(?:\s+table)?|update|delete\s+from|merge\s+into)\s+([\w.`]+)", text, re.I)
            target = [head[1]] if head else target
            out.append({"available": True, "source_tables": [n for n in names if n not in target], "target_tables": target})
        except Exception as e:  # a parse error of the JVM
            out.append({"available": False, "reason": type(e).__name__})
    return out


def read_tables(queries: DataFrame) -> DataFrame:
    """H6 in columns: (id columns, tables): names after FROM and JOIN in native queries, parameters bound first, sorted and distinct."""
    bound = bind_params(F.col("query"))
    names = F.regexp_extract_all(bound, F.lit(r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)"), 1)
    return queries.where("query_kind = 'native' and query is not null").withColumn("tables", F.array_sort(F.array_distinct(names)))


def class_of(path: Column) -> Column:
    """The type a Java file is named after."""
    return F.regexp_extract(posix(path), r"([^/]+)\.java$", 1)
