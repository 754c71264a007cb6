"""Queries of the general training-data problems (2, 6 and 7) and their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import nested, schema_drift, snapshots
from sedimark.session import table

SNAPSHOT_TABLES = {"file_signatures": (["path"], ["sha256"]), "cite_snapshots": (["cite_id"], ["rule_id", "match"])}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Changed records of both snapshot tables, whose deliveries are taken side by side."""

    def one(name: str) -> DataFrame:
        key, values = SNAPSHOT_TABLES[name]
        found = snapshots.changes(table(spark, d, name), ["repo"], key, values)
        return found.select(F.lit(name).alias("tbl"), "snapshot_no", "repo", F.col(key[0]).alias("rec_key"), "change_kind")

    with ThreadPoolExecutor(len(SNAPSHOT_TABLES)) as pool:
        a, b = pool.map(one, SNAPSHOT_TABLES)
    return a.unionByName(b)


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changed citations with their values before and after."""
    df = table(spark, d, "cite_snapshots")
    key, values = SNAPSHOT_TABLES["cite_snapshots"]
    got = snapshots.with_values(snapshots.changes(df, ["repo"], key, values), df, ["repo"], key, values)
    return got.select("snapshot_no", "repo", "cite_id", "change_kind", F.col("old.rule_id").alias("old_rule_id"), F.col("new.rule_id").alias("new_rule_id"),
                      F.col("old.match").alias("old_match"), F.col("new.match").alias("new_match"))


def _p6_sql(name: str, key: str, values: list[str]) -> str:
    cols = ", ".join(values)
    moved = " or ".join(f"a.{v} is distinct from b.{v}" for v in values)
    return f"""
    (with last as (select snapshot_no, repo, {key} as rec_key, {cols} from {name} where snapshot_no is not null
       qualify row_number() over (partition by snapshot_no, repo, {key} order by loaded_at desc nulls last) = 1),
     steps as (select repo, snapshot_no, lag(snapshot_no) over (partition by repo order by snapshot_no) as prv from (select distinct repo, snapshot_no from last)),
     old as (select s.snapshot_no, l.repo, l.rec_key, {', '.join('l.' + v for v in values)} from last l join steps s on l.repo is not distinct from s.repo and l.snapshot_no = s.prv),
     cur as (select l.* from last l join steps s on l.repo is not distinct from s.repo and l.snapshot_no = s.snapshot_no where s.prv is not null)
    select '{name}' as tbl, coalesce(a.snapshot_no, b.snapshot_no) as snapshot_no, coalesce(a.repo, b.repo) as repo, coalesce(a.rec_key, b.rec_key) as rec_key,
      case when a.snapshot_no is null then 'removed' when b.snapshot_no is null then 'added' else 'changed' end as change_kind,
      {', '.join(f'b.{v} as old_{v}, a.{v} as new_{v}' for v in values)}
    from cur a full outer join old b on a.snapshot_no = b.snapshot_no and a.repo is not distinct from b.repo and a.rec_key is not distinct from b.rec_key
    where a.snapshot_no is null or b.snapshot_no is null or {moved})"""


_FILES, _CITES = _p6_sql("file_signatures", "path", ["sha256"]), _p6_sql("cite_snapshots", "cite_id", ["rule_id", "match"])

def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Schema changes from file to file."""
    return schema_drift.drift(table(spark, d, "artifacts")).select("artifact_id", "field_path", "change_kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Schema changes by path, kind and types, over all streams."""
    got = schema_drift.drift(table(spark, d, "artifacts"))
    return got.groupBy("field_path", "change_kind", "old_path", "old_type", "new_type").agg(F.count("*").alias("n_files"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable files in one table of typed columns."""
    return schema_drift.consistent_table(table(spark, d, "artifacts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the nested payloads with its parent."""
    return nested.nodes(table(spark, d, "artifacts"), fields=False).select("artifact_id", "node_path", "parent_path")


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables, stored one for each schema path, with their numbers of rows."""
    return nested.table_counts(nested.tables(nested.nodes(table(spark, d, "artifacts"))))


def p7_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the flat tables."""
    return nested.columns(nested.nodes(table(spark, d, "artifacts")))


def p7_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of evidence rows."""
    cols = {"file": "string", "line": "int", "match": "string", "rule_id": "string"}
    return nested.flat_table(nested.nodes(table(spark, d, "artifacts")), "evidence.%[]", cols).where("not contains(substring(schema_path, 10), '[].')")


QUERIES = {
    "p2_found": p2_found, "p2_report": p2_report, "p2_table": p2_table, "p7_found": p7_found, "p7_tables": p7_tables, "p7_columns": p7_columns, "p7_evidence": p7_evidence,
    "p6_found": p6_found, "p6_changes": p6_changes,
}
SQL = {
    "p6_found": f"select tbl, snapshot_no, repo, rec_key, change_kind from {_FILES} union all select tbl, snapshot_no, repo, rec_key, change_kind from {_CITES}",
    "p6_changes": f"select snapshot_no, repo, rec_key as cite_id, change_kind, old_rule_id, new_rule_id, old_match, new_match from {_CITES}",
}
