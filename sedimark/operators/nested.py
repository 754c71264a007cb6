"""Nested JSON as flat tables: Dewey labels, parent links by truncation, one table for each schema path.

Every value of a payload has a label: its ordinals among its siblings from the root down. Steps that reach a row (an object in
an array, a value of entity_table_map) are marked, so a row's parent is the row whose label is its own cut after the last mark
but one. Rows of the same schema path, ordinals left out, form a table; tables are joined by labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions import json_text
from sedimark.session import spread, staged

KEYED = "entity_table_map"
BUCKETED = "evidence"


def _nodes(doc) -> list[tuple[str, str, str, dict]]:
    """(label, path, schema path, object) of every row, in document order."""
    out: list[tuple[str, str, str, dict]] = []
    # label, path, schema path, value, whether it is a row, key it stands under
    todo: list[tuple[str, str, str, object, bool, str]] = [("", "", "", doc, False, "")]
    while todo:
        label, path, schema, value, row, key = todo.pop()
        if row and isinstance(value, dict):
            out.append((label, path, schema, value))
        below: list[tuple[str, str, str, object, bool, str]] = []
        if isinstance(value, list):
            for i, x in enumerate(value):
                mark = "#" if isinstance(x, dict) else ""
                below.append((f"{label}.{mark}{i}", f"{path}[{i}]", f"{schema}[]", x, True, ""))
        elif isinstance(value, dict):
            for i, (k, x) in enumerate(value.items()):
                at, over = f"{path}.{k}" if path else k, f"{schema}.{k}" if schema else k
                if isinstance(x, dict) and path == BUCKETED and key == BUCKETED:
                    below.append((f"{label}.{i}.#0", f"{at}[0]", f"{over}[]", x, True, k))
                elif isinstance(x, dict) and key == KEYED and not row:
                    below.append((f"{label}.#{i}", at, f"{schema}.*", x, True, k))
                else:
                    below.append((f"{label}.{i}", at, over, x, False, k))
        todo.extend(reversed(below))
    return out


def truncated(label: str) -> str:
    """The label of the nearest enclosing row: cut after the last marked step but one; empty at the top."""
    mark = label.rfind("#", 0, label.rfind("#"))
    return label[: label.index(".", mark)] if mark >= 0 else ""


def nodes(artifacts: DataFrame, fields: bool = True) -> DataFrame:
    """(artifact_id, label, node_path, parent_label, parent_path, schema_path, fields MAP<STRING, STRING>): every row of every payload.

    The parent is looked up by the truncated label. `fields` (null unless asked for) has the row's own scalars as text and its
    other members as JSON; JSON nulls are null. Unreadable and null payloads have no rows, nor do null elements, which still count
    as places. Payloads are walked without recursion.
    """
    cols = ["artifact_id", "label", "node_path", "parent_label", "parent_path", "schema_path", "fields"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for a, payload in pdf.itertuples(index=False, name=None):
                paths = {"": ""}  # rows come before the rows inside them
                for label, path, schema, obj in _nodes(json_text.read(payload)):
                    held = {k: v if isinstance(v, str) else None if v is None else json_text.canonical(v) for k, v in obj.items()} if fields else None
                    paths[label] = path
                    above = truncated(label)
                    rows.append((a, label, path, above, paths[above], schema, held))
            yield pd.DataFrame(rows, columns=cols)

    rows = artifacts.where("artifact_id is not null").select(F.col("artifact_id").cast("long").alias("artifact_id"), "payload")
    return spread(rows).mapInPandas(run, "artifact_id bigint, label string, node_path string, parent_label string, parent_path string, schema_path string, fields map<string,string>")


def flat_table(rows: DataFrame, schema_path: str, columns: dict[str, str]) -> DataFrame:
    """The table of one schema path (a pattern, % for any bucket): keys of the row and of its parent, and typed columns."""
    got = rows.where(F.col("schema_path").like(schema_path))
    typed = [F.col("fields")[c].try_cast(t).alias(c) for c, t in columns.items()]
    return got.select("artifact_id", "node_path", "parent_path", "schema_path", *typed)


def tables(rows: DataFrame) -> DataFrame:
    """The rows stored in the shared folder as one table for each schema path (a partition), by artifact and label.

    A payload's schema paths come from its keys, so there are as many tables as the producers' schemas have places for objects.
    """
    return staged(rows, partition_by=["schema_path"])


def table_counts(rows: DataFrame) -> DataFrame:
    """(schema_path, n_rows, n_artifacts, n_orphans): the tables, children joined to parents by label; an orphan's parent is no row
    (there are none)."""
    parents = rows.select("artifact_id", F.col("label").alias("parent_label")).distinct().withColumn("there", F.lit(True))
    joined = rows.select("schema_path", "artifact_id", "parent_label").join(parents, ["artifact_id", "parent_label"], "left")
    return joined.groupBy("schema_path").agg(
        F.count("*").alias("n_rows"), F.countDistinct("artifact_id").alias("n_artifacts"), F.count(F.when((F.col("parent_label") != "") & F.col("there").isNull(), 1)).alias("n_orphans")
    )


def columns(rows: DataFrame) -> DataFrame:
    """(schema_path, name, n_rows, n_null, n_integers, longest): the columns of each table."""
    each = rows.select("schema_path", F.explode("fields").alias("name", "v"))
    return each.groupBy("schema_path", "name").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count("v").alias("n_values"), F.count(F.col("v").try_cast("bigint")).alias("n_integers"), F.max(F.length("v")).alias("longest")
    )
