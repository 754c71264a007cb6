"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.plans import checks, measures, problems, reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**problems.QUERIES, **reference.QUERIES, **checks.QUERIES, **measures.QUERIES}
SQL: dict[str, str] = {**problems.SQL, **reference.SQL, **checks.SQL, **measures.SQL}
