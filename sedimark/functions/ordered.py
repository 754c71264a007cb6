"""Ordered per-group functions that split a hot group: windows over (group, bucket), joined by one small window over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.session import staged


def ordered_index(df: DataFrame, group: list[str], order: list[str], bucket: Column, to: str = "seq") -> DataFrame:
    """`df` with the 0-based place `to` of each row in its group by `order`.

    `bucket` must rise with `order`. Rows of a group are numbered bucket by bucket in as many tasks as it has buckets; only a
    count for each bucket is ordered over the whole group. Nulls are groups and buckets like any other.
    """
    rows = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
    numbered = rows.withColumn("_rn", F.row_number().over(inner) - 1).alias("r")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*group, "_b"]]
    return numbered.join(counts.alias("c"), on).select(*[F.col(f"r.{c}") for c in df.columns], (F.col("c._off") + F.col("r._rn")).alias(to))


def carry_last(df: DataFrame, group: list[str], order: str, value: str, to: str, bucket_rows: int = 10_000) -> DataFrame:
    """`df` with `to`: the last non-null `value` before each row in its group by the integer column `order`; null if none."""
    rows = df.withColumn("_b", F.floor(F.col(order) / bucket_rows))
    inner = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*group, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(outer))
    local = rows.withColumn("_local", F.last(value, ignorenulls=True).over(inner)).alias("r")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*group, "_b"]]
    return local.join(ends.alias("e"), on).select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce(F.col("r._local"), F.col("e._carry")).alias(to))


def range_index(df: DataFrame, group: list[str], order: list[str], to: str = "seq") -> DataFrame:
    """As `ordered_index`, with ranges of even size in place of buckets: rows are sorted by group and order over all partitions, each
    partition numbers its rows, and the rows of a group in the partitions before are added, one count a partition and group.

    `order` must tell rows of a group apart, so that no range is larger than its share.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    rows = staged(df.repartitionByRange(n, *group, *order).withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy(*group, "_p").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "_p").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
    numbered = rows.withColumn("_rn", F.row_number().over(inner) - 1).alias("r")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*group, "_p"]]
    return numbered.join(counts.alias("c"), on).select(*[F.col(f"r.{c}") for c in df.columns], (F.col("c._off") + F.col("r._rn")).alias(to))
