"""Distributed running totals: prefix sums and running minima over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import stage


def running(df: DataFrame, group: list[str], order: list[Column], value: str, out: str, how: str = "sum") -> DataFrame:
    """Add ``out``: the inclusive running ``sum`` or ``min`` of ``value`` in each group, in the given order.

    Rows are range-sorted by group and order, so a hot group spans many tasks; each task makes its own running values,
    and what came before a task is added from a table of one row per group and task. The order should be total; rows
    equal in it come in any order. Null values count as nothing.
    """
    fold = {"sum": F.sum, "min": F.min}[how]
    cols = df.columns
    ranged = stage(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*group, "_part").agg(fold(value).alias("_fold"))
    before = parts.select(*group, "_part", fold("_fold").over(earlier).alias("_before"))
    both = ranged.withColumn("_own", fold(value).over(inside)).join(before, [*group, "_part"])
    if how == "min":
        return both.select(*cols, F.least("_own", "_before").alias(out))
    return both.select(*cols, (F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias(out))


def row_numbers(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place of each row in its group from 1 on, by :func:`running`, so a hot group is numbered by many tasks."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", out).drop("_one")
