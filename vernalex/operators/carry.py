"""Ordered, stateful operators: carry-down, block ids, spans, occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_down(df: DataFrame, value: str, order: str, group: list[str], chunk: str, into: str) -> DataFrame:
    """``into``: the last non-null ``value`` at or before each row of its group.

    Two levels, so that a group of any size is never one task: rows are only
    ordered within a chunk (say a page), and one summary row per chunk is
    ordered within the group. ``chunk`` must not decrease along ``order``.
    Before the first value the result is null.
    """
    inner = Window.partitionBy(*group, chunk).orderBy(order)
    outer = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        df.groupBy(*group, chunk)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
        .withColumn("_before", F.last("_last", ignorenulls=True).over(outer))
        .drop("_last")
    )
    on = [*group, chunk]
    joined = df.join(ends, on, "left")
    return joined.withColumn(into, F.coalesce(F.last(value, ignorenulls=True).over(inner), "_before")).drop("_before")
