"""Occurrence-aware overrides: the nth correction of a key meets the nth entry of that key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_occurrences(df: DataFrame, key: list[str], order: list[str], into: str = "occurrence", first: int = 1) -> DataFrame:
    """Number the rows of each key in ``order``. Keys hold a page, so no group outgrows one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(into, F.row_number().over(w) - 1 + first)


def override(entries: DataFrame, corrections: DataFrame, key: list[str], cid: str) -> tuple[DataFrame, DataFrame]:
    """(entries left-joined to their correction, stale corrections).

    Both sides carry the key columns with the occurrence. Of several corrections of one occurrence
    the highest id wins; the others and those without an entry are stale, so every correction is applied or stale once.
    """
    best = corrections.groupBy(*key).agg(F.max(cid).alias(cid))
    live = corrections.join(best, [*key, cid], "left_semi")
    applied = entries.join(live, key, "left")
    stale = corrections.join(entries.select(*key).distinct().join(best, key).select(cid), cid, "left_anti")
    return applied, stale


def effective_confidence(corrected: Column, confidence: Column) -> Column:
    """A corrected reading counts as certain."""
    return F.when(corrected, F.lit(100)).otherwise(confidence)
