"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vernalex.plans.lineage import cut


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_deliveries(df: DataFrame, key: str, *cols: str | Column, order: str = "loaded_at") -> DataFrame:
    """One row per key, the first delivered; rows without a key are left out.

    Few rows are delivered twice, so only keys and times are shuffled to find
    them; their list is written and read back, so that the planner sees its
    size and broadcasts it if it is small. Only the repeated rows themselves are grouped. A missing
    time counts as the last; of rows of the same time one is kept.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in cols]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), *named, F.col(order).alias("_at"))
    again = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    once = rows.join(again, key, "left_anti").drop("_at")
    late = F.coalesce("_at", F.lit("9999-12-31").cast("timestamp"))
    content = [c for c in rows.columns if c not in (key, "_at")]
    first = rows.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*content), late).alias("_row")) if content else rows.join(again, key, "left_semi").select(key).distinct()
    return once.unionByName(first.select(key, "_row.*") if content else first)
