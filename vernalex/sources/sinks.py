"""Sinks: stage tables, dead letters, writes that happen only if the content changed, version stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame, ignore: tuple[str, ...] = ()) -> str:
    """Order-independent hash of all rows without the ignored columns: 12 hexadecimal digits.

    Per-row 64-bit hashes under two seeds, summed as decimals, so one partial aggregate and one
    row to the driver; repeats count.
    """
    cols = sorted(c for c in df.columns if c not in ignore)
    row = F.to_json(F.struct(*cols))
    sums = [F.sum(F.xxhash64(F.lit(s), row).cast("decimal(38,0)")) for s in (1, 2)]
    got = df.select(*cols).agg(F.count("*").alias("n"), *[s.alias(f"h{i}") for i, s in enumerate(sums)])
    return got.select(F.substring(F.sha2(F.concat_ws("|", "n", F.coalesce("h0", F.lit(0)), F.coalesce("h1", F.lit(0))), 256), 1, 12).alias("v")).first()["v"]


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_if_changed(spark: SparkSession, df: DataFrame, path: str, stamp: tuple[str, ...] = ()) -> bool:
    """Write the table unless the one there holds the same rows, stamps aside. True if it was written."""
    try:
        old = spark.read.parquet(path)
        if sorted(old.columns) == sorted(df.columns) and content_hash(old, stamp) == content_hash(df, stamp):
            return False
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    return True


def dead_letters(df: DataFrame, parsed: str, text: str, most: int = 300) -> DataFrame:
    """Rows that no grammar could read, their text cut to ``most`` characters."""
    return df.where(~F.coalesce(F.col(parsed), F.lit(False))).withColumn(text, F.substring(text, 1, most))


def drift(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, side): keys only `listed` or only `present`."""
    a = listed.select(key).distinct().join(present.select(key), key, "left_anti").withColumn("side", F.lit("listed"))
    b = present.select(key).distinct().join(listed.select(key), key, "left_anti").withColumn("side", F.lit("present"))
    return a.unionByName(b)


def write_corrections(df: DataFrame, path: str) -> None:
    """Corrections as JSON, a folder per page; nulls are left out, so a change of one page rewrites only its folder."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "true").partitionBy("page").json(path)
