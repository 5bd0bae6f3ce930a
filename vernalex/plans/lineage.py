"""Lineage cuts and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    It holds tables that all executors read, so a folder of one machine would not do: on a cluster without the setting
    there is an error. Only a session whose executors are threads of the driver itself (local[n], as in tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    asked = spark.conf.get("spark.checkpoint.dir", None)
    if not asked:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        asked = tempfile.mkdtemp(prefix="vernalex-checkpoint-")
    sc.setCheckpointDir(asked)
    return sc.getCheckpointDir() or asked


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write the rows once to the checkpoint folder, partitioned ``by`` columns if any, and go on from the written table.

    The folder is shared, so a lost executor costs only its running tasks; unlike an eager
    ``checkpoint()`` the rows are computed once. Tables of a session go when it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never collected by the driver, whatever the planner takes its size for.

    The planner goes by the bytes of written files, which are compressed, and leaves out the rows that an explode adds: what it
    takes for 10 MB can be many times that in memory.
    """
    return df.hint("merge")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The table written once, and broadcast only if it is counted to have at most ``most`` rows."""
    t = cut(df)
    return F.broadcast(t) if t.count() <= most else shuffled(t)


# Salts of a hot key, and the most keys that can be hot: a key is only hot with over 1/MOST_HOT of all rows.
SALTS, MOST_HOT = 64, 100_000


def salted_lookup(left: DataFrame, right: DataFrame, key: str, hot_rows: int = 200_000, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique by ``key``) so that no key of ``left`` floods one task.

    A key with over ``hot_rows`` rows (or 1/MOST_HOT of all, if that is more, so that the list of hot keys is always small enough to broadcast)
    is spread over SALTS tasks by a hash of its other columns, and its one row of ``right`` is repeated for each of them.
    """
    counts = cut(left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot_rows))
    least = max(hot_rows, (counts.agg(F.sum("count")).first()[0] or 0) // MOST_HOT)
    hot = counts.where(F.col("count") > least).select(key, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return left.join(right, key, how)
    others = [c for c in left.columns if c != key]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")).otherwise(0)
    spread = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")
