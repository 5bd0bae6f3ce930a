import pytest
from pyspark.sql import functions as F

from vernalex.plans import lineage


def test_hot_keys_are_spread_whatever_their_number(spark):
    left = spark.range(40_000).select((F.col("id") % 10_010).alias("k"), F.col("id").alias("v"))
    right = spark.range(10_005).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = sorted(tuple(r) for r in left.join(right, "k", "left").collect())
    got = lineage.salted_lookup(left, right, "k", hot_rows=2, how="left").select("k", "v", "w")
    assert sorted(tuple(r) for r in got.collect()) == plain
    assert lineage.salted_lookup(left, right, "k", hot_rows=2).count() == left.join(right, "k").count()


def test_null_keys_and_empty_tables(spark):
    left = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k long, v long")
    right = spark.createDataFrame([(1, 9)], "k long, w long")
    for hot in (0, 100):
        assert sorted((r.v, r.w) for r in lineage.salted_lookup(left, right, "k", hot_rows=hot, how="left").collect()) == [(1, None), (2, 9), (3, 9)]
        assert lineage.salted_lookup(left.limit(0), right, "k", hot_rows=hot).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        lineage.checkpoint_dir(Session())
