"""Consolidating pairwise matches into groups: minimum labels along edges, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernalex.plans.lineage import cut, salted_lookup
from vernalex.sources.tables import read


def _jump(parents: DataFrame, max_jumps: int) -> DataFrame:
    """parents(id, p) with p < id or a root p = id: replace p by its own parent until nothing changes."""
    for _ in range(max_jumps):
        up = parents.select(F.col("id").alias("p"), F.col("p").alias("_pp"))
        nxt = cut(salted_lookup(parents, up, "p", how="left").select("id", F.coalesce("_pp", "p").alias("_n"), "p"))
        changed = not nxt.where(F.col("_n") != F.col("p")).isEmpty()
        parents = nxt.select("id", F.col("_n").alias("p"))
        if not changed:
            return parents
    raise RuntimeError(f"labels still change after {max_jumps} jumps")


def connected_groups(pairs: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(group_id, record_id): the smallest id linked to each record, directly or through others.

    Each round labels every node with its smallest neighbour, jumps pointers
    until each tree has one root, and contracts the edges to the roots; the
    rest of the graph is at most half as large each time. Rows with a null end are no
    links; repeats, either order and self-pairs are allowed (a record only
    paired with itself is its own group); an empty table gives no rows. Every round is
    checkpointed. All steps are partial aggregates and look-ups by unique id,
    so a hub of any degree never lies in one task.
    """
    e = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    e = e.select(F.least(left, right).cast("long").alias("u"), F.greatest(left, right).cast("long").alias("v"))
    edges = cut(e.distinct())
    labels = cut(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id")))
    edges = edges.where(F.col("u") != F.col("v"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels.select(F.col("label").alias("group_id"), F.col("id").alias("record_id"))
        parents = cut(edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("p")))
        # v's smallest neighbour below itself; a node without one is a root and needs no row
        roots = _jump(parents, max_rounds)
        labels = cut(salted_lookup(labels, roots.select(F.col("id").alias("label"), F.col("p").alias("_p")), "label", how="left").select("id", F.coalesce("_p", "label").alias("label")))
        r = roots.select(F.col("id").alias("u"), F.col("p").alias("_u"))
        edges = salted_lookup(edges, r, "u", how="left").select(F.coalesce("_u", "u").alias("u"), "v")
        r = roots.select(F.col("id").alias("v"), F.col("p").alias("_v"))
        edges = salted_lookup(edges, r, "v", how="left").select("u", F.coalesce("_v", "v").alias("v")).where(F.col("u") != F.col("v"))
        edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    raise RuntimeError(f"groups still change after {max_rounds} rounds")


def p5_found(spark, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "match_pairs").where(F.col("is_match"))
    return connected_groups(pairs, "left_seq", "right_seq")


def p5_group_sizes(spark, sf_dir: str) -> DataFrame:
    """How many groups have each size."""
    sizes = p5_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_records"))
    return sizes.groupBy("n_records").agg(F.count("*").alias("n_groups"))
