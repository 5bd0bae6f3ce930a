"""References to records that do not exist: per reference, per period, and inherited down the key graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import deaccent
from vernalex.operators.taxa import citations, plants, resolve_names, scientific_entries
from vernalex.plans.lineage import cut, shuffled
from vernalex.sources.tables import first_deliveries, read


def judge_references(refs: DataFrame, targets: DataFrame, key: list[str], ref: list[str]) -> DataFrame:
    """Orphan references among ``refs`` (``ref`` columns, key columns, ``at``).

    ``targets``: key columns, recorded_at, withdrawn_at and optionally ``parent_id``.
    A target stands at t if recorded_at <= t and withdrawn_at is null or > t.
    Every reference comes back with n_targets, n_standing and reason: null if
    one stands, `missing` without any target, `late` if all were recorded
    after t, else `deleted`. A null key column matches nothing; a target without
    recorded_at never stands and isn't late; with ``at`` null only `missing` is decided.
    """
    stands = (F.col("recorded_at") <= F.col("at")) & (F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > F.col("at")))
    t = targets.withColumn("_there", F.lit(1))
    agg = (
        refs.join(shuffled(t), key, "left")
        .groupBy(*ref)
        .agg(
            F.first("at").alias("at"),
            F.count("_there").alias("n_targets"),
            F.count_if(stands).alias("n_standing"),
            F.count_if(F.col("recorded_at") > F.col("at")).alias("_late"),
        )
    )
    reason = (
        F.when(F.col("n_targets") == 0, "missing")
        .when((F.col("n_standing") > 0) | F.col("at").isNull(), F.lit(None))
        .when(F.col("_late") == F.col("n_targets"), "late")
        .otherwise("deleted")
    )
    return agg.withColumn("reason", reason).drop("_late")


def orphan_cascade(direct: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Fixpoint over the foreign-key graph.

    ``direct``: (table, id) of records with an orphan reference of their own.
    ``edges``: (table, id, parent_table, parent_id), the references that hold, with several targets of one reference under one ``ref``, if there is such a
    column. A reference is orphaned if all of its targets are orphans, a record if one of its references is.
    Returns (table, id, status, depth): `direct` at depth 0, else `inherited` with
    the round that reached it. Cycles end, as a record is added once. Each round's frontier is a written table.
    """
    several = "ref" in edges.columns
    ref = ["table", "id", "ref"]
    if several:
        n = edges.groupBy(*ref).agg(F.count("*").alias("_n"))
    found = cut(direct.select("table", "id").distinct().withColumn("depth", F.lit(0)))
    frontier, rounds = found, [found]
    for depth in range(1, max_rounds + 1):
        known = reduce(DataFrame.unionByName, rounds).select("table", "id")
        # with several targets, earlier orphans count as well
        up = (known if several else frontier).select(F.col("table").alias("parent_table"), F.col("id").alias("parent_id"))
        children = edges.join(shuffled(up), ["parent_table", "parent_id"], "left_semi")
        if several:
            children = children.groupBy(*ref).agg(F.count("*").alias("_hit")).join(shuffled(n), ref).where("_hit = _n")
        frontier = cut(children.select("table", "id").distinct().join(shuffled(known), ["table", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    else:
        raise RuntimeError(f"the key graph is deeper than {max_rounds} levels; raise max_rounds")
    out = reduce(DataFrame.unionByName, rounds)
    return out.withColumn("status", F.when(F.col("depth") == 0, "direct").otherwise("inherited"))


def _folded(c: str):
    return F.upper(deaccent(c))


def plant_references(part1: DataFrame, part2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, targets) of part1.taxa to the scientific entries of the plant."""
    entries = scientific_entries(part2)
    p1 = first_deliveries(part1, "seq", "volume_id", "taxa", "recorded_at")
    c = citations(p1, "seq", keep=("volume_id", "recorded_at"))
    # written before it is filtered: a filter pushed below the parser would parse every name again
    c = cut(c.select("seq", "pos", "volume_id", "genus", F.coalesce("epithet", F.lit("")).alias("epithet"), F.col("recorded_at").alias("at"), "kind"))
    refs = c.where(F.col("kind").isin("full", "genus")).drop("kind")
    spelled = plants(entries)
    resolved = resolve_names(refs, spelled)
    of_plant = entries.join(shuffled(spelled), ["volume_id", "genus", "epithet"]).select("plant_id", "recorded_at", "withdrawn_at")
    targets = resolved.join(shuffled(of_plant), "plant_id").select("volume_id", "genus", "epithet", "recorded_at", "withdrawn_at")
    return refs, targets


def correction_references(corrections: DataFrame, part1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, targets) of taxa_corrections.was_taxa to the entries of that page, heading and string."""
    fix = first_deliveries(corrections, "correction_id", "volume_id", "page", "was", "was_taxa", "recorded_at")
    refs = fix.select("correction_id", "volume_id", "page", _folded("was").alias("head"), F.col("recorded_at").alias("at"), F.posexplode("was_taxa").alias("pos", "cited"))
    p1 = first_deliveries(part1, "seq", "volume_id", "page", "headword", "taxa", "recorded_at", "withdrawn_at")
    targets = p1.select("seq", "volume_id", "page", _folded("headword").alias("head"), F.explode(F.array_distinct("taxa")).alias("cited"), "recorded_at", "withdrawn_at")
    return refs.where(F.col("cited").isNotNull()), targets


def dictionary_orphans(part1: DataFrame, part2: DataFrame, corrections: DataFrame) -> DataFrame:
    """Orphan references of the dictionary, direct and inherited.

    (src_table, ref_id, pos, year_month, reason, status, depth). A reference
    that holds is `inherited` if the record it points at is an orphan itself;
    its reason is then `inherited`. Null arrays and elements refer to nothing, a
    null headword or `was` matches nothing; repeated deliveries count once; empty tables give no
    rows, or only missing references; other columns are ignored.
    """
    refs1, targets1 = plant_references(part1, part2)
    judged1 = judge_references(refs1, targets1, ["volume_id", "genus", "epithet"], ["seq", "pos"])
    refs2, targets2 = correction_references(corrections, part1)
    refs2 = cut(refs2)
    standing = cut(refs2.join(shuffled(targets2), ["volume_id", "page", "head", "cited"]).select("correction_id", "pos", "at", "seq", "recorded_at", "withdrawn_at"))
    judged2 = judge_references(refs2, standing.drop("at"), ["correction_id", "pos"], ["correction_id", "pos"])
    month = F.date_format("at", "yyyy-MM").alias("year_month")
    first = judged1.where(F.col("reason").isNotNull()).select(F.lit("part1_vernacular").alias("src_table"), F.col("seq").cast("long").alias("ref_id"), F.col("pos").cast("long").alias("pos"), month, "reason")
    second = judged2.where(F.col("reason").isNotNull()).select(F.lit("taxa_corrections").alias("src_table"), F.col("correction_id").cast("long").alias("ref_id"), F.col("pos").cast("long").alias("pos"), month, "reason")
    direct = cut(first.unionByName(second))
    # the references that hold: to records that stand at their time
    stands = (F.col("recorded_at") <= F.col("at")) & (F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > F.col("at")))
    edges = cut(standing.where(stands).select(F.lit("taxa_corrections").alias("table"), F.col("correction_id").alias("id"), F.col("pos").cast("long").alias("ref"), F.lit("part1_vernacular").alias("parent_table"), F.col("seq").alias("parent_id"), month))
    cascade = cut(orphan_cascade(direct.select(F.col("src_table").alias("table"), F.col("ref_id").alias("id")), edges))
    records = cascade.select(F.col("table").alias("src_table"), F.col("id").alias("ref_id"), "depth", "status")
    up = cascade.select(F.col("table").alias("parent_table"), F.col("id").alias("parent_id"), F.col("depth").alias("_up"))
    inherited = (
        edges.join(shuffled(up), ["parent_table", "parent_id"], "left")
        .groupBy(F.col("table").alias("src_table"), F.col("id").cast("long").alias("ref_id"), F.col("ref").alias("pos"), "year_month")
        .agg((F.max("_up") + 1).alias("depth"), F.count_if(F.col("_up").isNull()).alias("_sound"))
        .where("_sound = 0")
        .drop("_sound")
        .withColumns({"reason": F.lit("inherited"), "status": F.lit("inherited")})
    )
    # a direct orphan is a reference of its own of a record at depth 0
    return direct.join(shuffled(records.where("depth = 0")), ["src_table", "ref_id"]).unionByName(inherited)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The references that the cascade starts from: those that are orphans themselves, not by what they refer to."""
    found = dictionary_orphans(read(spark, sf_dir, "part1_vernacular"), read(spark, sf_dir, "part2_scientific"), read(spark, sf_dir, "taxa_corrections"))
    return found.where(F.col("status") == "direct").select("src_table", "ref_id", "pos", "year_month", "reason")


def p4_orphans_by_month(spark, sf_dir: str) -> DataFrame:
    """Orphan references per table, month, reason and status."""
    found = dictionary_orphans(read(spark, sf_dir, "part1_vernacular"), read(spark, sf_dir, "part2_scientific"), read(spark, sf_dir, "taxa_corrections"))
    return found.groupBy("src_table", "year_month", "status", "reason").agg(F.count("*").alias("n_references"), F.countDistinct("ref_id").alias("n_records"))
