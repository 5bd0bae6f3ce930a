"""Joins that tolerate spelling: one-edit predicate, exact-then-unique-near lookup, snapping to a list, word-set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernalex.functions.text import delete_one


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion or substitution apart; null if either is null."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) >= 0)


def near_lookup(left: DataFrame, right: DataFrame, key: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (group, key) of left with the right key each stands for.

    (…, key, found, how, n_candidates): how is `exact`, `near` (exactly one
    other key within one edit), `ambiguous` (several; refused) or `none`; found is
    null for the last two. Only keys without an exact hit enter the fuzzy
    step, which is an equi-join on shared one-letter deletions. Null keys are left out.
    """
    on = [*group, key]
    asked = left.select(*on).where(F.col(key).isNotNull()).distinct()
    known = right.select(*on).where(F.col(key).isNotNull()).distinct()
    exact = asked.join(known, on, "left_semi")
    rest = asked.join(known, on, "left_anti")
    a = rest.select(*on, F.explode(delete_one(key)).alias("_v"))
    b = known.select(*group, F.col(key).alias("_k"), F.explode(delete_one(key)).alias("_v"))
    near = (
        a.join(b, [*group, "_v"])
        .where(within_one_edit(F.col(key), F.col("_k")))
        .groupBy(*on)
        .agg(F.count_distinct("_k").alias("n_candidates"), F.min("_k").alias("_one"))
    )
    fuzzy = rest.join(near, on, "left").select(
        *on,
        F.when(F.col("n_candidates") == 1, F.col("_one")).alias("found"),
        F.when(F.col("n_candidates").isNull(), "none").when(F.col("n_candidates") == 1, "near").otherwise("ambiguous").alias("how"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )
    return exact.select(*on, F.col(key).alias("found"), F.lit("exact").alias("how"), F.lit(1).cast("long").alias("n_candidates")).unionByName(fuzzy)


def deligature(c: Column) -> Column:
    """Letters of a family name with the scanner's usual misreadings undone."""
    x = F.regexp_replace(c, r"\.\s*$", "")
    x = F.lower(F.translate(x, "éw0O1", "eeool"))
    return F.regexp_replace(x, "[^a-z]", "")


def snap(values: DataFrame, value: str, listed: DataFrame, entry: str, position: str) -> DataFrame:
    """Distinct values with the listed entry they are nearest to.

    (value, snapped, how, distance): exact folded key first, else the least
    Levenshtein distance within max(2, round(length / 6) + 1), the earlier
    listed on ties; null beyond. The list is the small side; Spark broadcasts it by
    its size.
    """
    v = values.select(value).where(F.col(value).isNotNull()).distinct().withColumn("_k", deligature(F.col(value)))
    t = listed.select(F.col(entry).alias("_entry"), F.col(position).alias("_pos"), deligature(F.col(entry)).alias("_e"))
    # round half up, as the cap is defined
    cap = F.greatest(F.lit(2), F.floor(F.length("_k") / 6 + 0.5).cast("int") + 1)
    v = v.withColumn("_cap", cap)
    near = v.join(t, F.abs(F.length("_k") - F.length("_e")) <= F.col("_cap")).withColumn("_d", F.expr("levenshtein(_k, _e, _cap)")).where("_d >= 0")
    best = near.groupBy(value).agg(F.min_by(F.struct("_entry", "_d"), F.struct("_d", "_pos")).alias("b"))
    out = v.join(best, value, "left")
    return out.select(
        value,
        F.col("b._entry").alias("snapped"),
        F.when(F.col("b").isNull(), "none").when(F.col("b._d") == 0, "exact").otherwise("fuzzy").alias("how"),
        F.col("b._d").alias("distance"),
    )


def long_words(c: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def band_offsets(left: DataFrame, right: DataFrame, position: str, words: str, group: list[str], band: int = 12) -> DataFrame:
    """Mean Jaccard of left page i and right page i + d for each offset d in ±band.

    (group, offset, n_pages, n_shared): a band join written as an equi-join on shared words, so only page pairs
    that share a word meet; pages without a partner count as 0.
    """
    a = left.select(*group, F.col(position).alias("_i"), F.col(words).alias("_a"))
    b = right.select(*group, F.col(position).alias("_j"), F.col(words).alias("_b"))
    offs = a.withColumn("_j", F.explode(F.sequence(F.col("_i") - band, F.col("_i") + band)))
    pairs = offs.join(b, [*group, "_j"]).withColumn("_s", jaccard(F.col("_a"), F.col("_b")))
    n = a.groupBy(*group).agg(F.count("*").alias("n_pages"))
    got = pairs.groupBy(*group, (F.col("_j") - F.col("_i")).alias("offset")).agg(F.sum("_s").alias("_sum"))
    return got.join(n, group).select(*group, "offset", "n_pages", (F.col("_sum") / F.col("n_pages")).alias("mean_similarity"))


def align_page_sequences(ours: DataFrame, theirs: DataFrame, group: list[str], page: str, text: str, window: int = 12, floor: float = 0.25) -> DataFrame:
    """(group, page, their_page, similarity): the page of another scan that each page is, null if none is like it.

    The offset that agrees best on every seventh long page (over 400 characters) is tried first and
    taken at once above 0.5; else the most similar page within ``window`` of it above
    ``floor``, the nearer and then the lower of equals. Only pages of that band ever meet.
    """
    a = ours.select(*group, page, text, long_words(F.col(text)).alias("_a"))
    b = theirs.select(*group, F.col(page).alias("their_page"), long_words(F.col(text)).alias("_b"))
    order = Window.partitionBy(*group).orderBy(page)
    probes = a.where(F.length(text) > 400).withColumn("_k", F.row_number().over(order)).where(F.col("_k") % 7 == 1)

    def pairs(pages: DataFrame, around: Column) -> DataFrame:
        offs = pages.withColumn("their_page", F.explode(F.sequence(F.col(page) + around - window, F.col(page) + around + window)))
        return offs.join(b, [*group, "their_page"]).withColumn("_s", jaccard(F.col("_a"), F.col("_b")))

    mean = pairs(probes, F.lit(0)).groupBy(*group, (F.col("their_page") - F.col(page)).alias("_o")).agg(F.avg("_s").alias("_m"))
    best = mean.groupBy(*group).agg(F.max_by("_o", F.struct("_m", -F.col("_o"))).alias("_best"))
    cand = pairs(a.where(F.trim(text) != "").join(best, group, "left").withColumn("_best", F.coalesce("_best", F.lit(0))), F.col("_best"))
    off = F.col("their_page") - F.col(page) - F.col("_best")
    sure = (off == 0) & (F.col("_s") > 0.5)
    good = cand.where(F.col("_s") > floor).groupBy(*group, page).agg(F.max_by(F.struct("their_page", F.col("_s").alias("similarity")), F.struct(sure, "_s", -F.abs(off), -off)).alias("r"))
    return ours.select(*group, page).join(good, [*group, page], "left").select(*group, page, "r.their_page", "r.similarity")
