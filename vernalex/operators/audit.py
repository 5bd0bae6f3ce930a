"""Data-quality measures: medians, implausible words, cross-checks, boxes, confidence of headwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(df: DataFrame, value: str, group: list[str] = []) -> DataFrame:
    """(group, n, n_missing, median): the upper middle element, exactly, over a histogram of distinct values."""
    hist = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(value)
    known = hist.where(F.col(value).isNotNull()).withColumn("_run", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    mid = known.where(F.col("_run") > F.floor(F.col("_all") / 2)).groupBy(*group).agg(F.min(value).alias("median"))
    n = hist.groupBy(*group).agg(F.sum(F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)).alias("n"), F.sum(F.when(F.col(value).isNull(), F.col("_n")).otherwise(0)).alias("n_missing"))
    return n.join(mid, group, "left") if group else n.crossJoin(F.broadcast(mid))


def implausible(words: Column) -> Column:
    """Whether any word of three letters or more has no vowel, under a fifth of vowels, or four consonants in a row."""
    def bad(w: Column) -> Column:
        vowels = F.regexp_count(w, F.lit("[aeiouy]"))
        return (F.length(w) >= 3) & ((vowels / F.length(w) < 0.2) | w.rlike("[bcdfghjklmnpqrstvwxz]{4}"))

    return F.exists(words, bad)


def contained_in(points: DataFrame, boxes: DataFrame, page: list[str], slack: float = 0.02) -> DataFrame:
    """Pairs of a point (px, py) and a box [x, y, w, h] of the same page that holds it, with slack in x only."""
    b = boxes.withColumns({"_x": F.col("box")[0], "_y": F.col("box")[1], "_w": F.col("box")[2], "_h": F.col("box")[3]})
    inside = F.col("px").between(F.col("_x") - slack, F.col("_x") + F.col("_w") + slack) & F.col("py").between(F.col("_y"), F.col("_y") + F.col("_h"))
    return points.join(b, page).where(inside).drop("_x", "_y", "_w", "_h")


def weakest_token(entries: DataFrame, tokens: DataFrame, page: list[str], key: str, words: str) -> DataFrame:
    """(key, confidence): the least confidence of an entry's tokens if every one is found on its page, else null."""
    asked = entries.select(key, *page, F.explode_outer(F.array_distinct(words)).alias("token"))
    hit = asked.join(tokens, [*page, "token"], "left")
    return hit.groupBy(key).agg(F.when((F.count("conf") == F.count("token")) & (F.count("token") > 0), F.min("conf")).alias("confidence"))


def guard_alignment(aligned: DataFrame, least: float = 0.6) -> float:
    """Share of aligned pairs that are alike; raises if it is under ``least``, as a transcript of the wrong page would be."""
    row = aligned.agg(F.avg(F.when(F.coalesce("similarity", F.lit(0.0)) >= 0.5, 1.0).otherwise(0.0)).alias("r")).first()
    ratio = row["r"] or 0.0
    if ratio < least:
        raise ValueError(f"only {ratio:.0%} of the lines agree; is this the right page?")
    return ratio
