"""The correction loop: a transcript against the entries read, the differences kept as corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernalex.functions.text import letters_key
from vernalex.operators.align import align_pages


def headword_corrections(entries: DataFrame, transcript: DataFrame, page: list[str]) -> DataFrame:
    """(page, was, headword, similarity, suspicious) where an aligned transcript line differs from what was read.

    entries: page, line_no, text, confidence; transcript: page, line_no, text. Suspicious: the reading was sure
    (85 or more) yet is unlike (under 0.85). Run over all pages at once it re-derives every correction.
    """
    a = align_pages(entries, transcript, page, "line_no", "text")
    e = entries.select(*page, F.col("line_no").alias("left_line_no"), F.col("text").alias("was"), "confidence")
    t = transcript.select(*page, F.col("line_no").alias("right_line_no"), F.col("text").alias("headword"))
    j = a.join(e, [*page, "left_line_no"]).join(t, [*page, "right_line_no"])
    return j.where(F.upper("was") != F.upper("headword")).select(
        *page, "was", "headword", "similarity", ((F.coalesce("confidence", F.lit(0)) >= 85) & (F.col("similarity") < 0.85)).alias("suspicious")
    )


def match_heads(entries: DataFrame, items: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items (page, head, nth) to entries (page, seq, head) by folded head; (matched, refused).

    Without nth a head that occurs more than once on the page is ambiguous and refused, as is an nth beyond the last.
    """
    key = [*page, "_k"]
    e = entries.withColumn("_k", letters_key("head"))
    w = Window.partitionBy(*key)
    e = e.withColumns({"_n": F.row_number().over(w.orderBy("seq")), "_of": F.count("*").over(w)}).select(*key, "seq", "_n", "_of")
    i = items.withColumn("_k", letters_key("head"))
    hit = i.join(e, key, "left").where(F.col("_of").isNull() | F.col("nth").eqNullSafe(F.col("_n")) | (F.col("nth").isNull() & (F.col("_of") == 1)))
    matched = hit.where(F.col("seq").isNotNull()).drop("_n", "_of", "_k")
    refused = items.join(matched.select(*page, "head").distinct(), [*page, "head"], "left_anti")
    return matched, refused


def carry_drops(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Current corrections and the earlier drops whose key the current ones don't mention."""
    kept = previous.where("is_drop").join(current.select(*key), key, "left_anti")
    return current.unionByName(kept)


def doubtful(entries: DataFrame, everything: bool = False) -> DataFrame:
    """Entries worth a look: confidence unknown or under 70."""
    return entries if everything else entries.where(F.coalesce("confidence", F.lit(0)) < 70)


def name_corrections(entries: DataFrame, transcript: DataFrame, page: list[str]) -> DataFrame:
    """(page, was, name, family) where an aligned `Name | Family` transcript differs in the name, or gives another family.

    entries: page, line_no, text (the printed name), family; transcript: page, line_no, text, family. family is null where it agrees or isn't given.
    """
    a = align_pages(entries, transcript, page, "line_no", "text")
    e = entries.select(*page, F.col("line_no").alias("left_line_no"), F.col("text").alias("was"), F.col("family").alias("_had"))
    t = transcript.select(*page, F.col("line_no").alias("right_line_no"), F.col("text").alias("name"), F.col("family").alias("_has"))
    j = a.join(e, [*page, "left_line_no"]).join(t, [*page, "right_line_no"])
    other = F.col("_has").isNotNull() & ~F.col("_has").eqNullSafe(F.col("_had"))
    return j.where((F.upper("was") != F.upper("name")) | other).select(*page, "was", "name", F.when(other, F.col("_has")).alias("family"))
