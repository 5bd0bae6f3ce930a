"""Faceted browsing and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import initial_of


def facet(df: DataFrame, value: Column, record: str, into: str) -> DataFrame:
    """(facet value, n): distinct records per value, values without any left out."""
    return df.select(F.col(record), value.alias(into)).where(F.col(into).isNotNull()).groupBy(into).agg(F.count_distinct(record).alias("n"))


def letters(names: DataFrame) -> DataFrame:
    """(letter, n_names) of names that start with a letter A to Z."""
    n = names.withColumn("letter", initial_of("name"))
    return n.where(n.letter.rlike("^[A-Z]$")).groupBy("letter").agg(F.count("*").alias("n_names"))


def of_letter(names: DataFrame, letter: str) -> DataFrame:
    return names.where(initial_of("name") == letter)


def of_language(names: DataFrame, dialect: str) -> DataFrame:
    return names.where(F.array_contains("dialects", dialect))


def family_tree(taxa: DataFrame, family: str, genus: str, species: str) -> DataFrame:
    """(family, genus, n_species, has_own_entry): two levels, a genus's own entry apart from its species."""
    own = F.coalesce(F.col(species), F.lit("")) == ""
    return taxa.groupBy(family, genus).agg(F.count_distinct(F.when(~own, F.col(species))).alias("n_species"), F.bool_or(own).alias("has_own_entry"))


def citation(pages: Column, leaves: Column) -> Column:
    """Printed pages, each once and in order; the leaves where none is printed."""
    printed = F.filter(F.array_distinct(pages), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(printed) > 0, F.array_join(printed, ", ")).otherwise(F.array_join(F.array_distinct(F.transform(leaves, lambda x: x.cast("string"))), ", "))


def leaf_url(template: str, page: Column) -> Column:
    """A link to a scanned page: `{page}` of the template replaced."""
    return F.replace(F.lit(template), F.lit("{page}"), page.cast("string"))


def route(url: Column) -> Column:
    """struct(kind, id, view, key) of `#name/<id>`, `#taxon/<id>` or `#browse/<view>/<key>`; null for anything else."""
    entry = r"^#(name|taxon)/(\d+)$"
    walk = r"^#browse(?:/([^/]*)(?:/(.*))?)?$"

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    return F.when(url.rlike(entry), F.struct(F.regexp_extract(url, entry, 1).alias("kind"), F.regexp_extract(url, entry, 2).cast("long").alias("id"), F.lit(None).cast("string").alias("view"), F.lit(None).cast("string").alias("key"))).when(
        url.rlike(walk), F.struct(F.lit("browse").alias("kind"), F.lit(None).cast("long").alias("id"), given(F.regexp_extract(url, walk, 1)).alias("view"), given(F.url_decode(F.regexp_extract(url, walk, 2))).alias("key"))
    )
