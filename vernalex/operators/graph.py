"""The graph of names and taxa: merged headwords, merged taxa, links both ways, siblings, facets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import search_key


def first_seen(df: DataFrame, key: str, value: str, order: str, into: str) -> DataFrame:
    """(key, into): distinct values of each key in the order of first appearance.

    Two aggregations, so that only distinct values are ever gathered, however often a key occurs.
    """
    once = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    gathered = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_o", value))).alias("_l"))
    return gathered.select(key, F.transform("_l", lambda s: s[value]).alias(into))


def merge_headwords(entries: DataFrame) -> DataFrame:
    """One name per search key: id (first seq), printed form, dialects and places first seen first, pages, least confidence.

    Entries whose headword has no letter are left out.
    """
    e = entries.withColumn("key", search_key("headword")).where(F.length("key") > 0)
    base = e.groupBy("key").agg(
        F.min("seq").alias("id"),
        F.min_by("headword", "seq").alias("name"),
        F.min("confidence").alias("confidence"),
        F.count("*").alias("n_entries"),
        F.count_distinct("volume_id", "page").alias("n_pages"),
    )
    d = first_seen(e.select("key", "seq", F.explode("dialects").alias("dialect")), "key", "dialect", "seq", "dialects")
    p = first_seen(e, "key", "place", "seq", "places")
    out = base.join(d, "key", "left").join(p, "key", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"dialects": F.coalesce("dialects", none), "places": F.coalesce("places", none)})


def merge_taxa(entries: DataFrame, key: str = "key") -> DataFrame:
    """One taxon per key: the first row, with notes and family back-filled from the first later row that has them."""
    def first_given(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))

    return entries.groupBy(key).agg(
        F.min("seq").alias("id"),
        F.min_by("name", "seq").alias("name"),
        F.min_by("authority", "seq").alias("authority"),
        first_given("family").alias("family"),
        first_given("notes").alias("notes"),
        F.count("*").alias("n_entries"),
    )


def taxon_key(name: Column) -> Column:
    """Genus and epithet in lower-case letters; cut at rank marks, `?` and accents dropped."""
    from vernalex.functions.text import deaccent

    x = F.regexp_replace(name, r"(?i)(?<![A-Za-z0-9_])(?:var|subsp|spp?|f)\.?(?![A-Za-z0-9_]).*$", "")
    x = F.regexp_replace(F.lower(deaccent(F.replace(x, F.lit("?"), F.lit("")))), "[^a-z ]", " ")
    words = F.filter(F.split(x, " +"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 2), " ")


def links(entries: DataFrame) -> DataFrame:
    """Distinct (name_key, taxon_key) with the first authority printed: n citations and the first seq, pos."""
    from vernalex.functions.text import split_authority

    e = entries.select(search_key("headword").alias("name_key"), "seq", F.posexplode("taxa").alias("pos", "cited"))
    s = F.regexp_replace(F.regexp_replace("cited", r"^\s*['\"]+", ""), r"(?i),?\s+and other species\W*$", "")
    e = e.withColumn("_s", split_authority(F.regexp_replace(F.regexp_replace(s, r"[\s.;]+$", ""), r"^(\w+),.*$", "$1")))
    e = e.withColumn("taxon_key", taxon_key(F.col("_s.name"))).where((F.length("name_key") > 0) & (F.length("taxon_key") > 0))
    at = F.struct("seq", "pos")
    return e.groupBy("name_key", "taxon_key").agg(F.min_by("_s.authority", at).alias("authority"), F.min(at).alias("_first"), F.count("*").alias("n_citations")).select("name_key", "taxon_key", "authority", F.col("_first.seq").alias("first_seq"), "n_citations")


def siblings(link_table: DataFrame, name_key: str) -> DataFrame:
    """Names that share a taxon with one name, and how many taxa they share: two semi-joins, never all pairs."""
    mine = link_table.where(F.col("name_key") == name_key).select("taxon_key").distinct()
    other = link_table.where(F.col("name_key") != name_key).join(mine, "taxon_key", "left_semi")
    return other.groupBy("name_key").agg(F.count_distinct("taxon_key").alias("n_shared"))


def resolve_stubs(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Replay of the sequential stub rule per genus: (key, order) against known keys, in order of first appearance.

    Returns (key, target, how): `exact`, `near` (the only known key or earlier stub within one edit),
    or `stub` (a new key, findable by the later ones; ambiguity counts earlier stubs too). The
    rule is sequential, so the distinct keys without an exact hit are replayed in one task, whose
    size grows with their number.
    """
    exact = keys.join(known.select("key").distinct(), "key", "left_semi").select("key", F.col("key").alias("target"), F.lit("exact").alias("how"))
    rest = keys.join(known.select("key"), "key", "left_anti").select("key", "order", F.lit(False).alias("known"))
    # only known keys one deletion away from an asked key can matter
    from vernalex.functions.text import delete_one

    v = rest.select(F.explode(delete_one("key")).alias("_v")).distinct()
    near = known.select("key").distinct().withColumn("_v", F.explode(delete_one("key"))).join(v, "_v", "left_semi").select("key").distinct()
    pool = rest.unionByName(near.select("key", F.lit(-1).cast("long").alias("order"), F.lit(True).alias("known")))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        if rows.empty:
            return
        rows = rows.sort_values(["order", "key"])
        have: dict[str, set[str]] = {}

        def cuts(k: str) -> set[str]:
            return {k, *(k[:i] + k[i + 1 :] for i in range(len(k)))}

        def close(a: str, b: str) -> bool:
            if abs(len(a) - len(b)) > 1:
                return False
            if len(a) == len(b):
                return sum(x != y for x, y in zip(a, b)) <= 1
            s, t = sorted((a, b), key=len)
            return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

        out = []
        for key, is_known in zip(rows["key"], rows["known"]):
            if is_known:
                for c in cuts(key):
                    have.setdefault(c, set()).add(key)
                continue
            hits = {k for c in cuts(key) for k in have.get(c, ()) if close(k, key)}
            if len(hits) == 1:
                out.append((key, next(iter(hits)), "near"))
            else:
                out.append((key, key, "stub"))
                for c in cuts(key):
                    have.setdefault(c, set()).add(key)
        yield pd.DataFrame(out, columns=["key", "target", "how"])

    # an inherently sequential rule: unresolved distinct keys only, in one task
    replayed = pool.coalesce(1).mapInPandas(replay, "key string, target string, how string")
    return exact.unionByName(replayed)
