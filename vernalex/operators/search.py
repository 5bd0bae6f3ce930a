"""Ranked search in tiers over names, taxa and notes, with filters.

Ranks: 0 exact, 1 exact by sound, 2 prefix, 3 prefix by sound, 4 within, 5 within by sound, 7 within one edit,
8 a taxon found within, 9 a phrase of the notes, 10 all words in the notes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import WILDCARD, fold_query, initial_of, phonetic, phonetic_query, search_key

EXACT, PREFIX, CONTAINS, NEAR, TAXON_WITHIN, PHRASE, ALL_WORDS = 0, 2, 4, 7, 8, 9, 10
WHY = {"phonetic": "sounds alike", "near": "one letter apart", "note": "found in the notes"}


@dataclass(frozen=True)
class Filters:
    """None of a filter means any. A threshold never lets a null confidence pass."""

    min_confidence: int | None = None
    dialect: str | None = None
    letter: str | None = None
    family: str | None = None


def position(key: Column, q: str) -> Column:
    """0-based place of the query in the key, -1 if none; U+0001 in a key stands for any letter."""
    plain = F.instr(key, q) - 1
    wild = F.regexp_instr(key, F.lit("".join(f"[{ch}{WILDCARD}]" for ch in q))) - 1
    return F.when(F.contains(key, F.lit(WILDCARD)), wild).otherwise(plain)


def wild_near(key: Column, q: str) -> Column:
    """Within one edit, U+0001 in the key standing for any letter at no cost."""

    def same(k: Column, s: Column) -> Column:
        return F.size(F.filter(F.zip_with(F.split(k, ""), F.split(s, ""), lambda a, b: (a == b) | (a == WILDCARD)), lambda ok: ~ok))

    n, m = F.length(key), len(q)
    lit = F.lit(q)
    shorter = F.exists(F.sequence(F.lit(1), n), lambda i: same(F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)), lit) == 0)
    longer = F.exists(F.array(*[F.lit(q[:i] + q[i + 1 :]) for i in range(m)]), lambda s: same(key, s) == 0)
    return F.when(n == m, same(key, lit) <= 1).when(n == m + 1, shorter).when(n == m - 1, longer).otherwise(F.lit(False))


def near(key: Column, q: str) -> Column:
    plain = (F.abs(F.length(key) - len(q)) <= 1) & (F.levenshtein(key, F.lit(q), 1) >= 0)
    return F.when(F.contains(key, F.lit(WILDCARD)), wild_near(key, q)).otherwise(plain)


def grade(key: Column, q: str) -> Column:
    """struct(rank, at) of the plain tiers; null if the query isn't in the key."""
    at = position(key, q)
    rank = F.when((at == 0) & (F.length(key) == len(q)), EXACT).when(at == 0, PREFIX).otherwise(CONTAINS)
    return F.when(at >= 0, F.struct(rank.alias("rank"), at.cast("int").alias("at")))


def index_names(names: DataFrame) -> DataFrame:
    """Add the key, its sound and the initial; persist this table to search it often."""
    n = names.withColumn("key", search_key("name"))
    return n.withColumns({"sound": phonetic("key"), "initial": initial_of("name")})


def index_taxa(taxa: DataFrame) -> DataFrame:
    n = taxa.withColumn("key", search_key("name"))
    return n.withColumns({"sound": phonetic("key"), "initial": initial_of("name"), "note_key": search_key("notes", False)})


def _hit(kind: str, df: DataFrame, rank: Column, at: Column, length: Column, via: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "id", F.col("name").alias("label"), rank.cast("int").alias("rank"), at.cast("int").alias("at"), length.cast("int").alias("len"), via.cast("string").alias("via"))


def name_hits(names: DataFrame, query: str) -> DataFrame:
    """Names, each in its best tier; an empty query (after folding) lists all at rank 4, place -1."""
    q = fold_query(query)
    if not q:
        return _hit("name", names, F.lit(CONTAINS), F.lit(-1), F.lit(0), F.lit(None))
    plain = grade(F.col("key"), q)
    sound = grade(F.col("sound"), phonetic_query(q)) if len(q) >= 3 else F.lit(None).cast("struct<rank:int,at:int>")
    close = near(F.col("key"), q) if len(q) >= 4 else F.lit(False)
    n = names.withColumns({"_p": plain, "_s": sound})
    n = n.withColumn("_n", F.col("_p").isNull() & F.col("_s").isNull() & close)
    n = n.where(F.col("_p").isNotNull() | F.col("_s").isNotNull() | F.col("_n"))
    rank = F.coalesce(F.col("_p.rank"), F.col("_s.rank") + 1, F.lit(NEAR))
    at = F.coalesce(F.col("_p.at"), F.col("_s.at"), F.lit(0))
    length = F.when(F.col("_n"), F.length("key")).otherwise(F.lit(len(q)))
    via = F.when(F.col("_p").isNotNull(), F.lit(None)).when(F.col("_s").isNotNull(), "phonetic").otherwise("near")
    return _hit("name", n, rank, at, length, via)


def taxon_hits(taxa: DataFrame, query: str) -> DataFrame:
    """Taxa by name; anything but an exact or prefix match ranks 8. An empty query finds none."""
    q = fold_query(query)
    if not q:
        return _hit("taxon", taxa.where(F.lit(False)), F.lit(0), F.lit(0), F.lit(0), F.lit(None))
    sound = grade(F.col("sound"), phonetic_query(q)) if len(q) >= 3 else F.lit(None).cast("struct<rank:int,at:int>")
    t = taxa.withColumns({"_p": grade(F.col("key"), q), "_s": sound}).where(F.col("_p").isNotNull() | F.col("_s").isNotNull())
    rank = F.coalesce(F.col("_p.rank"), F.col("_s.rank") + 1)
    return _hit("taxon", t, F.when(rank >= CONTAINS, TAXON_WITHIN).otherwise(rank), F.coalesce("_p.at", "_s.at"), F.lit(len(q)), F.when(F.col("_p").isNull(), "phonetic"))


def note_hits(taxa: DataFrame, query: str) -> DataFrame:
    """Taxa by their notes: the folded phrase (9), else all words of a query of two or more (10), marked at the longest word."""
    q = fold_query(query)
    if len(q) < 3:
        return _hit("taxon", taxa.where(F.lit(False)), F.lit(0), F.lit(0), F.lit(0), F.lit(None))
    terms = [t for t in (fold_query(w) for w in query.split()) if t]
    phrase = F.instr("note_key", q) - 1
    rank = F.when(phrase >= 0, PHRASE)
    at, length = phrase, F.lit(len(q))
    if len(terms) >= 2:
        every = F.lit(True)
        for t in terms:
            every &= F.contains("note_key", F.lit(t))
        longest = max(terms, key=len)
        rank = F.coalesce(rank, F.when(every, ALL_WORDS))
        at = F.when(phrase >= 0, phrase).otherwise(F.instr("note_key", longest) - 1)
        length = F.when(phrase >= 0, len(q)).otherwise(len(longest))
    t = taxa.withColumn("_r", rank).where(F.col("_r").isNotNull())
    return _hit("taxon", t, F.col("_r"), at, length, F.lit("note"))


def search(names: DataFrame, taxa: DataFrame, query: str, filters: Filters = Filters(), name_taxa: DataFrame | None = None) -> DataFrame:
    """All hits of a query, unordered: kind, id, label, rank, at, len, via.

    A taxon found by name isn't found again by its notes. Filters are applied to
    the inputs, before anything is scored: confidence to names only; letter to both; the dialect
    and the family to the other kind through ``name_taxa`` (name_id, taxon_id) semi-joins.
    """
    n, t = names, taxa
    if filters.min_confidence is not None:
        n = n.where(F.coalesce("confidence", F.lit(-1)) >= filters.min_confidence)
    if filters.letter is not None:
        n, t = n.where(F.col("initial") == filters.letter), t.where(F.col("initial") == filters.letter)
    if filters.dialect is not None:
        n = n.where(F.array_contains("dialects", filters.dialect))
        if name_taxa is not None:
            spoken = names.where(F.array_contains("dialects", filters.dialect)).select(F.col("id").alias("name_id"))
            t = t.join(name_taxa.join(spoken, "name_id", "left_semi").select(F.col("taxon_id").alias("id")), "id", "left_semi")
    if filters.family is not None:
        t = t.where(F.col("family") == filters.family)
        if name_taxa is not None:
            of = taxa.where(F.col("family") == filters.family).select(F.col("id").alias("taxon_id"))
            n = n.join(name_taxa.join(of, "taxon_id", "left_semi").select(F.col("name_id").alias("id")), "id", "left_semi")
    by_name = taxon_hits(t, query)
    by_note = note_hits(t, query).join(by_name.select("id"), "id", "left_anti")
    return name_hits(n, query).unionByName(by_name).unionByName(by_note)


def ranked(hits: DataFrame) -> DataFrame:
    """Order of presentation: rank, label by collation, names before taxa, id."""
    return hits.orderBy("rank", F.expr("label collate en"), "kind", "id")


def page(hits: DataFrame, number: int, size: int = 200) -> DataFrame:
    """The given page (from 0) of the ordered hits: a top-k plan for the rows up to its end, then an offset."""
    return ranked(hits).offset(number * size).limit(size)


def highlight(text: Column, at: Column, length: Column) -> Column:
    """The part of the printed text whose letters fold to key[at : at + length]."""
    from vernalex.functions.text import fold_map

    m = fold_map(text)
    a, b = F.get(m, at), F.get(m, at + length - 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.substring(text, a + 1, b - a + 1))


def snippet(text: Column, at: Column, length: Column, lead: int = 14, tail: int = 90) -> Column:
    """The text around a match of its folded key, widened to whole words, with ellipses where it is cut."""
    from vernalex.functions.text import fold_map

    m = fold_map(text)
    n = F.length(text)
    start = F.greatest(F.lit(0), F.coalesce(F.get(m, at), F.lit(0)) - lead)
    end = F.least(n, F.coalesce(F.get(m, at + length - 1), F.lit(0)) + 1 + tail)
    head = F.substring(text, F.lit(1), start)
    back = F.length(F.regexp_extract(head, r"(\S*)$", 1))
    rest = F.substring(text, end + 1, n)
    more = F.length(F.regexp_extract(rest, r"^(\S*)", 1))
    a, b = start - back, end + more
    body = F.trim(F.substring(text, a + 1, b - a))
    return F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < n, "…").otherwise(""))
