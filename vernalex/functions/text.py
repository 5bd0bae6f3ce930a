"""Column -> Column string normalisation, keys and display helpers.

All functions stay inside Catalyst (no Python UDF); a null input gives a null
output unless the docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "\u0001"
REPLACEMENT = "\ufffd"


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition starts with one base letter."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for cp in range(lo, hi):
            d = unicodedata.normalize("NFD", chr(cp))
            if len(d) > 1 and d[0].isascii():
                src.append(chr(cp))
                dst.append(d[0])
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()

# Digits that scanners print for letters (2 and 7 stand for none).
DIGIT_FROM, DIGIT_TO = "01345689", "oieasobg"
# The letters merged by the phonetic key.
PHONETIC_FROM, PHONETIC_TO = "iyu", "eeo"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def deaccent(c: Column | str) -> Column:
    """Strip accents of Latin letters and combining marks; other characters stay. Plain ASCII is left alone at once."""
    x = col(c)
    folded = F.regexp_replace(F.translate(x, ACCENTED, PLAIN), "[\u0300-\u036f]", "")
    return F.when(x.rlike(r"[^\x00-\x7F]"), folded).otherwise(x)


def squash(c: Column | str) -> Column:
    """Collapse every run of Unicode white space to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def repair_typography(c: Column | str) -> Column:
    """Straight quotes, `--` for long dashes, no blank before `,.;`, squashed."""
    x = F.translate(col(c), "\u2018\u2019\u201a\u201c\u201d\u201e", "'''\"\"\"")
    x = F.regexp_replace(x, "\\s*[\u2014\u2013]\\s*", "--")
    return squash(F.regexp_replace(x, r"\s+([,.;])", "$1"))


def search_key(c: Column | str, wildcard: bool = True) -> Column:
    """Fold to a-z: accents, case, punctuation and digit confusions removed.

    With ``wildcard`` an undecodable character (U+FFFD) becomes U+0001, which
    the search operators let match any one letter; without it, it is dropped.
    """
    x = deaccent(c)
    if wildcard:
        x = F.translate(x, REPLACEMENT, WILDCARD)
    x = F.translate(F.lower(x), DIGIT_FROM, DIGIT_TO)
    return F.regexp_replace(x, "[^a-z\u0001]" if wildcard else "[^a-z]", "")


def fold_query(s: str | None) -> str:
    """The same fold on the driver, so that a query becomes a literal."""
    t = unicodedata.normalize("NFD", s or "")
    t = t.lower().translate(str.maketrans(DIGIT_FROM, DIGIT_TO))
    return "".join(ch for ch in t if "a" <= ch <= "z")


def letters_key(c: Column | str, digits: bool = False) -> Column:
    """Lower-case letters (and digits on request) without any digit confusion."""
    return F.regexp_replace(F.lower(deaccent(c)), "[^a-z0-9]" if digits else "[^a-z]", "")


def phonetic(key: Column | str) -> Column:
    """Length-preserving phonetic fold of a search key."""
    return F.translate(col(key), PHONETIC_FROM, PHONETIC_TO)


def phonetic_query(key: str) -> str:
    return key.translate(str.maketrans(PHONETIC_FROM, PHONETIC_TO))


def initial_of(c: Column | str) -> Column:
    """Index letter: first character without accent, upper case."""
    return F.upper(F.substring(deaccent(c), 1, 1))


def slug(c: Column | str) -> Column:
    x = F.regexp_replace(F.lower(deaccent(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(x, "^-+|-+$", "")


def display_genus(c: Column | str) -> Column:
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 10_000)))


def display_binomial(c: Column | str) -> Column:
    """First word capitalised, the rest lower case; an initial `X.` is kept."""
    words = F.split(F.trim(col(c)), r"\s+")
    head = F.element_at(words, 1)
    first = F.when(head.rlike(r"^[A-Z?]\.$"), head).otherwise(display_genus(head))
    rest = F.transform(F.slice(words, 2, 10_000), F.lower)
    return F.array_join(F.concat(F.array(first), rest), " ")


def split_authority(c: Column | str) -> Column:
    """struct(name, authority): the second word belongs to the name only if lower case."""
    words = F.split(F.trim(col(c)), r"\s+")
    n = F.when(F.size(words) < 2, 1).when(F.element_at(words, 2).rlike(r"^[a-z]"), 2).otherwise(1)
    rest = F.array_join(F.slice(words, n + 1, F.lit(10_000)), " ")
    return F.struct(
        F.array_join(F.slice(words, F.lit(1), n), " ").alias("name"),
        F.when(rest != "", rest).alias("authority"),
    )


def confidence_band(c: Column | str) -> Column:
    """unknown (null), bad (<40), weak (<70) or ok."""
    x = col(c)
    return F.when(x.isNull(), "unknown").when(x < 40, "bad").when(x < 70, "weak").otherwise("ok")


def entity_decode(c: Column | str) -> Column:
    """Decode the five HTML entities once; `&amp;` goes last."""
    x = col(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def ordered_letters(c: Column | str) -> Column:
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def fold_map(c: Column | str) -> Column:
    """array<int>: for each letter of the folded key, its 0-based place in the text."""
    places = F.transform(ordered_letters(c), lambda x, i: F.struct(search_key(x, False).alias("k"), i.alias("i")))
    return F.transform(F.filter(places, lambda s: s["k"] != ""), lambda s: s["i"])


def quality_flags(headword: Column | str, taxa: Column | str, unknown: Column, undocumented: Column) -> Column:
    """Sorted flags of an entry; an entry without any gets an empty array."""
    h, t = col(headword), col(taxa)
    return F.array_compact(
        F.array(
            F.when(F.contains(h, F.lit("é")), F.lit("accent-lost")),
            F.when(F.contains(h, F.lit(REPLACEMENT)), F.lit("glyph-damage")),
            F.when(F.size(unknown) > 0, F.lit("dialect-unrecognised")),
            F.when(F.size(undocumented) > 0, F.lit("dialect-undocumented")),
            F.when(F.exists(t, lambda x: x.rlike(r"[0-9?\\|]")), F.lit("taxon-suspect")),
        )
    )


def delete_one(key: Column | str) -> Column:
    """array<string> of the key and all its one-letter deletions.

    Two keys within one edit always share a member, which turns the one-edit
    join into a plain equi-join.
    """
    k = col(key)
    n = F.length(k)
    cuts = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, n)),
    )
    return F.array_distinct(F.concat(F.array(k), cuts))
