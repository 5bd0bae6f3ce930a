"""Mapping free-entered values to a reference list: a trie of entries and aliases walked by a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernalex.sources.tables import read

NONE = "(none)"
# Pairs of letters that readers and scanners mix up; they cost a little less than other edits.
LOOSE_PAIRS = ("iy", "ey", "ei", "uo", "ao", "td", "ck", "mn", "li", "bh", "rn")
LOOSE = {frozenset(p) for p in LOOSE_PAIRS}
# Endings of family names; an entry is also reachable without its ending.
FAMILY_ENDINGS = ("aceae", "iferae", "ineae", "osae", "teae", "reae", "eae", "ae")
# Remarks that follow or precede a family name.
REMARK_BEFORE = r"^\W*(?:fam(?:ily|\.)?\W+)?"
REMARK_AFTER = r"(?:\s*\(\?\)|\s+(?:emend\.|p\.\s?p\.|s\.\s?l\.|[A-Z][a-z]*\.(?:[A-Z][a-z]+\.)?))*\W*$"


def plain(s: str) -> str:
    """Lower-case letters; anything else inside a word stays as one `#` per mark; blanks, hyphens and outer marks go."""
    s = s.replace("æ", "ae").replace("œ", "oe").replace("Æ", "ae")
    s = "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.combining(ch)).lower()
    s = re.sub(r"[\s\-¬.,;:()'\"?]+", "", s)
    return re.sub(r"[^a-z]", "#", s)


def limit(n: int) -> int:
    """Edits allowed for a value of n letters."""
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3


class Trie:
    """Paths (spellings) to canonical entries; several paths may lead to one entry."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: str) -> None:
        node = self.root
        for ch in path:
            node = node.setdefault(ch, {})
        node.setdefault("", set()).add(entry)

    def exact(self, path: str) -> set[str]:
        node = self.root
        for ch in path:
            node = node.get(ch)
            if node is None:
                return set()
        return node.get("", set())

    def below(self, prefix: str) -> set[str]:
        """All entries whose path starts with the prefix."""
        node = self.root
        for ch in prefix:
            node = node.get(ch)
            if node is None:
                return set()
        found, stack = set(), [node]
        while stack:
            n = stack.pop()
            for ch, child in n.items():
                if ch:
                    stack.append(child)
                else:
                    found |= child
        return found

    def within(self, word: str, most: int) -> dict[str, float]:
        """entry -> least cost, of all entries within ``most`` edits of the word.

        The state of the automaton is a row of the edit matrix; a branch is left as
        soon as its row has no cell within ``most``. Substituting a mark or a
        letter of a loose pair costs less than one, only to order the answers.
        """
        n = len(word)
        found: dict[str, float] = {}
        stack = [(self.root, tuple(float(i) for i in range(n + 1)))]
        while stack:
            node, row = stack.pop()
            for ch, child in node.items():
                if not ch:
                    if row[n] <= most:
                        for e in child:
                            if row[n] < found.get(e, 99.0):
                                found[e] = row[n]
                    continue
                new = [row[0] + 1]
                low = new[0]
                for i in range(1, n + 1):
                    c = word[i - 1]
                    sub = row[i - 1]
                    if c != ch:
                        sub += 0.8 if c == "#" else 0.9 if frozenset((c, ch)) in LOOSE else 1.0
                    best = min(sub, row[i] + 1, new[i - 1] + (0.9 if c == ch else 1))
                    new.append(best)
                    low = min(low, best)
                if low <= most:
                    stack.append((child, tuple(new)))
        return found


def closest(trie: Trie, word: str, most: int) -> dict[str, float]:
    """Entries within ``most`` edits, searched with one edit first so that most branches are never walked."""
    for k in range(1, most + 1):
        found = trie.within(word, k)
        if found:
            return found
    return {}


def pick(found: dict[str, float], order: dict[str, int], head: str) -> str | None:
    """The cheapest entry; among equals one with the value's first letter, then the first listed."""
    if not found:
        return None
    return min(found, key=lambda e: (round(found[e], 3), not e.lower().startswith(head), order[e]))


def with_all(found: dict[str, float], word: str, *tries: Trie) -> dict[str, float]:
    """``found`` and every entry of the tries within the word's limit."""
    out = dict(found)
    for trie in tries if word else ():
        for e, d in trie.within(word, limit(len(word))).items():
            out[e] = min(d, out.get(e, 99.0))
    return out


class Families:
    """Family names; the ending may be misread or cut off, so each entry is also reachable by its stem."""

    def __init__(self, rows: Iterable[tuple[str, str | None]]) -> None:
        self.full, self.stems, self.order = Trie(), Trie(), {}
        for family, alias in rows:
            self.order[family] = len(self.order)
            for spelling in filter(None, (family, alias)):
                p = plain(spelling)
                self.full.add(p, family)
                self.stems.add(self.stem(p), family)
                for end in FAMILY_ENDINGS:
                    if p.endswith(end) and len(p) - len(end) >= 5:
                        self.stems.add(p[: -len(end)], family)
                        break

    @staticmethod
    def stem(p: str) -> str:
        return re.sub(r"[aewxc#]+$", "", p)

    def resolve(self, value: str) -> str:
        return pick(self.likely(value), self.order, plain(re.sub(REMARK_BEFORE, "", value, flags=re.I))[:1]) or NONE

    @staticmethod
    def key(value: str) -> str:
        body = re.sub(REMARK_AFTER, "", re.sub(REMARK_BEFORE, "", value, flags=re.I))
        return plain(body) or plain(value)

    def candidates(self, value: str) -> dict[str, float]:
        """All entries within the distance that the value's length allows, and those it likely stands for, with their cost."""
        p = self.key(value)
        return with_all(self.likely(value), p if len(p) >= 4 else "", self.full)

    def likely(self, value: str) -> dict[str, float]:
        """The entries among which the value's is, with their cost, 0 for an exact spelling or stem; farther ones are not looked for."""
        p = self.key(value)
        if len(p) < 4:
            return {}
        s = self.stem(p)
        for hit in (self.full.exact(p), self.stems.exact(s)):
            if len(hit) == 1:
                return dict.fromkeys(hit, 0.0)
        # the ending as it mostly was before it was misread
        whole = re.sub(r"(?:e?ae|e?ew|ece|eac|ee|ex|ew|e|w|x)$", "eae", p)
        found = closest(self.full, p, limit(len(p))) or closest(self.full, whole, limit(len(whole)))
        if len(s) >= 5:
            for e, d in closest(self.stems, s, 1 if len(s) < 9 else 2).items():
                found[e] = min(d, found.get(e, 99.0))
        if not found and re.search(r"(\.|…)\s*$", value):
            hit = self.full.below(p)
            if len(hit) == 1 and len(p) >= 5:
                return dict.fromkeys(hit, 0.5)
        return found


class Dialects:
    """Dialect codes and names; a name may be cut to its first letters."""

    def __init__(self, rows: Iterable[tuple[str, str | None]]) -> None:
        self.codes, self.names, self.order = Trie(), Trie(), {}
        for code, name in rows:
            self.order[code] = len(self.order)
            self.codes.add(plain(code), code)
            if name:
                self.names.add(plain(name), code)

    def resolve(self, value: str) -> str:
        return pick(self.likely(value), self.order, plain(value)[:1]) or NONE

    @staticmethod
    def key(value: str) -> tuple[str, str]:
        """The value without what stands before it, and its letters."""
        body = re.sub(r"^[^\w«�]+", "", value)
        digits = body.translate(str.maketrans("01345", "oieas")) if len(body) < 3 else body
        return body, plain(digits)

    def candidates(self, value: str) -> dict[str, float]:
        """All codes and names within the distance that the value's length allows, and those it likely stands for, with their cost."""
        p = self.key(value)[1]
        return with_all(self.likely(value), p if re.search("[a-z]", p) else "", self.codes, self.names)

    def likely(self, value: str) -> dict[str, float]:
        """The entries among which the value's is, with their cost, 0 for an exact spelling; farther ones are not looked for."""
        body, p = self.key(value)
        if not re.search("[a-z]", p):
            return {}
        for hit in (self.codes.exact(p), self.names.exact(p)):
            if len(hit) == 1:
                return dict.fromkeys(hit, 0.0)
        if len(p) < 2:
            return {}
        if len(p) >= 4:
            hit = self.names.below(p)
            if len(hit) == 1:
                return dict.fromkeys(hit, 0.5)
        if len(p) == 2:
            return {e: d for e, d in self.codes.within(p, 1).items() if "#" in p and len(plain(e)) == 2}
        if len(p) < 5:
            # a code of two parts is only meant where the value shows two parts
            longest = 4 if re.search(r"\w[.\-\s]+\w", body) else 3
            return {e: d for e, d in self.codes.within(p, 1).items() if 1 < len(plain(e)) <= min(len(p), longest)}
        found = closest(self.names, p, 1 if len(p) < 6 else 2)
        for e, d in closest(self.codes, p, 1).items():
            if len(plain(e)) > 3:
                found[e] = min(d, found.get(e, 99.0))
        return found


MAX_REFERENCE_ROWS = 200_000


def resolve_values(values: DataFrame, reference: list[tuple[str, str | None]], resolver: type) -> DataFrame:
    """values(value) distinct -> (value, canonical).

    The reference list is read to the driver, so it is refused above
    MAX_REFERENCE_ROWS. Each Arrow batch is looked up in a trie built once per task.
    """
    if len(reference) > MAX_REFERENCE_ROWS:
        raise ValueError(f"the reference list has over {MAX_REFERENCE_ROWS} entries; partition it first")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = resolver(reference)
        for b in batches:
            yield pd.DataFrame({"value": b["value"], "canonical": [r.resolve(v) for v in b["value"]]}, dtype=object)

    # few values, each dear: spread them whatever their size in bytes
    values = values.repartition(values.sparkSession.sparkContext.defaultParallelism)
    return values.mapInPandas(look_up, "value string, canonical string")


def _reference(df: DataFrame, entry: str, alias: str, order: str) -> list[tuple[str, str | None]]:
    rows = df.select(entry, alias, order).where(F.col(entry).isNotNull()).orderBy(order).limit(MAX_REFERENCE_ROWS + 1).collect()
    return [(r[0], r[1]) for r in rows]


def map_values(rows: DataFrame, reference: list[tuple[str, str | None]], resolver: type) -> DataFrame:
    """rows(src_table, seq, pos, value) -> those not written exactly as listed, with canonical, `(none)` if unmatched.

    Only distinct values reach Python. Null values are no cases; an empty one stands for none.
    """
    listed = rows.sparkSession.createDataFrame([(r[0],) for r in reference], "value string").distinct()
    odd = rows.where(F.col("value").isNotNull()).join(listed, "value", "left_anti").dropDuplicates(["src_table", "seq", "pos"])
    known = resolve_values(odd.select("value").distinct(), reference, resolver)
    return odd.join(known, "value").select("src_table", "seq", "pos", "value", "canonical")


def odd_values(part1: DataFrame, part2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entered families and dialects as (src_table, seq, pos, value)."""
    f = part2.select(F.lit("part2_scientific").alias("src_table"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("pos"), F.col("family").alias("value"))
    d = part1.select(F.lit("part1_vernacular").alias("src_table"), F.col("seq").cast("long").alias("seq"), F.posexplode("dialects").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    return f, d


def canonical_values(part1: DataFrame, part2: DataFrame, families: DataFrame, dialects: DataFrame) -> DataFrame:
    """(src_table, seq, pos, value, canonical) of families and dialects that aren't written as listed.

    Null families, arrays and elements are no cases, an empty string stands for none; repeated deliveries count
    once; with an empty reference list everything stands for none; of equally near entries the one with the value's first
    letter, then the first listed, is taken. Other columns are ignored.
    """
    fam = _reference(families, "family", "also_known_as", "family_id")
    dia = _reference(dialects, "dialect_code", "dialect_name", "dialect_code")
    f, d = odd_values(part1, part2)
    return map_values(f, fam, Families).unionByName(map_values(d, dia, Dialects))


def p2_values(spark, sf_dir: str) -> DataFrame:
    return canonical_values(*(read(spark, sf_dir, t) for t in ("part1_vernacular", "part2_scientific", "ref_families", "ref_dialects")))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return p2_values(spark, sf_dir).select("src_table", "seq", "pos", "canonical")


def p2_unmatched(spark, sf_dir: str) -> DataFrame:
    """Values that stand for nothing listed, with how often they were entered."""
    v = p2_values(spark, sf_dir).where(F.col("canonical") == NONE)
    return v.groupBy("src_table", "value").agg(F.count("*").alias("n"))


def p2_candidates(spark, sf_dir: str) -> DataFrame:
    """Per value as entered, every listed entry within its distance, with the cost; the choice is made from the likely ones among them."""
    f, d = odd_values(read(spark, sf_dir, "part1_vernacular"), read(spark, sf_dir, "part2_scientific"))
    fam = _reference(read(spark, sf_dir, "ref_families"), "family", "also_known_as", "family_id")
    dia = _reference(read(spark, sf_dir, "ref_dialects"), "dialect_code", "dialect_name", "dialect_code")

    def listing(values: DataFrame, reference: list, resolver: type) -> DataFrame:
        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = resolver(reference)
            for b in batches:
                rows = [(t, v, e, float(c)) for t, v in zip(b["src_table"], b["value"]) for e, c in r.candidates(v).items()]
                yield pd.DataFrame(rows, columns=["src_table", "value", "candidate", "cost"])

        distinct = values.where(F.col("value").isNotNull()).select("src_table", "value").distinct()
        distinct = distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism)
        return distinct.mapInPandas(look_up, "src_table string, value string, candidate string, cost double")

    return listing(f, fam, Families).unionByName(listing(d, dia, Dialects))
