"""Evaluation texts leaking into training text: greedy string tiling of every document against the test items.

Seeds are runs of three tokens with equal Karp-Rabin hashes, joined with those of all items; each is extended to the
longest match that tolerates misread letters, split and joined words; the longest match is marked
as a tile, what is left of the others outside of it is searched again, and so on. The words covered by all tiles, in any
order, decide whether a document is looked at; it holds a passage if one tile
reaches ``min_words`` consecutive words of the item.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernalex.plans.lineage import cut
from vernalex.sources.tables import read

MIN_WORDS = 12
MIN_TILE = 4
COVERAGE = 0.5
# Items are looked up in blocks of at most so many letters, as a block travels to every task. One block is joined by broadcast; of several, a
# document meets only those that share a seed with it.
BLOCK_CHARS = 4_000_000
SEED, BASE, MOD = 3, 1_000_003, (1 << 61) - 1
# Bits of the filter that lets only words runs of items into the shuffled seed join; beyond it the filter gets less sharp, never wrong.
FILTER_BITS = 1 << 26

_JOIN = re.compile(r"(?<=\w)[-¬­]\s*\n\s*(?=\w)|[¬­]\s*")
_MARKS = re.compile(r"[^a-z]+")
_SPACES = str.maketrans(dict.fromkeys('.,;:?"-–—', " "))
LONG_TOKEN = 40


def _words(token: str) -> list[str]:
    t = token
    if not t.isascii():
        t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
    out = []
    for w in t.lower().translate(_SPACES).split():
        if w.isalnum() and w.isascii() and (w.isalpha() or w.isdigit()):
            out.append(w)
            continue
        w = _MARKS.sub("#", w.strip("'‘’“”!"))
        if w and w != "#":
            out.append(w)
    return out


class _Tokens(dict):
    """printed token -> its words; a bounded memory, as tokens recur."""

    def __missing__(self, token: str) -> list[str]:
        found = _words(token)
        if len(token) <= LONG_TOKEN:
            if len(self) > 1 << 17:
                self.clear()
            self[token] = found
        return found


_known_tokens = _Tokens()


def tokens(text: str | None) -> list[str]:
    """Lower-case words without accents; a mark inside a word stays as `#`, marks around it go."""
    if not text:
        return []
    return [w for ws in map(_known_tokens.__getitem__, _JOIN.sub("", text).split()) for w in ws]


# pairs of words recur across documents; the memory is bounded
@lru_cache(maxsize=1 << 17)
def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


@lru_cache(maxsize=1 << 18)
def same_word(a: str, b: str) -> bool:
    """Equal but for misread letters."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if n < 3:
        return len(a) == len(b) == 2 and ("#" in a) and (a[0] == b[0] or a[1] == b[1])
    return distance(a, b, 1 if n < 6 else 2 if n < 10 else 3) <= (1 if n < 6 else 2 if n < 10 else 3)


def _step(d: list[str], i: int, t: list[str], j: int, by: int) -> tuple[int, int] | None:
    """Words taken of the document and the item by the next match in direction ``by``, if any."""
    if not (0 <= i < len(d) and 0 <= j < len(t)):
        return None
    if same_word(d[i], t[j]):
        return 1, 1
    i2, j2 = i + by, j + by
    if d[i].isdigit() and not t[j].isdigit() and 0 <= i2 < len(d) and same_word(d[i2], t[j]):
        return 2, 1  # a page number between the lines
    if 0 <= i2 < len(d):
        two = d[i] + d[i2] if by > 0 else d[i2] + d[i]
        if len(t[j]) > 3 and same_word(two, t[j]):
            return 2, 1
        i3 = i2 + by
        if len(t[j]) > 5 and 0 <= i3 < len(d) and same_word(two + d[i3] if by > 0 else d[i3] + two, t[j]):
            return 3, 1
    if 0 <= j2 < len(t):
        two = t[j] + t[j2] if by > 0 else t[j2] + t[j]
        if len(d[i]) > 3 and same_word(d[i], two):
            return 1, 2
    return None


def _extend(d: list[str], i: int, t: list[str], j: int, by: int) -> list[tuple[int, int, int, int]]:
    """Steps (place and words in the document, place and words in the item) that match from (i, j) on; a single word read past recognition is bridged."""
    if not (0 <= i < len(d) and 0 <= j < len(t)):
        return []
    di = dj = 0
    steps: list[tuple[int, int, int, int]] = []
    firm = 0
    while True:
        a, b = i + by * di, j + by * dj
        s = _step(d, a, t, b, by)
        if s is None:
            if not (0 <= a < len(d) and 0 <= b < len(t)) or abs(len(d[a]) - len(t[b])) > 2 or "#" not in d[a] and distance(d[a], t[b], 9) > 0.6 * len(t[b]):
                break
            after = _step(d, a + by, t, b + by, by)
            if after is None or _step(d, a + by * (1 + after[0]), t, b + by * (1 + after[1]), by) is None:
                break
            s = (1, 1)
        n, m = s
        steps.append((a if by > 0 else a - n + 1, n, b if by > 0 else b - m + 1, m))
        di, dj = di + n, dj + m
        if (s == (1, 1) and d[a] == t[b]) or len(d[a]) > 3:
            firm = len(steps)
    return steps[:firm]


def _free_runs(steps: list[tuple[int, int, int, int]], in_doc: set[int], in_item: set[int]) -> Iterator[list[tuple[int, int, int, int]]]:
    """What is left of a match: its stretches whose words are unmarked on both sides."""
    run: list[tuple[int, int, int, int]] = []
    for s in steps:
        a, n, b, m = s
        if any(k in in_doc for k in range(a, a + n)) or any(k in in_item for k in range(b, b + m)):
            if run:
                yield run
            run = []
        else:
            run.append(s)
    if run:
        yield run


def mark_tiles(matches: list[list[tuple[int, int, int, int]]], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in the document, start in the item, item words), longest first, none overlapping.

    The longest match is marked; the others are cut to their unmarked words and compete again with what is left of them.
    """

    def entry(steps):
        return (-sum(m for *_, m in steps), steps[0][0], steps[0][2], steps)

    heap = [entry(s) for s in matches if s]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        size, a, b, steps = heapq.heappop(heap)
        if -size < least:
            break
        left = list(_free_runs(steps, in_doc, in_item))
        if len(left) != 1 or len(left[0]) != len(steps):
            for run in left:
                heapq.heappush(heap, entry(run))
            continue
        for x, n, y, m in steps:
            in_doc.update(range(x, x + n))
            in_item.update(range(y, y + m))
        tiles.append((a, b, -size))
    return tiles


class Items:
    """Tokens of the items and an index of all their seeds by rolling hash."""

    def __init__(self, rows: tuple[tuple[int, str], ...]) -> None:
        self.words = {i: tokens(t) for i, t in rows}
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            for k, h in rolling(w, SEED):
                self.index[h].append((i, k))
        self.vocabulary = {x for w in self.words.values() for x in w}

    def runs(self, d: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Stretches of the document that are words of items, long enough for a seed."""
        known = self.vocabulary.__contains__
        start = None
        for k, there in enumerate(map(known, d)):
            if there:
                if start is None:
                    start = k
            elif start is not None:
                if k - start >= SEED:
                    yield start, d[start:k]
                start = None
        if start is not None and len(d) - start >= SEED:
            yield start, d[start:]

    def matches(self, text: str | None) -> dict[int, list[list[tuple[int, int, int, int]]]]:
        """item -> all maximal matches with the document, each a list of steps."""
        d = tokens(text)
        found: dict[int, list[list[tuple[int, int, int, int]]]] = defaultdict(list)
        # item -> place in the document -> places of the item that a match already pairs with it
        reach: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for start, run in self.runs(d):
            for k, h in rolling(run, SEED):
                i = start + k
                for item, j in self.index.get(h, ()):
                    there = reach[item]
                    if i in there and any(abs(j - e) <= 3 for e in there[i]):
                        continue
                    t = self.words[item]
                    if d[i : i + SEED] != t[j : j + SEED]:
                        continue
                    steps = _extend(d, i - 1, t, j - 1, -1)[::-1]
                    steps += [(i + x, 1, j + x, 1) for x in range(SEED)]
                    steps += _extend(d, i + SEED, t, j + SEED, 1)
                    for a, n, b, m in steps:
                        for x in range(n):
                            there[a + x].append(b + x * m // n)
                    if len(steps) > SEED and sum(m for *_, m in steps) >= MIN_TILE:
                        found[item].append(steps)
        return found

    def tiles(self, text: str | None) -> dict[int, list[tuple[int, int, int]]]:
        return {item: mark_tiles(matches) for item, matches in self.matches(text).items()}


@lru_cache(maxsize=2)
def _items(rows: tuple[tuple[int, str], ...]) -> Items:
    return Items(rows)


@lru_cache(maxsize=1 << 17)
def _code(word: str) -> int:
    return zlib.crc32(word.encode()) << 29 ^ zlib.adler32(word.encode())


def rolling(words: list[str], size: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of each run of ``size`` words; the same in every process."""
    if len(words) < size:
        return
    codes = [_code(w) for w in words]
    top = pow(BASE, size - 1, MOD)
    h = 0
    for k, c in enumerate(codes):
        if k >= size:
            h -= codes[k - size] * top
        h = (h * BASE + c) % MOD
        if k >= size - 1:
            yield k - size + 1, h


def _seeds(table: DataFrame, key: str, kind: str, bits: bytes | None = None) -> DataFrame:
    """(key, seed) distinct seeds of each text; with ``bits`` only those the filter lets through."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = None if bits is None else np.frombuffer(bits, dtype=np.uint64)
        for b in batches:
            keys, seeds = [], []
            for k, text in zip(b[key], b["text"]):
                h = np.fromiter({h for _, h in rolling(tokens(text), SEED)}, dtype=np.int64)
                if there is not None:
                    at = (h % FILTER_BITS).astype(np.uint64)
                    h = h[(there[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
                keys += [k] * len(h)
                seeds += h.tolist()
            yield pd.DataFrame({key: keys, "seed": pd.Series(seeds, dtype="int64")})

    return table.mapInPandas(scan, f"{key} {kind}, seed long")


def _filter(seeds: DataFrame) -> bytes:
    """The bits of all seeds, at most FILTER_BITS of them whatever the number of items."""
    at = F.pmod(F.col("seed"), F.lit(FILTER_BITS))
    words = seeds.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(seed, 64) as int)))").alias("b"))
    out = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    t = words.toPandas()
    out[t["w"].to_numpy(dtype=np.int64)] = t["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out.tobytes()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, longest_tile, coverage, n_tiles) of all documents sharing a tile of 4 words or more with an item.

    Items of at most BLOCK_CHARS letters are joined by broadcast: one narrow pass over the documents, without any shuffle. More are
    cut into such blocks; then seeds of documents and items meet by their hash, and a document goes only to the blocks with which it shares
    one. Null or empty texts hold nothing; repeated documents each count.
    """
    given = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item_id long, doc_id long, longest_tile int, coverage double, n_tiles int"

    def against(docs: DataFrame, block: tuple[tuple[int, str], ...]) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _items(block)
            for b in batches:
                out = []
                for doc, text in zip(b["doc_id"], b["text"]):
                    for item, tiles in known.tiles(text).items():
                        n = sum(m for _, _, m in tiles)
                        out.append((item, doc, tiles[0][2], n / len(known.words[item]), len(tiles)))
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "longest_tile", "coverage", "n_tiles"])

        return docs.select("doc_id", "text").mapInPandas(scan, schema)

    size = given.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= BLOCK_CHARS:
        return against(docs, tuple((r["item_id"], r["text"]) for r in given.orderBy("item_id").collect()))
    # several blocks: a block's items are those of one hash, twice as many blocks as needed, so that none is much too large
    n = 2 * -(-size // BLOCK_CHARS)
    given = cut(given.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")))
    seeds = cut(_seeds(given, "block", "int").distinct())
    docs = cut(docs.where(F.length("text") > 0).withColumn("_row", F.monotonically_increasing_id()))
    asked = _seeds(docs.withColumnRenamed("_row", "row"), "row", "long", _filter(seeds))
    meet = asked.join(seeds, "seed").select(F.col("row").alias("_row"), "block").distinct()
    met = cut(docs.join(meet, "_row"), "block")
    out = None
    for k in range(n):
        block = tuple((r["item_id"], r["text"]) for r in given.where(F.col("block") == k).select("item_id", "text").orderBy("item_id").collect())
        if block:
            part = against(met.where(F.col("block") == k), block)
            out = part if out is None else out.unionByName(part)
    return out


def p6_leaks(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item, or cover half of it in any order, with the tiling's figures."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))
    return found.where((F.col("longest_tile") >= MIN_WORDS) | (F.col("coverage") >= COVERAGE))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover twelve words of an item or more, then exactly those where one tile reaches as many."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))
    return found.where(F.col("longest_tile") >= MIN_WORDS).select("item_id", "doc_id")


def p6_items(spark, sf_dir: str) -> DataFrame:
    """Per item that leaked: documents that hold it and the longest passage."""
    held = p6_leaks(spark, sf_dir)
    return held.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest_tile").alias("longest_tile"))
