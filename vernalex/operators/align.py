"""Alignment of two ordered lists: similarity of strings in order, monotone alignment with gaps, grouped by page."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GAP = -0.4


@lru_cache(maxsize=1 << 16)
def folded(text: str) -> str:
    """Small letters and digits without accents; all else is gone."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.lower()) if ch.isascii() and ch.isalnum())


def ordered_similarity(a: str, b: str) -> float:
    """Twice the letters met in order over both lengths, of folded texts; 0 if either has none.

    Letter by letter from the front: equal ones count and both go; of unequal ones that of the text goes of which more is left, of ``b`` if as much.
    """
    left, right = list(reversed(folded(a))), list(reversed(folded(b)))
    both = len(left) + len(right)
    if not left or not right:
        return 0.0
    met = 0
    while left and right:
        if left[-1] == right[-1]:
            met += 1
            left.pop()
            right.pop()
        else:
            (left if len(left) > len(right) else right).pop()
    return 2 * met / both


def prefix_similarity(text: str, line: str) -> float:
    """Similarity of a line to as much of the text as the line is long; symmetric below six letters."""
    s, t = folded(text), folded(line)
    return ordered_similarity(s[: len(t)] if len(t) >= 6 else s, t)


def align(a: list, b: list, score: Callable[[object, object], float], gap: float = GAP) -> list[tuple[int | None, int | None]]:
    """Global monotone alignment of two lists as index pairs, None where one has a gap; ties prefer a pair, then a gap in ``b``."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1))
    step = np.zeros((n + 1, m + 1), dtype=np.int8)
    best[:, 0], best[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    step[1:, 0], step[0, 1:] = 1, 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (best[i - 1, j - 1] + score(a[i - 1], b[j - 1]), best[i - 1, j] + gap, best[i, j - 1] + gap)
            k = max(range(3), key=lambda o: (options[o], -o))
            best[i, j], step[i, j] = options[k], k
    out, i, j = [], n, m
    while i or j:
        k = step[i, j]
        if k == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif k == 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def align_pages(left: DataFrame, right: DataFrame, page: list[str], order: str, text: str) -> DataFrame:
    """(page, left_order, right_order, similarity) of two ordered tables, aligned page by page.

    Pages are cogrouped, so a task holds one page of either side; a page of one side only aligns to gaps; null texts count as empty.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema if f.name in page) + f", left_{order} long, right_{order} long, similarity double"

    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order), b.sort_values(order)
        s, t = [x or "" for x in a[text]], [x or "" for x in b[text]]
        ao, bo = list(a[order]), list(b[order])
        rows = [
            (*key, None if i is None else ao[i], None if j is None else bo[j], None if i is None or j is None else ordered_similarity(s[i], t[j]))
            for i, j in align(s, t, ordered_similarity)
        ]
        out = pd.DataFrame(rows, columns=[*page, f"left_{order}", f"right_{order}", "similarity"])
        return out.astype({f"left_{order}": "Int64", f"right_{order}": "Int64"})

    keep = [*page, order, text]
    # new column identities, as both sides may come from one table
    a, b = left.select(*keep).toDF(*keep), right.select(*keep).toDF(*keep)
    return a.groupBy(*page).cogroup(b.groupBy(*page)).applyInPandas(both, schema)


def locate(entries: DataFrame, lines: DataFrame, page: list[str], order: str, text: str, span: bool = False, floor: float = 0.5, stop=None) -> DataFrame:
    """(page, order, first_line, last_line): where each entry stands among the lines of its page.

    Entries and lines (page, order, text) are aligned page by page by how well a line begins an entry; pairs
    under ``floor`` are left out. With ``span`` an entry runs on to before the next located one, or to a line for which ``stop`` is true.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema if f.name in page) + f", {order} long, first_line long, last_line long"

    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order), b.sort_values(order)
        s, t = [x or "" for x in a[text]], [x or "" for x in b[text]]
        ao, bo = list(a[order]), list(b[order])
        starts = [(i, j) for i, j in align(s, t, prefix_similarity) if i is not None and j is not None and prefix_similarity(s[i], t[j]) >= floor]
        rows = []
        for k, (i, j) in enumerate(starts):
            last = j
            if span:
                limit = starts[k + 1][1] - 1 if k + 1 < len(starts) else len(t) - 1
                while last < limit and not (stop and stop(t[last + 1])):
                    last += 1
            rows.append((*key, ao[i], bo[j], bo[last]))
        return pd.DataFrame(rows, columns=[*page, order, "first_line", "last_line"])

    keep = [*page, order, text]
    a, b = entries.select(*keep).toDF(*keep), lines.select(*keep).toDF(*keep)
    return a.groupBy(*page).cogroup(b.groupBy(*page)).applyInPandas(both, schema)
