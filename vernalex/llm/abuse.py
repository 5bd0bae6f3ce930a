"""Abusive, hateful or sexual content by compression distance.

Two zstandard dictionaries are trained, on abusive and on ordinary windows of
text. A window is judged by the share of its bytes that the abusive dictionary saves over the
ordinary one; a document's score is that of its worst window; the threshold is calibrated on
held-out documents. Only labels of whole documents exist, some of them wrong, so the windows to train on are
found by compression as well: a window of an abusive document is abusive if dictionaries of several other abusive
documents shorten it and those of ordinary documents, but for a few wrong labels, don't.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernalex.plans.lineage import cut
from vernalex.sources.tables import read

# Labelled documents and letters of their texts used for training and calibration at most, in the order of a hash of doc_id.
# The dictionaries hold whatever these give, uncut.
MAX_LABELLED = 4_000
MAX_CHARS = 8_000_000
LEVEL = 13
WINDOW, STRIDE, LONGEST, LONG_WORD = 12, 6, 18, 48
# Parts that the documents of either kind are split into to judge windows, and folds for held-out scores.
PARTS, ABUSIVE_FOLDS, ORDINARY_FOLDS = 12, 16, 4
# A part knows a window if its dictionary leaves at most this share of it; ordinary parts that may know an abusive window (wrong labels);
# how many times as common it must be among abusive documents.
KNOWN, WRONG, ODDS = 0.62, 2, 4.0
# Bytes that any frame takes, and those that shorter windows are reckoned longer by.
FRAME, EVEN = 6, 20

# Characters used to disguise letters.
DISGUISE = str.maketrans("0134578@$€!|†", "oieastbaseilt", "*")
MASKS = frozenset("0134578@$€!|†*")
OUTER = "\"'()[],;:.?!…“”‘’"

_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*][^\W_]){2,}(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_BREAK = re.compile(r"[-¬­‐]\s*\n\s*")
_PARAGRAPH = re.compile(r"\n\s*\n")
_END = re.compile(r"[.!?…。！？][\"'’”)\]]*$")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Letters of any script in small print without accents, blanks for all else."""
    if not text.isascii():
        text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return _OTHER.sub(" ", text.casefold()).strip()


def undisguised(token: str) -> str:
    """The words of one printed token, disguises undone: l33t, s.t.o.p.p.e.d, streeetched, st*rred."""
    t = token
    if not token.isalpha():
        t = _SPELLED.sub(lambda m: re.sub(r"[.\-_*]", "", m.group(0)), t)
        core = t.strip(OUTER)
        if not MASKS.isdisjoint(core) and any(map(str.isalpha, core)):
            t = core.translate(DISGUISE)
    t = _STRETCHED.sub(r"\1", plain(t))
    if len(t) <= LONG_WORD:
        return t
    return " ".join(w[k : k + LONG_WORD // 2] for w in t.split() for k in range(0, len(w), LONG_WORD // 2))


class Words(dict):
    """token -> (its words, whether it ends a sentence, whether it is a single letter); a bounded memory, as tokens recur."""

    def __missing__(self, token: str) -> tuple[str, bool, bool]:
        t = undisguised(token)
        # Mr. and the like end nothing
        ends = bool(_END.search(token)) and not (len(t) < 4 and token.endswith(".") and token[:1].isupper())
        found = (t, ends, len(t) == 1)
        if len(token) <= LONG_WORD:
            if len(self) > 1 << 17:
                self.clear()
            self[token] = found
        return found


_known_tokens = Words()


def normal(text: str) -> str:
    """All words of a text, disguises undone, also words s p e l l e d by blanks."""
    return " ".join(windows(text))


def windows(text: str | None) -> list[str]:
    """Normalised sentences; a long one in overlapping windows. Texts without a letter have none."""
    out: list[str] = []

    def close(words: list[str], single: int) -> None:
        if single >= 3:
            words[-single:] = ["".join(words[-single:])]
        w = " ".join(words).split()
        if len(w) <= LONGEST:
            out.append(" ".join(w))
        else:
            out.extend(" ".join(w[k : k + WINDOW]) for k in range(0, len(w) - WINDOW + STRIDE, STRIDE))

    if not text:
        return out
    for paragraph in _PARAGRAPH.split(_BREAK.sub("", text)) if "\n" in text else (text,):
        words: list[str] = []
        single = 0
        for t, ends, letter in map(_known_tokens.__getitem__, paragraph.split()):
            if letter:
                single += 1
            else:
                if single >= 3:
                    words[-single:] = ["".join(words[-single:])]
                single = 0
            if t:
                words.append(t)
            if ends and words:
                close(words, single)
                words, single = [], 0
        if words:
            close(words, single)
    return out


@lru_cache(maxsize=4)
def compressor(raw: bytes):
    """bytes -> compressed bytes with the dictionary as history."""
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=max(17, len(raw).bit_length() + 1))
    d = zstandard.ZstdCompressionDict(raw or b"\n" * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress


def framed(window: str) -> bytes:
    return (" " + window + " ").encode()


def train(samples: list[str]) -> bytes:
    """A raw-content dictionary of the distinct samples, the most frequent last, where they are cheapest to refer to."""
    count: dict[str, int] = {}
    for w in samples:
        count[w] = count.get(w, 0) + 1
    order = sorted(count, key=lambda w: (count[w], zlib.crc32(w.encode())))
    return b"".join(map(framed, order))


class Distance:
    """Share of a window's bytes that the abusive dictionary saves over the ordinary one."""

    def __init__(self, abusive: bytes, ordinary: bytes) -> None:
        self.abusive, self.ordinary = compressor(abusive), compressor(ordinary)

    def gain(self, window: str) -> float:
        b = framed(window)
        return (len(self.ordinary(b)) - len(self.abusive(b))) / (len(b) + EVEN)


@dataclass
class Model:
    abusive: bytes
    ordinary: bytes
    threshold: float
    f1: float
    n_labelled: int


def _part(doc: int, n: int) -> int:
    return (zlib.crc32(str(doc).encode()) >> 8) % n


class Evidence:
    """Judges windows by how many parts of the abusive and of the ordinary documents know them; a document's own part has no say."""

    def __init__(self, abusive: list[tuple[int, str]], ordinary: list[tuple[int, str]], n_abusive: int, n_ordinary: int) -> None:
        self.abusive, self.ordinary = self._parts(abusive), self._parts(ordinary)
        self.need = ODDS * n_abusive / n_ordinary

    @staticmethod
    def _parts(rows: list[tuple[int, str]]) -> list:
        each: list[list[str]] = [[] for _ in range(PARTS)]
        for d, w in rows:
            each[_part(d, PARTS)].append(w)
        return [compressor(train(ws)) for ws in each]

    @staticmethod
    def _knowing(parts: list, b: bytes, own: int | None, most: int = PARTS) -> int:
        n = 0
        for k, c in enumerate(parts):
            if k != own and len(c(b)) - FRAME <= KNOWN * len(b):
                n += 1
                if n > most:
                    break
        return n

    def is_abusive(self, doc: int, window: str, label: int) -> bool:
        b, own = framed(window), _part(doc, PARTS)
        if len(b) < 2 * FRAME:
            return False
        ordinary = self._knowing(self.ordinary, b, None if label else own, WRONG)
        if ordinary > WRONG:
            return False
        return self._knowing(self.abusive, b, own if label else None) >= max(1.0, self.need * (ordinary + 1))


def fit(labelled: list[tuple[int, str | None, int]]) -> Model:
    """labelled: (doc_id, text, 0 or 1). Without a label of either kind nothing is ever flagged.

    Windows that the evidence calls abusive train the abusive dictionary if their document is labelled so, and train nothing if it isn't
    (a wrong label); all other windows of ordinary documents train the ordinary one. A document's held-out score comes
    from dictionaries without its part.
    """
    docs = [(d, windows(t), y) for d, t, y in labelled]
    of = {kind: [(d, w) for d, ws, y in docs if y == kind for w in ws] for kind in (0, 1)}
    if not of[0] or not of[1]:
        return Model(b"", b"", float("inf"), 0.0, len(docs))
    n_abusive = sum(y for _, _, y in docs)
    evidence = Evidence(of[1], of[0], n_abusive, len(docs) - n_abusive)
    bad = [(d, w) for d, w in of[1] if evidence.is_abusive(d, w, 1)]
    plain_ones = [(d, w) for d, w in of[0] if not evidence.is_abusive(d, w, 0)]
    abusive, ordinary = train([w for _, w in bad]), train([w for _, w in plain_ones])
    scores: dict[int, float] = {}
    for kind, folds in ((1, ABUSIVE_FOLDS), (0, ORDINARY_FOLDS)):
        for k in range(folds):
            # the other kind's dictionary never held the document
            a = train([w for d, w in bad if _part(d, folds) != k]) if kind else abusive
            o = ordinary if kind else train([w for d, w in plain_ones if _part(d, folds) != k])
            dist = Distance(a, o)
            for d, w in of[kind]:
                if _part(d, folds) == k:
                    scores[d] = max(dist.gain(w), scores.get(d, -1.0))
    threshold, f1 = calibrate([(scores.get(d, -1.0), y) for d, _, y in docs])
    return Model(abusive, ordinary, threshold, f1, len(docs))


def calibrate(scores: list[tuple[float, int]]) -> tuple[float, float]:
    """The middle of the thresholds whose F1 is within half a point of the best, from the next lower score on."""
    n = sum(y for _, y in scores)
    at = sorted({s for s, _ in scores})
    tried = []
    for before, t in zip([0.0, *at], at):
        if t > 0:
            hit = sum(y for s, y in scores if s >= t)
            said = sum(1 for s, _ in scores if s >= t)
            tried.append((2 * hit / (said + n), max(before, 0.0), t))
    if not tried:
        return float("inf"), 0.0
    best = max(tried)[0]
    good = [(before, t) for f, before, t in tried if f >= best - 0.005]
    return (good[0][0] + good[-1][1]) / 2, best


def training_rows(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, chars: int = MAX_CHARS) -> list[tuple[int, str | None, int]]:
    """At most ``bound`` labelled documents by majority of their reviewers, of at most ``chars`` letters together; ties and null opinions are left out.

    A text too long for what is left of ``chars`` is passed over.
    """
    vote = labels.where(F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.sum(F.when(F.col("abusive") == 1, 1).otherwise(-1)).alias("v"))
    vote = vote.where(F.col("v") != 0).select("doc_id", F.when(F.col("v") > 0, 1).otherwise(0).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = cut(documents.select("doc_id", "text").join(F.broadcast(vote), "doc_id"))
    taken, left = [], chars
    for r in rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left:
            taken.append(r["doc_id"])
            left -= r["n"]
    chosen = rows.sparkSession.createDataFrame([(d,) for d in taken], "doc_id long")
    return sorted((r["doc_id"], r["text"], r["y"]) for r in rows.join(F.broadcast(chosen), "doc_id", "left_semi").collect())


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with abuse_score (share of bytes gained by the worst window) and abusive; other columns stay.

    A null or empty text scores null and is not abusive. One narrow pass over whole texts; the model, no larger than MAX_CHARS letters, travels with the task.
    """
    names = {"abuse_score", "abusive"} & set(documents.columns)
    docs = documents.drop(*names)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # sentences recur across documents; a bounded memory of them saves compressing
        gain = lru_cache(maxsize=1 << 16)(Distance(model.abusive, model.ordinary).gain)
        for b in batches:
            yield pd.Series([max(map(gain, windows(t)), default=None) for t in b], dtype="Float64")

    rated = F.pandas_udf(rate, "double")
    out = docs.withColumn("abuse_score", rated("text"))
    return out.withColumn("abusive", F.coalesce(F.col("abuse_score") >= F.lit(model.threshold), F.lit(False)))


def scored_documents(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    model = fit(training_rows(documents, labels))
    return score(documents.select("doc_id", "text", *keep), model)


def p8_scores(spark, sf_dir: str) -> DataFrame:
    s = scored_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_labels"))
    return s.select("doc_id", "abuse_score", "abusive")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("abusive").select("doc_id")


def p8_rates(spark, sf_dir: str) -> DataFrame:
    """Share of abusive documents per source; null and blank sources together as null."""
    s = scored_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_labels"), ("source",))
    source = F.nullif(F.regexp_replace(F.lower(F.trim("source")), r"[\s_]+", "-"), F.lit(""))
    return s.groupBy(source.alias("source")).agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive")).withColumn("rate", F.col("n_abusive") / F.col("n_documents"))
