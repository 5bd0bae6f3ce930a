"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernalex.plans.lineage import cut, small
from vernalex.sources.tables import read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public split pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bins of the drawing order: fine near 0, where most uses are drawn, and open at the end, so that any document can be drawn.
BINS = 4096
# Raking ends once every goal that can be reached is met to this share of all tokens, or after so many rounds.
TOLERANCE, MAX_ROUNDS = 0.002, 25
MAX_SOURCES = 100_000
NOT_GIVEN = "(none)"


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(text, path: str = TOKENIZER):
    """Column: tokens of each text; a null text has none."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def source_key(c) -> Column:
    """Sources are often written otherwise: case, outer blanks, blanks or underscores for hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "-")


def _rake(cells: DataFrame, by: str, goal: DataFrame) -> DataFrame:
    """Scale w so that sum(tokens·w) per ``by`` reaches the goal(by, want); groups without a goal or tokens stay."""
    now = cells.groupBy(by).agg(F.sum(F.col("tokens") * F.col("w")).alias("_now"))
    f = now.join(goal, by).select(by, F.when(F.col("_now") > 0, F.col("want") / F.col("_now")).otherwise(1.0).alias("_f"))
    return cells.join(f, by, "left").withColumn("w", F.least(F.col("w") * F.coalesce("_f", F.lit(1.0)), F.col("cap"))).drop("_f")


def fit_weights(cells: DataFrame, share: DataFrame, tolerance: float = TOLERANCE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """cells(source, lang, topic, tokens, cap) -> w, the expected uses of each document of a cell.

    Rakes in turn to topic, language and source until no goal is missed by more than ``tolerance`` of all tokens, or until a round brings nothing more
    (caps can make goals unreachable together); the topic and language goals are their shares of the listed text. No weight exceeds its source's
    cap; the source goal comes last, and is filled, so that what capped cells can't give goes to the others of the source. Rounds are written
    tables; a goal missed by less than the tolerance stays a little off, and what remains is reported by ``p7_marginals``. share(source, want): tokens wanted of each source.
    """
    total = share.agg(F.sum("want").alias("_all"))
    have = cells.agg(F.sum("tokens").alias("_have"))
    goals = {"source": share}
    for by in ("topic", "lang"):
        goals[by] = cut(cells.groupBy(by).agg(F.sum("tokens").alias("_t")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(have)).select(by, (F.col("_t") / F.col("_have") * F.col("_all")).alias("want")))
    first = cells.groupBy("source").agg(F.sum("tokens").alias("_t")).join(share, "source").select("source", (F.col("want") / F.col("_t")).alias("w"))
    cells = cut(cells.join(F.broadcast(first), "source").withColumn("w", F.least("w", "cap")))
    size = total.first()["_all"] or 0.0
    last = float("inf")
    for _ in range(rounds):
        for by in ("topic", "lang", "source"):
            cells = _rake(cells, by, goals[by])
        cells = cut(_fill(cells, share))
        missed = max((_missed(cells, by, goals[by]) for by in goals), default=0.0)
        if missed <= tolerance * size or missed > 0.98 * last:
            break
        last = missed
    return cut(_fill(_fill(cells, share), share))


def _missed(cells: DataFrame, by: str, goal: DataFrame) -> float:
    """Tokens by which the goal that is missed most is missed."""
    now = cells.groupBy(by).agg(F.sum(F.col("tokens") * F.col("w")).alias("_now"))
    return now.join(goal, by).agg(F.max(F.abs(F.col("_now") - F.col("want")))).first()[0] or 0.0


def _fill(cells: DataFrame, share: DataFrame) -> DataFrame:
    """Give what a source still lacks to its cells below the cap, in proportion."""
    full = F.col("w") >= F.col("cap")
    use = F.col("tokens") * F.col("w")
    s = cells.groupBy("source").agg(F.sum(use).alias("_now"), F.sum(F.when(~full, use)).alias("_free")).join(share, "source")
    f = s.select("source", F.when(F.col("_free") > 0, 1 + (F.col("want") - F.col("_now")) / F.col("_free")).otherwise(1.0).alias("_f"))
    return cells.join(F.broadcast(f), "source").withColumn("w", F.when(full, F.col("cap")).otherwise(F.least(F.col("w") * F.greatest("_f", F.lit(0.0)), F.col("cap")))).drop("_f")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uses, shares, marginals).

    uses: doc_id, source, lang, topic, n_tokens, n_repeats >= 1. marginals: the share of each language and topic in the listed
    text, which the weights are raked to, beside the one reached. shares: per source of the targets the wanted and reached share.
    Without ``total_tokens`` the size is the largest at which every source that has text can reach its
    share within its cap. A source without text can't; its share falls to the others in
    proportion and it is reported with 0. Documents of unlisted sources, without a source or
    without tokens aren't used; a null max_repeats counts as 1; targets with a null or no share want nothing.
    """
    goal = targets.groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("double").alias("cap"))
    goal = cut(goal.where(F.col("source").isNotNull()))
    # everything broadcast below has at most a row per source of the targets
    if goal.count() > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} target sources")
    d = documents.select("doc_id", source_key("source").alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit(NOT_GIVEN)).alias("lang"), F.coalesce(F.trim("genus"), F.lit(NOT_GIVEN)).alias("topic"), "text")
    d = d.join(F.broadcast(goal), "source").withColumn("n_tokens", token_counts("text")).drop("text").where(F.col("n_tokens") > 0)
    d = cut(d)
    have = goal.join(d.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_available")), "source", "left").na.fill(0, ["available", "n_available"])
    live = have.where((F.col("available") > 0) & (F.col("target_share") > 0))
    size = live.agg(F.sum("target_share").alias("_s"), F.min(F.col("available") * F.col("cap") / F.col("target_share")).alias("_t"))
    size = size.select("_s", (F.lit(float(total_tokens)) if total_tokens else F.col("_t") * F.col("_s")).alias("_size"))
    share = cut(live.crossJoin(F.broadcast(size)).select("source", F.least(F.col("target_share") / F.col("_s") * F.col("_size"), F.col("available") * F.col("cap")).alias("want")))
    keys = ["source", "lang", "topic"]
    cells = cut(d.join(F.broadcast(share.select("source")), "source", "left_semi").groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.max("cap").alias("cap")))
    w = fit_weights(cells, share).select(*keys, "w")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    # one row a cell: with a third of the documents in one cell its key must not lie in one task
    docs = d.join(small(w), keys).withColumns({"_base": F.floor(F.col("w") + 1e-9), "_u": u})
    docs = docs.withColumn("_part", F.greatest(F.col("w") - F.col("_base"), F.lit(0.0)))
    ratio = F.when(F.col("_part") > 1e-9, F.col("_u") / F.col("_part"))
    docs = docs.withColumn("_bin", F.floor(ratio / (1 + ratio) * BINS))
    docs = cut(docs.select("doc_id", *keys, "n_tokens", "_base", "_bin"))
    # per source, the bin up to which the fractional uses are drawn, so that the sum meets the goal
    base = docs.groupBy("source").agg(F.sum(F.col("_base") * F.col("n_tokens")).alias("_fixed"))
    run = Window.partitionBy("source").orderBy("_bin")
    bins = docs.where(F.col("_bin").isNotNull()).groupBy("source", "_bin").agg(F.sum("n_tokens").alias("_n")).withColumn("_run", F.sum("_n").over(run))
    bins = bins.join(F.broadcast(base.join(share, "source")), "source")
    upto = bins.where(F.col("_fixed") + F.col("_run") - F.col("_n") / 2 <= F.col("want")).groupBy("source").agg(F.max("_bin").alias("_upto"))
    uses = docs.join(F.broadcast(upto), "source", "left").withColumn("n_repeats", (F.col("_base") + F.when(F.col("_bin") <= F.col("_upto"), 1).otherwise(0)).cast("int"))
    uses = cut(uses.where(F.col("n_repeats") > 0).select("doc_id", *keys, "n_tokens", "n_repeats"))
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("tokens"), F.count("*").alias("n_documents"), F.max("n_repeats").alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("_all"))
    shares = (
        have.join(got, "source", "left")
        .na.fill(0, ["tokens", "n_documents", "most_repeats"])
        .crossJoin(F.broadcast(whole))
        .select("source", "target_share", (F.col("tokens") / F.col("_all")).alias("actual_share"), "tokens", "n_documents", "most_repeats", F.col("cap").cast("int").alias("max_repeats"), F.col("available").alias("available_tokens"))
    )
    parts = []
    for by in ("lang", "topic"):
        there = cells.groupBy(F.col(by).alias("value")).agg(F.sum("tokens").alias("available_tokens"))
        reached = uses.groupBy(F.col(by).alias("value")).agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("tokens"))
        parts.append(there.join(reached, "value", "left").na.fill(0, ["tokens"]).select(F.lit(by).alias("marginal"), "value", "available_tokens", "tokens"))
    every = cells.agg(F.sum("tokens").alias("_have")).crossJoin(F.broadcast(whole))
    marginals = parts[0].unionByName(parts[1]).crossJoin(F.broadcast(every))
    marginals = marginals.select("marginal", "value", (F.col("available_tokens") / F.col("_have")).alias("wanted_share"), (F.col("tokens") / F.col("_all")).alias("actual_share"))
    return uses, shares, marginals


def p7_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def p7_marginals(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[2]
