"""Queries and SQL of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vernalex.llm import abuse, canonical, groups, leakage, linking, mixing, noise
from vernalex.sources.tables import read


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linking.match_entries(read(spark, sf_dir, "part1_vernacular"), read(spark, sf_dir, "part2_scientific"))
    return pairs.select("part1_seq", "part2_seq")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.match_with_confidence(*(read(spark, sf_dir, t) for t in ("part1_vernacular", "part2_scientific", "match_pairs")))


def queries() -> dict:
    return {
        "p1_found": noise.p1_found,
        "p1_repaired": noise.p1_repaired,
        "p2_found": canonical.p2_found,
        "p2_unmatched": canonical.p2_unmatched,
        "p2_candidates": canonical.p2_candidates,
        "p3_found": p3_found,
        "p3_links": p3_links,
        "p5_found": groups.p5_found,
        "p5_group_sizes": groups.p5_group_sizes,
        "p6_found": leakage.p6_found,
        "p6_leaks": leakage.p6_leaks,
        "p6_items": leakage.p6_items,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p7_marginals": mixing.p7_marginals,
        "p8_found": abuse.p8_found,
        "p8_scores": abuse.p8_scores,
        "p8_rates": abuse.p8_rates,
    }


P5 = """
with recursive e as (
  select left_seq a, right_seq b from match_pairs where is_match and left_seq is not null and right_seq is not null
  union select right_seq, left_seq from match_pairs where is_match and left_seq is not null and right_seq is not null),
reach(id, other) as (select a, a from e union select r.id, e.b from reach r join e on e.a = r.other),
g as (select id record_id, min(other) group_id from reach group by id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": P5 + "select group_id, record_id from g",
        "p5_group_sizes": P5 + ", s as (select group_id, count(*) n_records from g group by 1) select n_records, count(*) n_groups from s group by 1",
    }
