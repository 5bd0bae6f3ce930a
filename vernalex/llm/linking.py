"""Matching entities across sources without a common key: a cascade of exact joins on ever weaker attributes.

Pass by pass (see ``operators.taxa.resolve_names`` for the first four):
exact name, near name, name with an initial, near genus, then for citations
without a full epithet the native name: `vernacular` (phonetic key, genus if
given) and `vernacular-near` (one edit, two in ten letters or more, an end of three letters alike). A later pass only sees what the passes
before it left. Each rule's confidence is its precision on labelled pairs, smoothed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import delete_one
from vernalex.operators.taxa import citations, plants, resolve_names, scientific_entries, vernacular_key
from vernalex.plans.lineage import cut, shuffled
from vernalex.sources.tables import first_deliveries

ANY = "*"
# Strongest first.
RULES = ("exact", "genus", "near", "initial", "genus-near", "vernacular", "vernacular-near")


def _vernacular_table(part2: DataFrame, members: DataFrame) -> DataFrame:
    """(volume_id, vkey, genus, p_min, p_max): plants with that native name, by genus. Second deliveries change nothing here."""
    named = part2.where(F.size("vernaculars") > 0).select("seq", F.explode("vernaculars").alias("_v")).select(F.col("seq").alias("part2_seq"), vernacular_key("_v.name").alias("vkey"))
    named = named.where(F.length("vkey") > 0).join(shuffled(members), "part2_seq")
    return named.groupBy("volume_id", "vkey", "genus").agg(F.min("plant_id").alias("p_min"), F.max("plant_id").alias("p_max"))


def _genus_of(wanted: DataFrame, spelled: DataFrame) -> DataFrame:
    """wanted genus -> the volume's genus, exactly or within one edit of only one (volume_id, genus, _genus)."""
    asked = wanted.select("volume_id", "genus").where(F.col("genus") != ANY).distinct()
    have = spelled.select("volume_id", F.col("genus").alias("_genus")).distinct()
    pairs = asked.withColumn("_v", F.explode(delete_one("genus"))).join(shuffled(have.withColumn("_v", F.explode(delete_one("_genus")))), ["volume_id", "_v"])
    pairs = pairs.withColumn("_d", F.expr("levenshtein(genus, _genus, 1)")).where(F.col("_d") >= 0)
    best = pairs.groupBy("volume_id", "genus", "_d").agg(F.min("_genus").alias("_genus"), F.max("_genus").alias("_g2"))
    best = best.groupBy("volume_id", "genus").agg(F.min_by(F.struct("_genus", "_g2"), "_d").alias("b"))
    return best.where(F.col("b._genus") == F.col("b._g2")).select("volume_id", "genus", F.col("b._genus").alias("_genus"))


def _by_vernacular(refs: DataFrame, table: DataFrame, spelled: DataFrame) -> DataFrame:
    """refs: volume_id, genus (`*`: none given), vkey -> plant_id, rule, where one plant has the name."""
    keys = ["volume_id", "genus", "vkey"]
    asked = refs.select(*keys).distinct()
    known = _genus_of(asked, spelled)
    asked = asked.join(shuffled(known), ["volume_id", "genus"], "left").withColumn("_genus", F.when(F.col("genus") == ANY, ANY).otherwise(F.col("_genus"))).where(F.col("_genus").isNotNull())
    asked = cut(asked)
    t = cut(table.withColumnRenamed("genus", "_of"))
    fits = (F.col("_genus") == ANY) | (F.col("_genus") == F.col("_of"))

    def only(hits: DataFrame, rule: str) -> DataFrame:
        g = hits.where(fits).groupBy(*keys).agg(F.min("p_min").alias("plant_id"), F.max("p_max").alias("_p2"))
        return g.select(*keys, "plant_id", (F.col("plant_id") == F.col("_p2")).alias("_one"), F.lit(rule).alias("rule"))

    same = cut(only(asked.join(shuffled(t), ["volume_id", "vkey"]), "vernacular"))
    ends = F.array(F.concat(F.lit("^"), F.left("vkey", F.lit(3))), F.concat(F.right("vkey", F.lit(3)), F.lit("$")))
    rest = asked.join(shuffled(same.select(*keys)), keys, "left_anti").where(F.length("vkey") >= 6).withColumn("_v", F.explode(ends))
    near = t.where(F.length("vkey") >= 5).select("volume_id", "_of", F.col("vkey").alias("_k"), "p_min", "p_max", F.explode(ends).alias("_v"))
    found = only(rest.join(shuffled(near), ["volume_id", "_v"]).where(F.expr("levenshtein(vkey, _k, if(length(vkey) >= 10, 2, 1)) >= 0")), "vernacular-near")
    return same.unionByName(found).where("_one").drop("_one")


def cascade(part1: DataFrame, part2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part1_seq, plant_id, rule) and the entries (plant_id, part2_seq, volume_id, genus) of each plant.

    Null or empty taxa fall to the native-name passes; a null headword then
    cites nothing; second deliveries count once.
    """
    entries = scientific_entries(part2)
    spelled = plants(entries)
    p1 = first_deliveries(part1, "seq", "volume_id", "taxa", "headword")
    c = cut(citations(p1, "seq", keep=("volume_id", "headword")).select("seq", "volume_id", "genus", F.coalesce("epithet", F.lit("")).alias("epithet"), "kind", F.when(F.col("kind").isin("partial", "none"), vernacular_key("headword")).alias("vkey")))
    named = c.where(F.col("kind").isin("full", "genus")).select("seq", "volume_id", "genus", "epithet")
    resolved = resolve_names(named, spelled)
    by_name = named.join(shuffled(resolved), ["volume_id", "genus", "epithet"]).select("seq", "plant_id", F.when((F.col("epithet") == "") & (F.col("rule") == "exact"), "genus").otherwise(F.col("rule")).alias("rule"))
    partial = c.where("kind = 'partial'").select("seq", "volume_id", "genus", "vkey")
    illegible = c.where("kind = 'none'").select("seq", "volume_id", F.lit(ANY).alias("genus"), "vkey").distinct()
    bare = p1.where(F.coalesce(F.size("taxa"), F.lit(0)) <= 0).select("seq", "volume_id", F.lit(ANY).alias("genus"), vernacular_key("headword").alias("vkey"))
    asked = cut(partial.unionByName(illegible).unionByName(bare).where(F.length("vkey") > 0))
    members = cut(entries.join(shuffled(spelled), ["volume_id", "genus", "epithet"]).select("plant_id", F.col("seq").alias("part2_seq"), "volume_id", "genus"))
    by_native = asked.join(shuffled(_by_vernacular(asked, _vernacular_table(part2, members), spelled)), ["volume_id", "genus", "vkey"]).select("seq", "plant_id", "rule")
    links = by_name.unionByName(by_native).withColumnRenamed("seq", "part1_seq")
    return links, members


def rule_confidence(links: DataFrame, volumes: DataFrame, labels: DataFrame, prior: float = 0.9, weight: float = 10.0) -> DataFrame:
    """(rule, n_labelled, n_right, confidence) from labelled pairs of Part I entries; volumes: plant_id, volume_id.

    A link is labelled by every pair, true or refused, of its entry with another one linked in the same volume (plants belong to one), by
    whatever rule: right if a true pair has one plant, or a refused pair two. Undecided pairs, pairs with themselves and those labelled both ways
    say nothing; repeats count once; entries with several plants are left out. confidence = (n_right + weight·prior) / (n_labelled + weight), so a
    rule without labels keeps the prior.
    """
    said = labels.where(F.col("is_match").isNotNull() & (F.col("left_seq") != F.col("right_seq")))
    said = said.groupBy(F.least("left_seq", "right_seq").alias("a"), F.greatest("left_seq", "right_seq").alias("b")).agg(F.min("is_match").alias("same"), F.max("is_match").alias("_max"))
    pairs = said.where(F.col("same") == F.col("_max")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "same").select("p.*", "same")
    one = links.groupBy("part1_seq").agg(F.min("plant_id").alias("plant"), F.max("plant_id").alias("p2"), F.min("rule").alias("rule")).where(F.col("plant") == F.col("p2")).drop("p2")
    one = cut(one.join(shuffled(volumes.groupBy(F.col("plant_id").alias("plant")).agg(F.first("volume_id").alias("volume"))), "plant"))
    a = one.select(F.col("part1_seq").alias("a"), F.col("plant").alias("plant_a"), "rule", "volume")
    b = one.select(F.col("part1_seq").alias("b"), F.col("plant").alias("plant_b"), "volume")
    judged = pairs.join(shuffled(a), "a").join(shuffled(b), ["b", "volume"])
    seen = judged.groupBy("rule").agg(F.count("*").alias("n_labelled"), F.count_if((F.col("plant_a") == F.col("plant_b")) == F.col("same")).alias("n_right"))
    rules = links.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    out = rules.join(F.broadcast(seen), "rule", "left").na.fill(0, ["n_labelled", "n_right"])
    return out.withColumn("confidence", (F.col("n_right") + F.lit(weight * prior)) / (F.col("n_labelled") + F.lit(weight)))


def _best_rule(links: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    return links.groupBy("part1_seq", "plant_id").agg(F.min_by("rule", order).alias("rule"))


def match_entries(part1: DataFrame, part2: DataFrame) -> DataFrame:
    """(part1_seq, part2_seq, rule): every pair, once, with the strongest rule that gives it."""
    links, members = cascade(part1, part2)
    return _best_rule(links).join(shuffled(members), "plant_id").select("part1_seq", "part2_seq", "rule")


def match_with_confidence(part1: DataFrame, part2: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of ``match_entries`` with their rule's confidence; the links are written once and read twice."""
    links, members = cascade(part1, part2)
    links = cut(_best_rule(links))
    conf = rule_confidence(links, members, labels)
    return links.join(shuffled(members), "plant_id").join(F.broadcast(conf), "rule").select("part1_seq", "part2_seq", "rule", "confidence")
