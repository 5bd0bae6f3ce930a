"""Plant names: parsing, plants of a volume, and the cascade that resolves citations.

A plant is a cluster of scientific entries of one volume whose genus and
epithet agree up to spelling. Citations are resolved by successive exact joins
on weaker keys; each pass takes only what the passes before left over. Tables
that several passes read are written once (``cut``), which keeps plans small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernalex.functions.text import deaccent, letters_key, phonetic
from vernalex.operators.carry import carry_down
from vernalex.plans.lineage import cut, shuffled, small
from vernalex.sources.tables import first_deliveries

# Words that stand where an epithet is not given.
NO_EPITHET = ("SP", "SPP", "SPEC", "SPECIES", "INDET")


def name_key(word: Column) -> Column:
    """Upper-case letters of a name's word; a run of anything else becomes one `#`."""
    w = F.regexp_replace(word, r"^[\s'\"(]+|[\s,;:.?)]+$", "")
    return F.when(word.rlike("^[A-Za-z]+$"), F.upper(word)).otherwise(F.regexp_replace(F.upper(deaccent(w)), "[^A-Z]+", "#"))


def first_words(text: Column) -> tuple[Column, Column]:
    """The first two words after quotes and blanks; the second is '' if there is none."""
    s = F.ltrim(F.translate(text, "\n\t\r", "   "), F.lit(" '‘’\"`"))
    w1 = F.substring_index(s, " ", 1)
    return w1, F.substring_index(F.ltrim(F.substring(s, F.length(w1) + 1, F.length(s))), " ", 1)


def parse_citations(df: DataFrame, text: str) -> DataFrame:
    """Add genus, epithet and kind of each cited name.

    kind: `full` (epithet given), `genus` (genus alone), `partial` (epithet
    begun, illegible or `sp.`), `none` (blank or no letters). An initial is kept
    as a genus of one letter. Plain columns, one after the other, so that each is computed once.
    """
    tail = F.when(F.contains(text, F.lit("other species")), F.regexp_replace(text, r"(?i),?\s+and other species\W*$", "")).otherwise(F.col(text))
    df = df.withColumn("_s", tail)
    w1, w2 = first_words(F.col("_s"))
    df = df.withColumns({"_w1": w1, "_w2": w2}).withColumns({"genus": name_key(F.col("_w1")), "_e": name_key(F.col("_w2"))})
    w2 = F.col("_w2")
    authority = w2.endswith(".") & w2.rlike(r"^[A-Z][^,]*\.$")
    cut_off = w2.endswith("..") | w2.endswith("-") | w2.endswith("…") | w2.endswith("—") | w2.startswith("[") | F.col("_e").isin(*NO_EPITHET)
    kind = (
        F.when(F.coalesce(F.col("genus"), F.lit("")).isin("", "#"), "none")
        .when((w2 == "") | authority, "genus")
        .when(cut_off | (F.length("_e") < 3), "partial")
        .otherwise("full")
    )
    df = df.withColumn("kind", kind)
    return df.withColumn("epithet", F.when(F.col("kind") == "full", F.col("_e"))).drop("_s", "_w1", "_w2", "_e")


def citations(entries: DataFrame, key: str, taxa: str = "taxa", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per array element: key, pos, cited, genus, epithet, kind.

    An initial takes the nearest full genus before it in the same array (null
    elements count as positions but cite nothing).
    """
    cols = [key, *keep, "pos", "cited", "genus", "epithet", "kind"]
    # few entries hold an initial after their first name; only these carry their array along
    has = F.coalesce(F.array_join(taxa, "|").rlike(r"\|[^A-Za-z|]*[A-Z]\."), F.lit(False))
    plain = parse_citations(entries.where(~has).select(key, *keep, F.posexplode(taxa).alias("pos", "cited")), "cited").select(cols)
    rest = parse_citations(entries.where(has).select(key, *keep, F.col(taxa).alias("_all"), F.posexplode(taxa).alias("pos", "cited")), "cited")
    before = F.filter(F.transform(F.slice("_all", F.lit(1), F.col("pos")), lambda t: name_key(first_words(t)[0])), lambda g: F.length(g) > 1)
    genus = F.when(F.length("genus") == 1, F.coalesce(F.try_element_at(before, F.lit(-1)), F.col("genus"))).otherwise(F.col("genus"))
    return plain.unionByName(rest.withColumn("genus", genus).select(cols))


def scientific_entries(part2: DataFrame) -> DataFrame:
    """Deduplicated entries with genus and epithet keys (volume_id, seq, genus, epithet, recorded_at, withdrawn_at).

    An abbreviated genus comes from the genus column, else from the nearest
    entry before it in the volume that gives one.
    """
    e = first_deliveries(part2, "seq", "volume_id", "page", "name", "genus", "recorded_at", "withdrawn_at")
    w1, w2 = first_words(F.col("name"))
    e = e.withColumns({"_g": name_key(w1), "epithet": F.coalesce(name_key(w2), F.lit("")), "page": F.coalesce("page", F.lit(0))})
    e = e.withColumn("_own", F.coalesce(name_key(F.trim("genus")), F.when(F.length("_g") > 1, F.col("_g")))).drop("_g", "name", "genus")
    e = carry_down(cut(e), "_own", "seq", ["volume_id"], "page", "_open")
    return cut(e.select("volume_id", "seq", F.coalesce("_own", "_open").alias("genus"), "epithet", "recorded_at", "withdrawn_at"))


def _segments(size: Column, j: int) -> tuple[Column, Column]:
    """Place and length of the jth of three parts of a word of that size."""
    start = F.floor(size * (j - 1) / 3).cast("int")
    return start + 1, F.floor(size * j / 3).cast("int") - start


def _segment_key(size: Column, j: int, part: Column) -> Column:
    return F.concat_ws(":", size, F.lit(j), part)


def segment_keys(word: Column) -> Column:
    """Keys of the three parts of a listed word; two edits leave one of them whole."""
    n = F.length(word)
    return F.array(*[_segment_key(n, j, word.substr(*_segments(n, j))) for j in (1, 2, 3)])


def probe_keys(word: Column) -> Column:
    """The parts that words within two edits can have in common with this one, for every length and shift they can have.

    Some part j is whole with at most j - 1 edits before and 3 - j after it, so any word within two edits has one of
    these among its ``segment_keys``.
    """
    n = F.length(word)
    keys = []
    for more in range(-2, 3):
        size = n - more
        for j in (1, 2, 3):
            place, long = _segments(size, j)
            for shift in range(1 - j, j):
                if abs(more - shift) <= 3 - j:
                    at = place + shift
                    keys.append(F.when((size > 0) & (at >= 1) & (at + long - 1 <= n), _segment_key(size, j, word.substr(at, long))))
    return F.array_compact(F.array(*keys))


# Each jump doubles the length of the chains that are resolved.
MAX_JUMPS = 40


def plants(entries: DataFrame) -> DataFrame:
    """Distinct spellings of a volume with the plant they belong to.

    (volume_id, genus, epithet, plant_id): a spelling belongs to the plant of the first printed spelling of its genus within two
    edits, if there is an earlier one, and so on; the plant's id is the smallest seq among them.
    """
    spellings = cut(entries.where(F.col("genus").isNotNull()).groupBy("volume_id", "genus", "epithet").agg(F.min("seq").alias("_seq")))
    species = spellings.where(F.col("epithet") != "")
    k = species.select("volume_id", "genus", "epithet", "_seq", F.explode(probe_keys(F.col("epithet"))).alias("_v"))
    other = species.select("volume_id", "genus", F.col("epithet").alias("_e2"), F.col("_seq").alias("_s2"), F.explode(segment_keys(F.col("epithet"))).alias("_v"))
    near = (
        k.join(shuffled(other), ["volume_id", "genus", "_v"])
        .where((F.col("_s2") < F.col("_seq")) & F.expr("levenshtein(epithet, _e2, 2) >= 0"))
        .groupBy("volume_id", "genus", "epithet")
        .agg(F.min("_s2").alias("_s2"))
    )
    # seq is unique to a spelling, so a spelling's nearest smaller one points on until one points nowhere
    pointers = cut(near.join(shuffled(spellings), ["volume_id", "genus", "epithet"]).select(F.col("_seq").alias("seq"), F.col("_s2").alias("plant_id")))
    for _ in range(MAX_JUMPS):
        on = pointers.select(F.col("seq").alias("plant_id"), F.col("plant_id").alias("_on"))
        jumped = cut(pointers.join(shuffled(on), "plant_id", "left").select("seq", F.coalesce("_on", "plant_id").alias("plant_id"), F.col("_on").isNotNull().alias("_moved")))
        pointers = jumped.select("seq", "plant_id")
        if jumped.where("_moved").isEmpty():
            break
    else:
        raise RuntimeError(f"spellings still point on after {MAX_JUMPS} jumps")
    out = spellings.join(shuffled(pointers.withColumnRenamed("seq", "_seq")), "_seq", "left")
    return cut(out.select("volume_id", "genus", "epithet", F.coalesce("plant_id", "_seq").alias("plant_id")))


KEYS = ["volume_id", "genus", "epithet"]


def _unique_best(cand: DataFrame, rule: str) -> DataFrame:
    """The plant of least distance, where it is the only one at that distance; only the least and the greatest id at each distance are kept."""
    each = cand.groupBy(*KEYS, "_d").agg(F.min("plant_id").alias("_lo"), F.max("plant_id").alias("_hi"))
    best = each.groupBy(*KEYS).agg(F.min_by(F.struct("_lo", "_hi"), "_d").alias("_b"))
    return best.where(F.col("_b._lo") == F.col("_b._hi")).select(*KEYS, F.col("_b._lo").alias("plant_id"), F.lit(rule).alias("rule"))


def resolve_names(names: DataFrame, plant_table: DataFrame) -> DataFrame:
    """Cascade for distinct (volume_id, genus, epithet); epithet '' is a genus alone.

    Each pass is an equi-join of what is left, verified by edit distance, the
    closest plant counting only if it is the one at its distance:
    exact; near, first with the genus exact and the epithet within two edits, then
    with the epithet exact and the genus within two, then both, three edits in
    all; initial: only the genus's first letter is known; genus-near: a genus alone within two edits of
    one genus with an own entry. What is left is unmatched. A genus spelled exactly as one of the volume is never taken for another.
    """
    names = cut(names.select(*KEYS).distinct())
    exact = names.join(shuffled(plant_table), KEYS).select(*KEYS, "plant_id", F.lit("exact").alias("rule"))
    known = plant_table.select("volume_id", "genus").distinct().withColumn("_known", F.lit(True))
    rest = names.join(shuffled(plant_table.select(*KEYS)), KEYS, "left_anti").join(shuffled(known), ["volume_id", "genus"], "left")
    rest = cut(rest.withColumn("_known", F.coalesce("_known", F.lit(False))))
    probes = F.explode(probe_keys(F.col("epithet"))).alias("_v")
    parts = F.explode(segment_keys(F.col("epithet"))).alias("_v")
    full = rest.where(F.col("epithet") != "")
    species = plant_table.where(F.col("epithet") != "")

    a = full.where("_known").select(*KEYS, probes)
    p = species.join(shuffled(rest.where("_known and epithet <> ''").select("volume_id", "genus").distinct()), ["volume_id", "genus"], "left_semi")
    p = p.select("volume_id", "genus", F.col("epithet").alias("_e"), "plant_id", parts)
    near1 = _unique_best(a.join(shuffled(p), ["volume_id", "genus", "_v"]).withColumn("_d", F.expr("levenshtein(epithet, _e, 2)")).where("_d >= 0"), "near")

    strange = full.where("not _known and length(genus) > 1").select(*KEYS)
    b = strange.join(shuffled(species.withColumnRenamed("genus", "_g")), ["volume_id", "epithet"]).withColumn("_d", F.expr("levenshtein(genus, _g, 2)")).where("_d >= 0")
    near2 = cut(_unique_best(b, "near"))

    left = small(strange.join(shuffled(near2.select(*KEYS)), KEYS, "left_anti").select(*KEYS, probes))
    every = species.select("volume_id", F.col("genus").alias("_g"), F.col("epithet").alias("_e"), "plant_id", parts)
    both = every.join(left, ["volume_id", "_v"]).withColumn("_d1", F.expr("levenshtein(genus, _g, 2)")).where("_d1 >= 0")
    both = both.withColumn("_d2", F.expr("levenshtein(epithet, _e, 2)")).where("_d2 >= 0 and _d1 + _d2 <= 3").withColumn("_d", F.expr("_d1 + _d2"))
    near3 = _unique_best(both, "near")

    short = small(full.where("length(genus) = 1").select(*KEYS, probes))
    i = every.join(short, ["volume_id", "_v"]).where(F.startswith("_g", "genus")).withColumn("_d", F.expr("levenshtein(epithet, _e, 2)"))
    initial = _unique_best(i.where("_d >= 0"), "initial")

    alone = rest.where("epithet = '' and length(genus) > 1 and not _known").select(*KEYS, F.explode(probe_keys(F.col("genus"))).alias("_v"))
    heads = plant_table.where("epithet = ''").select("volume_id", F.col("genus").alias("_g"), "plant_id", F.explode(segment_keys(F.col("genus"))).alias("_v"))
    g = alone.join(shuffled(heads), ["volume_id", "_v"]).withColumn("_d", F.expr("levenshtein(genus, _g, 2)"))
    genus_near = _unique_best(g.where("_d >= 0"), "genus-near")
    passes = (exact, near1, near2, near3, initial, genus_near)
    return cut(reduce(DataFrame.unionByName, passes))


def vernacular_key(c: Column | str) -> Column:
    """Phonetic key of a native name, accents, case, blanks and hyphens aside."""
    return phonetic(letters_key(c))
