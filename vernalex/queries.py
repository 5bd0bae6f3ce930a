"""Registry of the core queries, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vernalex.functions import text as tx
from vernalex.operators import audit, browse, grammar, graph, match, orphans, overrides, tooling
from vernalex.operators import search as sr
from vernalex.operators.align import align_pages, locate, prefix_similarity
from vernalex.operators.carry import carry_down
from vernalex.plans.lineage import cut
from vernalex.sources import scans, sinks
from vernalex.sources.tables import first_deliveries, read
from vernalex.sql import GRAMMAR_SQL, MARKERS_SQL, P1, P2

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def part1(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return first_deliveries(read(spark, d, "part1_vernacular"), "seq", *cols)


def part2(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return first_deliveries(read(spark, d, "part2_scientific"), "seq", *cols)


# --- SQL fragments
def key_sql(x: str) -> str:
    return f"regexp_replace(translate(lower(strip_accents({x})), '01345689', 'oieasobg'), '[^a-z]', '', 'g')"


def wild_sql(x: str) -> str:
    return f"regexp_replace(translate(lower(replace(strip_accents({x}), '�', '\u0001')), '01345689', 'oieasobg'), '[^a-z\u0001]', '', 'g')"


def sound_sql(x: str) -> str:
    return f"translate({x}, 'iyu', 'eeo')"


# ---------------------------------------------------------------- keys and display
@query(f"select doc_id, md5({key_sql('text')}) as key_md5, length({key_sql('text')})::bigint as key_length from documents")
def fold_keys(spark, d):
    k = tx.search_key("text", False)
    return read(spark, d, "documents").select("doc_id", F.md5(k).alias("key_md5"), F.length(k).cast("long").alias("key_length"))


@query(f"with {P1} select distinct headword, {key_sql('headword')} as key, {sound_sql(key_sql('headword'))} as sound, upper(strip_accents(headword[1])) as initial from p1")
def phonetic_keys(spark, d):
    k = tx.search_key("headword", False)
    return part1(spark, d, "headword").select("headword", k.alias("key"), tx.phonetic(k).alias("sound"), tx.initial_of("headword").alias("initial")).distinct()


@query(f"with {P1}, k as (select distinct {key_sql('headword')} as key from p1) select {sound_sql('key')} as sound, count(*)::bigint as n_keys, string_agg(key, '|' order by key) as keys from k where key <> '' group by 1 having count(*) > 1")
def phonetic_variant_groups(spark, d):
    k = part1(spark, d, "headword").select(tx.search_key("headword", False).alias("key")).where("key <> ''").distinct()
    g = k.groupBy(tx.phonetic("key").alias("sound")).agg(F.count("*").alias("n_keys"), F.array_join(F.array_sort(F.collect_set("key")), "|").alias("keys"))
    return g.where("n_keys > 1")


@query("select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’‚“”„', '''''''\"\"\"'), '[\\s\\x{a0}]*[—–][\\s\\x{a0}]*', '--', 'g'), '[\\s\\x{a0}]+([,.;])', '\\1', 'g'), '[\\s\\x{a0}]+', ' ', 'g'))) as repaired from documents")
def repair_typography(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.repair_typography("text")).alias("repaired"))


@query(f"""with {P2}, w as (select seq, name, string_split(trim(name), ' ') s from p2)
select seq, case when regexp_matches(s[1], '^[A-Z?]\\.$') then s[1] else upper(s[1][1]) || lower(s[1][2:]) end || case when len(s) > 1 then ' ' || lower(array_to_string(s[2:], ' ')) else '' end as display from w""")
def display_binomial(spark, d):
    return part2(spark, d, "name").select("seq", tx.display_binomial("name").alias("display"))


@query(f"""with {P1}, c as (select distinct trim(unnest(taxa)) t from p1), w as (select t, regexp_split_to_array(t, '\\s+') s from c),
n as (select *, case when len(s) >= 2 and regexp_matches(s[2], '^[a-z]') then 2 else 1 end k from w)
select t as cited, array_to_string(s[1:k], ' ') as name, case when len(s) > k then array_to_string(s[k+1:], ' ') end as authority from n""")
def split_head_authority(spark, d):
    c = part1(spark, d, "taxa").select(F.explode("taxa").alias("cited")).select(F.trim("cited").alias("cited")).distinct()
    s = tx.split_authority("cited")
    return c.select("cited", s["name"].alias("name"), s["authority"].alias("authority"))


@query(f"""with {P1}, codes as (select list(dialect_code) l from ref_dialects)
select seq, array_to_string(list_filter([case when contains(headword, 'é') then 'accent-lost' end, case when contains(headword, '�') then 'glyph-damage' end,
 case when len(list_filter(coalesce(dialects, []), lambda x: not list_contains(l, x) and not regexp_matches(x, '^[A-Z]$'))) > 0 then 'dialect-unrecognised' end,
 case when len(list_filter(coalesce(dialects, []), lambda x: not list_contains(l, x) and regexp_matches(x, '^[A-Z]$'))) > 0 then 'dialect-undocumented' end,
 case when len(list_filter(taxa, lambda x: regexp_matches(x, '[0-9?\\\\|]'))) > 0 then 'taxon-suspect' end], lambda x: x is not null), '|') as quality from p1, codes""")
def quality_flags(spark, d):
    codes = read(spark, d, "ref_dialects").agg(F.collect_set("dialect_code").alias("codes"))
    ds = F.coalesce("dialects", F.array().cast("array<string>"))
    unlisted = F.array_except(ds, "codes")
    unknown, undocumented = F.filter(unlisted, lambda x: ~x.rlike("^[A-Z]$")), F.filter(unlisted, lambda x: x.rlike("^[A-Z]$"))
    e = part1(spark, d, "headword", "taxa", "dialects").crossJoin(F.broadcast(codes))
    return e.select("seq", F.array_join(tx.quality_flags("headword", "taxa", unknown, undocumented), "|").alias("quality"))


@query(f"with {P1} select case when confidence is null then 'unknown' when confidence < 40 then 'bad' when confidence < 70 then 'weak' else 'ok' end as band, count(*)::bigint as n from p1 group by 1")
def confidence_bands(spark, d):
    return part1(spark, d, "confidence").groupBy(tx.confidence_band("confidence").alias("band")).agg(F.count("*").alias("n"))


@query("select event_id, props as decoded from events")
def entity_decode(spark, d):
    e = F.replace(F.replace(F.replace(F.replace("props", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#39;"))
    return read(spark, d, "events").select("event_id", tx.entity_decode(e).alias("decoded"))


# ---------------------------------------------------------------- scans
@query("""with t as (select doc_id, string_split(regexp_replace(replace(text, chr(13), ''), '\\s+$', ''), chr(10)) l, string_split(replace(text, chr(13), ''), chr(10)) al from documents)
select doc_id, 1 as page, i::int as line_no, md5(al[i]) as line from (select doc_id, al, unnest(range(1, len(al) + 1)) i from t)""")
def page_lines(spark, d):
    t = scans.page_lines(read(spark, d, "documents"), "doc_id", "text")
    return t.select("doc_id", "page", "line_no", F.md5("line").alias("line"))


@query("select source, count(*)::bigint as n_documents, sum(length(text) - length(replace(text, '�', '')))::bigint as n_undecodable, sum(length(text) - length(replace(text, 'é', '')))::bigint as n_e_acute from documents group by 1")
def extraction_signals(spark, d):
    doc = read(spark, d, "documents").select("source", *scans.extraction_signals(F.col("text")))
    return doc.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_undecodable").cast("long").alias("n_undecodable"), F.sum("n_e_acute").cast("long").alias("n_e_acute"))


def hocr_markup(spark, d) -> DataFrame:
    """hOCR text of each page, written from the entries: a line per entry, a word per word of its headword."""
    e = part1(spark, d, "volume_id", "page", "headword", "confidence").where("confidence is not null and headword is not null")
    enc = F.replace(F.replace("headword", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    box = F.concat_ws(" ", *[(F.col("seq") % m).cast("string") for m in (97, 89, 83, 79)])
    word = F.transform(F.split(enc, " "), lambda w: F.concat(F.lit("<span class='ocrx_word' title='bbox "), box, F.lit("; x_wconf "), F.col("confidence").cast("string"), F.lit("'>"), w, F.lit("</span>")))
    line = F.concat(F.lit("<span class='ocr_line' title='bbox 0 0 9 9'>"), F.array_join(word, " "), F.lit("</span>"))
    return e.groupBy("volume_id", "page").agg(F.concat(F.lit("<div class='ocr_page' title='bbox 0 0 9 9'>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))), lambda s: s["l"]), "\n"), F.lit("</div>")).alias("html"))


@query(f"""with {P1}, w as (select volume_id, page, confidence, lower(unnest(string_split(headword, ' '))) token from p1 where confidence is not null and headword is not null)
select volume_id, page, token, min(confidence)::int as conf from w where trim(token) <> '' group by 1, 2, 3""")
def html_token_confidence(spark, d):
    h = hocr_markup(spark, d).withColumn("_k", F.struct("volume_id", F.col("page").alias("leaf")))
    w = scans.hocr_words(h.select("_k", "html"), "_k", "html")
    t = scans.token_confidence(w.withColumns({"volume_id": F.col("_k.volume_id"), "leaf": F.col("_k.leaf")}), ["volume_id", "leaf"])
    return t.select("volume_id", F.col("leaf").alias("page"), "token", "conf")


# ---------------------------------------------------------------- grammar and blocks
def parsed_entries(spark, d) -> DataFrame:
    return grammar.parse_entry_lines(part1(spark, d, "raw"), "raw")


@query(GRAMMAR_SQL + " select seq, head, nullif(l, '') as locs, nullif(p, '') as place, nullif(s, '') as sci from e where head is not null")
def line_grammar_parse(spark, d):
    return parsed_entries(spark, d).where("parsed").select("seq", "head", "locs", "place", "sci")


@query(GRAMMAR_SQL + " select seq, x[1:300] as line from e where head is null")
def dead_letter_lines(spark, d):
    return sinks.dead_letters(parsed_entries(spark, d), "parsed", "line_read").select("seq", F.col("line_read").alias("line"))


@query(GRAMMAR_SQL + f", t as (select unnest({MARKERS_SQL}) marker from e where head is not null) select marker, dialect_code is not null as known, count(*)::bigint as n from t left join ref_dialects on marker = dialect_code group by 1, 2")
def token_slot_extract(spark, d):
    t = parsed_entries(spark, d).where("parsed").select(F.explode(grammar.markers(F.col("locs"))).alias("marker"))
    n = t.groupBy("marker").agg(F.count("*").alias("n"))
    codes = read(spark, d, "ref_dialects").select(F.col("dialect_code").alias("marker"), F.lit(True).alias("known"))
    return n.join(codes, "marker", "left").select("marker", F.coalesce("known", F.lit(False)).alias("known"), "n")


@query(GRAMMAR_SQL + ", t as (select seq, trim(regexp_replace(unnest(regexp_split_to_array(s, '\\s*--\\s*')), '\\s*[.;]\\s*$', '')) taxon from e where head is not null) select seq, count(*)::bigint as n_taxa, md5(string_agg(taxon, '|' order by taxon)) as taxa from t where taxon <> '' group by 1")
def taxon_list_split(spark, d):
    t = parsed_entries(spark, d).where("parsed").select("seq", grammar.taxon_list(F.col("sci")).alias("t")).where("size(t) > 0")
    return t.select("seq", F.size("t").cast("long").alias("n_taxa"), F.md5(F.array_join(F.array_sort("t"), "|")).alias("taxa"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), i as (select doc_id, length(line) - length(ltrim(line, ' ')) i, count(*) n from l where length(trim(line, ' ')) >= 20 group by 1, 2),
t as (select *, sum(n) over (partition by doc_id) a, min(i) over (partition by doc_id) least from i)
select doc_id, coalesce(min(case when n >= greatest(2, ceil(a * 0.1)) then i end), min(least))::int as margin from t group by 1""")
def page_indent_margin(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return grammar.page_margins(lines, ["doc_id"], "line")


@query(f"""with {P2}, w as (select seq, volume_id, string_split(trim(name), ' ')[1] w1, coalesce(string_split(trim(name), ' ')[2], '') w2, trim(name) t from p2 where name is not null),
h as (select seq, volume_id, length(w1) = 2 and w1[2] = '.' and w1[1] between 'A' and 'Z' as short, t[1] between 'A' and 'Z' cap, length(regexp_replace(w1, '[^A-Z]', '', 'g')) c1, length(regexp_replace(w1, '[^A-Za-z]', '', 'g')) l1, length(regexp_replace(w2, '[^A-Z]', '', 'g')) c2, length(regexp_replace(w2, '[^A-Za-z]', '', 'g')) l2 from w),
b as (select seq, volume_id, sum(case when not short and cap and (l1 >= 3 and c1 >= 2 or l2 >= 4 and c2 >= 2) then 1 else 0 end) over (partition by volume_id order by seq) as block from h)
select volume_id, block::bigint as block, count(*)::bigint as n_entries, min(seq) as first_seq from b where block > 0 group by 1, 2""")
def block_assembly(spark, d):
    """Blocks of a genus: a heading that gives the genus in full opens one."""
    e = part2(spark, d, "volume_id", "page", "name").where("name is not null")
    e = e.withColumn("heading", grammar.is_heading(F.col("name")) & ~F.col("name").rlike(r"^\s*[A-Z?]\.\s"))
    b = grammar.block_ids(e, "heading", "seq", ["volume_id"], "page").where("block > 0")
    return b.groupBy("volume_id", "block").agg(F.count("*").alias("n_entries"), F.min("seq").alias("first_seq"))


def printed_blocks(spark, d) -> DataFrame:
    """Scientific entries as one printed block: name, authority, (family.), notes, native names."""
    e = part2(spark, d, "name", "authority", "family", "notes", "vernaculars")
    names = F.array_join(F.transform("vernaculars", lambda v: F.concat(v["name"], F.when(F.size(v["dialects"]) > 0, F.concat(F.lit(", "), F.array_join(v["dialects"], "., "), F.lit("."))).otherwise(F.lit("")))), "; ")
    t = F.concat_ws(" ", F.concat(F.concat_ws(" ", "name", "authority"), F.when(F.col("authority").isNull(), ".").otherwise("")), F.when(F.col("family").rlike("^[A-Za-z]{4,26}$"), F.concat(F.lit("("), F.col("family"), F.lit(".)"))), F.replace("notes", F.lit("\n"), F.lit(" ")), names)
    return e.select("seq", t.alias("text"))


@query()
def part2_block_parse(spark, d):
    """Blocks read back from their printed form: split if run together, then name, authority, family, notes and names."""
    b = grammar.split_run_together(printed_blocks(spark, d), "text")
    p = b.select("seq", "piece", grammar.parse_block(F.col("text")).alias("p"))
    n = p.withColumn("n", grammar.split_notes(F.col("p.rest")))
    return n.select("seq", "piece", "p.name", "p.authority", "p.family_raw", "n.notes", F.size("n.vernaculars").alias("n_vernaculars"))


# ---------------------------------------------------------------- matching
NEAR_SQL = f"""with {P1}, {P2}, l as (select distinct volume_id, {key_sql("v.name")} key from (select volume_id, unnest(vernaculars) v from p2) where v.name is not null),
r as (select distinct volume_id, {key_sql("headword")} key from p1 where headword is not null),
x as (select l.volume_id, l.key, l.key as found, 'exact' as how, 1::bigint as n_candidates from l semi join r using (volume_id, key)),
o as (select * from l anti join r using (volume_id, key)),
c as (select o.volume_id, o.key, count(*) n, min(r.key) f from o join r on o.volume_id = r.volume_id and abs(length(o.key) - length(r.key)) <= 1 and levenshtein(o.key, r.key) <= 1 group by 1, 2),
z as (select * from x union all select volume_id, key, case when n = 1 then f end, case when n is null then 'none' when n = 1 then 'near' else 'ambiguous' end, coalesce(n, 0) from o left join c using (volume_id, key))"""


def near_links(spark, d) -> DataFrame:
    left = part2(spark, d, "volume_id", "vernaculars").select("volume_id", F.explode("vernaculars").alias("v")).select("volume_id", tx.search_key("v.name", False).alias("key"))
    right = part1(spark, d, "volume_id", "headword").select("volume_id", tx.search_key("headword", False).alias("key"))
    return match.near_lookup(left, right, "key", ("volume_id",))


@query(NEAR_SQL + " select volume_id, key, found, how from z where how in ('exact', 'near')")
def near_link_unique(spark, d):
    return near_links(spark, d).where(F.col("how").isin("exact", "near")).select("volume_id", "key", "found", "how")


@query(NEAR_SQL + " select volume_id, key, how, n_candidates from z where how in ('ambiguous', 'none')")
def near_link_ambiguous(spark, d):
    return near_links(spark, d).where(F.col("how").isin("ambiguous", "none")).select("volume_id", "key", "how", "n_candidates")


@query(NEAR_SQL + " select volume_id, count(*)::bigint as total, count(*) filter (how = 'exact')::bigint as n_exact, count(*) filter (how = 'near')::bigint as n_near, count(*) filter (how in ('none', 'ambiguous'))::bigint as n_unmatched, (count(*) filter (how = 'exact') * 1000 // count(*))::bigint as exact_permille from z group by 1")
def cross_half_check(spark, d):
    def n(*hows: str) -> Column:
        return F.count_if(F.col("how").isin(*hows))

    g = near_links(spark, d).groupBy("volume_id").agg(F.count("*").alias("total"), n("exact").alias("n_exact"), n("near").alias("n_near"), n("none", "ambiguous").alias("n_unmatched"))
    return g.withColumn("exact_permille", F.expr("n_exact * 1000 div total"))


TAXKEY = "array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents(replace(regexp_replace({x}, '(?i)(^|[^A-Za-z0-9_])(var|subsp|spp?|f)\\.?($|[^A-Za-z0-9_]).*$', ''), '?', ''))), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda w: w <> '')[1:2], ' ')"


@query(f"""with {P1}, {P2}, l as (select distinct volume_id, {TAXKEY.format(x="c")} key from (select volume_id, unnest(taxa) c from p1)), r as (select distinct volume_id, {TAXKEY.format(x="name")} key from p2),
o as (select * from l where key <> '' and (volume_id, key) not in (select volume_id, key from r)),
n as (select distinct o.volume_id, o.key from o join r on o.volume_id = r.volume_id and abs(length(o.key) - length(r.key)) <= 1 and levenshtein(o.key, r.key) <= 1)
select volume_id, key from o anti join n using (volume_id, key)""")
def taxa_in_doubt(spark, d):
    left = part1(spark, d, "volume_id", "taxa").select("volume_id", F.explode("taxa").alias("c")).select("volume_id", graph.taxon_key(F.col("c")).alias("key")).where("key <> ''")
    right = part2(spark, d, "volume_id", "name").select("volume_id", graph.taxon_key(F.col("name")).alias("key"))
    return match.near_lookup(left, right, "key", ("volume_id",)).where("how = 'none'").select("volume_id", "key")


DELIG = "regexp_replace(lower(translate(regexp_replace({x}, '\\.\\s*$', ''), 'éw0O1', 'eeool')), '[^a-z]', '', 'g')"


@query(f"""with {P2}, v as (select distinct family from p2 where family is not null), k as (select family, {DELIG.format(x="family")} k from v), c as (select *, greatest(2, floor(length(k) / 6.0 + 0.5)::int + 1) cap from k),
t as (select family_id, family entry, {DELIG.format(x="family")} e from ref_families),
b as (select c.family, arg_min(entry, levenshtein(k, e) * 1000000 + family_id) entry, min(levenshtein(k, e)) dist from c join t on levenshtein(k, e) <= cap group by 1)
select v.family, entry as snapped, case when dist is null then 'none' when dist = 0 then 'exact' else 'fuzzy' end as how, dist::int as distance from v left join b using (family)""")
def snap_to_dictionary(spark, d):
    return match.snap(part2(spark, d, "family"), "family", read(spark, d, "ref_families"), "family", "family_id")


@query()
def stub_resolution(spark, d):
    """Sequential stub rule over the taxa cited in Part I, against the names of Part II; tested by replay on fixtures."""
    c = part1(spark, d, "taxa").select("seq", F.explode("taxa").alias("c")).select(F.regexp_replace(graph.taxon_key(F.col("c")), " ", "").alias("key"), "seq").where("key <> ''")
    keys = cut(c.groupBy("key").agg(F.min("seq").cast("long").alias("order")))
    known = cut(part2(spark, d, "name").select(F.regexp_replace(graph.taxon_key(F.col("name")), " ", "").alias("key")).where("key <> ''").distinct())
    return graph.resolve_stubs(keys, known)


@query("""with a as (select volume_id, page, list_distinct(flatten(list(regexp_extract_all(lower(strip_accents(headword)), '([a-z]{4,})', 1)))) w from part1_vernacular group by 1, 2),
b as (select volume_id, page, list_distinct(flatten(list(regexp_extract_all(lower(strip_accents(was)), '([a-z]{4,})', 1)))) w from taxa_corrections group by 1, 2),
n as (select volume_id, count(*) n_pages from a group by 1),
s as (select a.volume_id, b.page - a.page as d, sum(case when len(list_distinct(list_concat(a.w, b.w))) > 0 then len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) else 0 end) t from a join b on a.volume_id = b.volume_id and b.page between a.page - 12 and a.page + 12 group by 1, 2)
select volume_id, d::int as page_offset, n_pages::bigint as n_pages, round(t / n_pages, 6) as mean_similarity from s join n using (volume_id)""")
def band_align_offset(spark, d):
    def pages(table: str, c: str) -> DataFrame:
        w = read(spark, d, table).select("volume_id", "page", F.explode(match.long_words(tx.deaccent(c))).alias("w"))
        return read(spark, d, table).select("volume_id", "page").distinct().join(w.groupBy("volume_id", "page").agg(F.collect_set("w").alias("w")), ["volume_id", "page"], "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))

    b = match.band_offsets(pages("part1_vernacular", "headword"), pages("taxa_corrections", "was"), "page", "w", ["volume_id"])
    return b.select("volume_id", F.col("offset").alias("page_offset"), "n_pages", F.round("mean_similarity", 6).alias("mean_similarity"))


@query()
def sequence_align(spark, d):
    """Headings of the corrections aligned with the headwords of their page, in order."""
    fix = first_deliveries(read(spark, d, "taxa_corrections"), "correction_id", "volume_id", "page", "was")
    right = fix.select("volume_id", "page", F.col("correction_id").alias("seq"), F.col("was").alias("text"))
    left = part1(spark, d, "volume_id", "page", "headword").join(right.select("volume_id", "page").distinct(), ["volume_id", "page"], "left_semi").select("volume_id", "page", "seq", F.col("headword").alias("text"))
    return align_pages(left, right, ["volume_id", "page"], "seq", "text").select("volume_id", "page", F.col("left_seq").alias("seq"), F.col("right_seq").alias("correction_id"), F.round("similarity", 6).alias("similarity"))


@query()
def prefix_similarities(spark, d):
    """How well the heading of each correction begins the raw line of the entry it names."""
    import pandas as pd

    sim = F.pandas_udf(lambda a, b: pd.Series([prefix_similarity(x or "", y or "") for x, y in zip(a, b)]), "double")
    e, _ = corrected(spark, d)
    return e.where(F.col("correction_id").isNotNull()).select("correction_id", "seq", F.round(sim(F.upper("raw"), F.upper("was")), 6).alias("similarity"))


@query(f"""with {P1}, b as (select seq, volume_id, page, box[1] x, box[2] y, box[3] w, box[4] h from p1 where box is not null)
select a.seq, count(*)::bigint as n_inside from b a join b c on a.volume_id = c.volume_id and a.page = c.page and c.x + c.w / 2 between a.x - 0.02 and a.x + a.w + 0.02 and c.y + c.h / 2 between a.y and a.y + a.h group by 1""")
def containment_join(spark, d):
    b = part1(spark, d, "volume_id", "page", "box").where(F.col("box").isNotNull())
    points = b.select("volume_id", "page", (F.col("box")[0] + F.col("box")[2] / 2).alias("px"), (F.col("box")[1] + F.col("box")[3] / 2).alias("py"))
    return audit.contained_in(points, b, ["volume_id", "page"]).groupBy("seq").agg(F.count("*").alias("n_inside"))


@query(f"""with {P1}, t as (select volume_id, page, lower(unnest(string_split(headword, ' '))) token, min(confidence) conf from p1 where headword is not null and confidence is not null group by 1, 2, 3),
a as (select distinct correction_id, volume_id, page, lower(unnest(string_split(was, ' '))) token from taxa_corrections)
select correction_id, case when count(conf) = count(*) then min(conf) end as confidence from a left join t using (volume_id, page, token) group by 1""")
def all_tokens_found_min(spark, d):
    tokens = part1(spark, d, "volume_id", "page", "headword", "confidence").where("confidence is not null").select("volume_id", "page", F.explode(F.split(F.lower("headword"), " ")).alias("token"), "confidence")
    tokens = tokens.groupBy("volume_id", "page", "token").agg(F.min("confidence").alias("conf"))
    fix = first_deliveries(read(spark, d, "taxa_corrections"), "correction_id", "volume_id", "page", F.split(F.lower("was"), " ").alias("words"))
    return audit.weakest_token(fix, tokens, ["volume_id", "page"], "correction_id", "words")


# ---------------------------------------------------------------- overrides and order
HEADED = "select seq, volume_id, page, headword, taxa, upper(strip_accents(coalesce(ocr_headword, headword))) head, row_number() over (partition by volume_id, page, upper(strip_accents(coalesce(ocr_headword, headword))) order by seq) occurrence from p1"
FIXES = "select correction_id, volume_id, page, upper(strip_accents(was)) head, occurrence, taxa, is_drop from taxa_corrections qualify row_number() over (partition by volume_id, page, upper(strip_accents(was)), occurrence order by correction_id desc) = 1"


def corrected(spark, d) -> tuple[DataFrame, DataFrame]:
    e = part1(spark, d, "volume_id", "page", "headword", "ocr_headword", "taxa", "raw")
    e = e.withColumn("head", F.upper(tx.deaccent(F.coalesce("ocr_headword", "headword"))))
    e = overrides.number_occurrences(e, ["volume_id", "page", "head"], ["seq"])
    f = first_deliveries(read(spark, d, "taxa_corrections"), "correction_id", "volume_id", "page", "was", "occurrence", F.col("taxa").alias("new_taxa"), "is_drop")
    f = f.withColumn("head", F.upper(tx.deaccent("was")))
    return overrides.override(e, f, ["volume_id", "page", "head", "occurrence"], "correction_id")


@query(f"""with {P1}, e as ({HEADED}), f as ({FIXES}) select e.seq, f.correction_id, coalesce(f.is_drop, false) as dropped, md5(array_to_string(case when coalesce(f.is_drop, false) then null else coalesce(f.taxa, e.taxa) end, '|')) as taxa_now
from e join f using (volume_id, page, head, occurrence)""")
def occurrence_override(spark, d):
    e, _ = corrected(spark, d)
    drop = F.coalesce("is_drop", F.lit(False))
    return e.where(F.col("correction_id").isNotNull()).select("seq", "correction_id", drop.alias("dropped"), F.md5(F.array_join(F.when(~drop, F.coalesce("new_taxa", "taxa")), "|")).alias("taxa_now"))


@query(f"with {P1}, e as ({HEADED}), f as ({FIXES}), a as (select correction_id from e join f using (volume_id, page, head, occurrence)) select correction_id, volume_id, page, was from taxa_corrections where correction_id not in (select correction_id from a)")
def stale_overrides(spark, d):
    return corrected(spark, d)[1].select("correction_id", "volume_id", "page", "was")


@query(f"with {P1} select seq, occurrence::int as occurrence from ({HEADED})")
def occurrence_numbers(spark, d):
    e = part1(spark, d, "volume_id", "page", "headword", "ocr_headword").withColumn("head", F.upper(tx.deaccent(F.coalesce("ocr_headword", "headword"))))
    return overrides.number_occurrences(e, ["volume_id", "page", "head"], ["seq"]).select("seq", "occurrence")


@query(f"""with {P2}, g as (select seq, volume_id, family, case when not regexp_matches(name, '^[A-Za-z?]\\.') then upper(string_split(name, ' ')[1]) end own from p2),
c as (select *, sum(case when own is not null then 1 else 0 end) over (partition by volume_id order by seq) b from g)
select seq, max(own) over (partition by volume_id, b) as open_genus, first_value(family) over (partition by volume_id, b order by seq) as group_family from c""")
def carry_down_heading(spark, d):
    e = part2(spark, d, "volume_id", "page", "name", "family").withColumn("own", F.when(~F.col("name").rlike(r"^[A-Za-z?]\."), F.upper(F.get(F.split("name", " "), F.lit(0)))))
    # one pass: the opening row's genus and family travel together, so a null family is inherited as well
    e = e.withColumn("head", F.when(F.col("own").isNotNull() , F.struct("own", "family")))
    first = Window.partitionBy("volume_id", "block").orderBy("seq")
    c = carry_down(e, "head", "seq", ["volume_id"], "page", "open")
    lead = e.where(F.col("own").isNull()).join(e.where(F.col("own").isNotNull()).groupBy("volume_id").agg(F.min("seq").alias("_first")), "volume_id", "left").where(F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
    early = lead.groupBy("volume_id").agg(F.min_by(F.struct("family"), "seq").alias("_early"))
    out = c.join(early, "volume_id", "left")
    return out.select("seq", F.col("open.own").alias("open_genus"), F.when(F.col("open").isNotNull(), F.col("open.family")).otherwise(F.col("_early.family")).alias("group_family"))


@query(f"with {P1} select seq, lead(seq) over (partition by volume_id, page order by seq) - 1 as span_end from p1")
def span_to_next_start(spark, d):
    w = Window.partitionBy("volume_id", "page").orderBy("seq")
    return part1(spark, d, "volume_id", "page").select("seq", (F.lead("seq").over(w) - 1).alias("span_end"))


@query(f"with {P1} select seq, row_number() over (partition by volume_id, page order by box[2], box[1], seq)::int as line_no from p1 where box is not null")
def reading_order(spark, d):
    w = Window.partitionBy("volume_id", "page").orderBy(F.col("box")[1], F.col("box")[0], "seq")
    return part1(spark, d, "volume_id", "page", "box").where(F.col("box").isNotNull()).select("seq", F.row_number().over(w).alias("line_no"))


# ---------------------------------------------------------------- graph and facets
NAMES = f"""{P1}, nk as (select *, {wild_sql("headword")} key from p1), names as (select key, min(seq) id, arg_min(headword, seq) as name, min(confidence) confidence, count(*)::bigint n_entries, count(distinct volume_id * 100000 + page)::bigint n_pages from nk where key <> '' group by 1),
nd as (select key, string_agg(dl, '|' order by o, dl) dialects from (select key, dl, min(seq) o from (select key, seq, unnest(dialects) dl from nk where key <> '') where dl is not null group by 1, 2) group by 1)"""


def names(spark, d) -> DataFrame:
    return graph.merge_headwords(part1(spark, d, "volume_id", "page", "headword", "dialects", "place", "confidence"))


@query(f"with {NAMES} select id, name, key, confidence, n_entries, n_pages, coalesce(dialects, '') as dialects from names left join nd using (key)")
def merge_headwords(spark, d):
    return names(spark, d).select("id", "name", "key", "confidence", "n_entries", "n_pages", F.array_join("dialects", "|").alias("dialects"))


TAXA = f"""{P2}, tk as (select *, coalesce(genus, string_split(name, ' ')[1]) || ' ' || coalesce(string_split(name, ' ')[2], '') k from p2),
taxa as (select k as key, min(seq) id, arg_min(name, seq) as name, arg_min_null(authority, seq) authority, arg_min(family, seq) filter (family is not null and family <> '') family, arg_min(notes, seq) filter (notes is not null and notes <> '') notes, count(*)::bigint n_entries, arg_min(genus, seq) genus from tk group by 1)"""


def taxa(spark, d) -> DataFrame:
    e = part2(spark, d, "name", "authority", "family", "notes", "genus")
    w = F.split("name", " ")
    e = e.withColumn("key", F.concat(F.coalesce("genus", F.get(w, F.lit(0))), F.lit(" "), F.coalesce(F.get(w, F.lit(1)), F.lit(""))))
    return graph.merge_taxa(e)


@query(f"with {TAXA} select key, id, name, authority, family, md5(notes) as notes, n_entries from taxa")
def dedupe_backfill(spark, d):
    return taxa(spark, d).select("key", "id", "name", "authority", "family", F.md5("notes").alias("notes"), "n_entries")


CITED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '^\s*[''\"]+', ''), '(?i),?\s+and other species\W*$', ''), '[\s.;]+$', ''), '^(\w+),.*$', '\1')"
LINKS = f"""{P1}, lc as (select seq, pos, {wild_sql("headword")} name_key, trim({CITED}) t from (select seq, headword, unnest(taxa) c, unnest(range(0, len(taxa))) pos from p1)),
ls as (select *, regexp_split_to_array(t, '\\s+') s from lc), la as (select *, case when len(s) >= 2 and regexp_matches(s[2], '^[a-z]') then 2 else 1 end k from ls),
lk as (select *, {TAXKEY.format(x="array_to_string(s[1:k], ' ')")} taxon_key from la),
links as (select name_key, taxon_key, arg_min(case when len(s) > k then array_to_string(s[k+1:], ' ') else '\u0002' end, seq * 1000 + pos) authority, min(seq) first_seq, count(*)::bigint n_citations from lk where name_key <> '' and taxon_key <> '' group by 1, 2)"""


def links(spark, d) -> DataFrame:
    return graph.links(part1(spark, d, "headword", "taxa"))


@query(f"with {LINKS} select name_key, taxon_key, first_seq, n_citations from links")
def link_graph(spark, d):
    return links(spark, d).select("name_key", "taxon_key", "first_seq", "n_citations")


@query(f"with {LINKS} select taxon_key, count(*)::bigint as n_names, min(name_key) as first_name, sum(n_citations)::bigint as n_citations from links group by 1")
def inverse_links(spark, d):
    return links(spark, d).groupBy("taxon_key").agg(F.count("*").alias("n_names"), F.min("name_key").alias("first_name"), F.sum("n_citations").alias("n_citations"))


@query(f"with {LINKS} select o.name_key, count(distinct o.taxon_key)::bigint as n_shared from links o join links m on o.taxon_key = m.taxon_key and m.name_key = 'balawit' where o.name_key <> 'balawit' group by 1")
def sibling_names(spark, d):
    return graph.siblings(cut(links(spark, d)), "balawit")


@query(f"with {P1} select 'dialect' as facet, x as value, count(distinct key)::bigint as n from (select {wild_sql('headword')} key, unnest(dialects) x from p1) where x is not null group by 2 union all select 'family', family, count(*)::bigint from (select distinct on (seq) seq, family from part2_scientific order by seq, loaded_at) where family is not null group by 2")
def facet_counts(spark, d):
    a = browse.facet(part1(spark, d, "headword", "dialects").select(tx.search_key("headword").alias("key"), F.explode("dialects").alias("x")), F.col("x"), "key", "value").withColumn("facet", F.lit("dialect"))
    b = browse.facet(part2(spark, d, "family"), F.col("family"), "seq", "value").withColumn("facet", F.lit("family"))
    return a.unionByName(b).select("facet", "value", "n")


@query(f"with {LINKS}, {P2}, n as (select count(distinct {wild_sql('headword')}) filter ({wild_sql('headword')} <> '') n_names from p1) select n_names::bigint as n_names, (select count(*) from p2)::bigint as n_scientific, (select count(*) from p2 where notes is not null)::bigint as n_with_notes, (select count(*) from p2 where family is not null)::bigint as n_with_family, (select count(distinct family) from p2)::bigint as n_families, (select count(*) from links)::bigint as n_links from n")
def build_counts(spark, d):
    n = part1(spark, d, "headword").select(tx.search_key("headword").alias("k")).where("k <> ''").agg(F.count_distinct("k").alias("n_names"))
    t = part2(spark, d, "notes", "family").agg(F.count("*").alias("n_scientific"), F.count("notes").alias("n_with_notes"), F.count("family").alias("n_with_family"), F.count_distinct("family").alias("n_families"))
    return n.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(links(spark, d).agg(F.count("*").alias("n_links"))))


@query(NEAR_SQL + " select volume_id, how, count(*)::bigint as n_links from z group by 1, 2")
def link_provenance(spark, d):
    return near_links(spark, d).groupBy("volume_id", "how").agg(F.count("*").alias("n_links"))


@query(f"with {P1} select volume_id, count(confidence)::bigint as n, (count(*) - count(confidence))::bigint as n_missing, list_sort(list(confidence) filter (confidence is not null))[count(confidence) // 2 + 1] as median from p1 group by 1")
def upper_median_distribution(spark, d):
    return audit.upper_median(part1(spark, d, "volume_id", "confidence"), "confidence", ["volume_id"]).select("volume_id", F.col("n").cast("long").alias("n"), F.col("n_missing").cast("long").alias("n_missing"), "median")


@query(f"with {P1}, x as (select corrected, case when corrected then 100 else confidence end c from p1) select corrected, count(c)::bigint as n, list_sort(list(c) filter (c is not null))[count(c) // 2 + 1] as median, count(*) filter (c < 50)::bigint as n_under_50 from x group by 1")
def typeface_comparison(spark, d):
    e = part1(spark, d, "corrected", "confidence").withColumn("c", overrides.effective_confidence(F.col("corrected"), F.col("confidence")))
    m = audit.upper_median(e, "c", ["corrected"])
    u = e.groupBy("corrected").agg(F.count_if(F.col("c") < 50).alias("n_under_50"))
    return m.join(u.withColumnRenamed("corrected", "_c"), m.corrected.eqNullSafe(F.col("_c"))).select("corrected", F.col("n").cast("long").alias("n"), "median", "n_under_50")


@query(f"""with {P1}, c as (select distinct lower(strip_accents(unnest(taxa))) c from p1), h as (select c, regexp_extract_all(c, '([a-z]+)', 1) w from c)
select c as cited from h where len(list_filter(w, lambda x: length(x) >= 3 and ((length(x) - length(regexp_replace(x, '[aeiouy]', '', 'g'))) / length(x) < 0.2 or regexp_matches(x, '[bcdfghjklmnpqrstvwxz]{{4}}')))) > 0""")
def implausible_words(spark, d):
    c = part1(spark, d, "taxa").select(F.explode("taxa").alias("c")).select(F.lower(tx.deaccent("c")).alias("cited")).distinct()
    return c.where(audit.implausible(F.regexp_extract_all("cited", F.lit("([a-z]+)"), F.lit(1))))


@query(f"with {P1} select x as flag, count(*)::bigint as n from (select unnest(flags) x from p1) group by 1")
def flag_histogram(spark, d):
    return part1(spark, d, "flags").select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"with {P1} select seq, headword, confidence from p1 where confidence is not null order by confidence, seq limit 25")
def worst_readings_topk(spark, d):
    return part1(spark, d, "headword", "confidence").where("confidence is not null").orderBy("confidence", "seq").limit(25).select("seq", "headword", "confidence")


@query(f"with {P2}, t as (select family, genus, coalesce(string_split(name, ' ')[2], '') species from p2) select family, genus, count(distinct species) filter (species <> '')::bigint as n_species, bool_or(species = '') as has_own_entry from t group by 1, 2")
def family_genus_tree(spark, d):
    t = part2(spark, d, "family", "genus", "name").withColumn("species", F.coalesce(F.get(F.split("name", " "), F.lit(1)), F.lit("")))
    return browse.family_tree(t, "family", "genus", "species")


# ---------------------------------------------------------------- search and browse
def index(spark, d) -> tuple[DataFrame, DataFrame]:
    t = taxa(spark, d).withColumn("name", F.trim("key"))
    return sr.index_names(names(spark, d)), sr.index_taxa(t)


def _pattern(q: str) -> str:
    return "".join(f"[{c}\u0001]" for c in q)


def _grade(key: str, q: str) -> str:
    """SQL for (rank, at) of the plain tiers."""
    p = _pattern(q)
    return f"case when regexp_matches({key}, '{p}') then length(regexp_extract({key}, '^(.*?){p}', 1)) else -1 end"


def name_sql(q: str) -> str:
    key = tx.fold_query(q)
    snd = tx.phonetic_query(key)
    n = len(key)
    mism = "len(list_filter(range(1, length(key) + 1), lambda i: key[i] <> '{q}'[i] and key[i] <> '\u0001')) <= 1".format(q=key)
    return f"""select 'name' as kind, id, name as label, (case when a >= 0 then case when a = 0 and length(key) = {n} then 0 when a = 0 then 2 else 4 end when b >= 0 then case when b = 0 and length(key) = {n} then 1 when b = 0 then 3 else 5 end else 7 end)::int as rank,
 (case when a >= 0 then a when b >= 0 then b else 0 end)::int as "at", (case when a >= 0 or b >= 0 then {n} else length(key) end)::int as len, case when a >= 0 then null when b >= 0 then 'phonetic' else 'near' end as via
 from (select *, {_grade("key", key)} a, {_grade(sound_sql("key"), snd) if n >= 3 else "-1"} b from names)
 where a >= 0 or b >= 0 or ({n >= 4} and case when contains(key, '\u0001') then length(key) = {n} and {mism} else levenshtein(key, '{key}') <= 1 end)"""


def taxon_sql(q: str) -> str:
    key = tx.fold_query(q)
    snd = tx.phonetic_query(key)
    n = len(key)
    return f"""select 'taxon' as kind, id, label, (case when r >= 4 then 8 else r end)::int as rank, "at"::int as "at", {n} as len, via from (select id, label, case when a >= 0 then case when a = 0 and length(k) = {n} then 0 when a = 0 then 2 else 4 end else case when b = 0 and length(k) = {n} then 1 when b = 0 then 3 else 5 end end r, case when a >= 0 then a else b end "at", case when a < 0 then 'phonetic' end via
 from (select id, label, k, {_grade("k", key)} a, {_grade(sound_sql("k"), snd) if n >= 3 else "-1"} b from tx)) where "at" >= 0"""


def note_sql(q: str) -> str:
    key = tx.fold_query(q)
    terms = [t for t in (tx.fold_query(w) for w in q.split()) if t]
    longest = max(terms, key=len)
    every = " and ".join(f"contains(nk, '{t}')" for t in terms) if len(terms) > 1 else "false"
    return f"""select 'taxon' as kind, id, label, (case when p > 0 then 9 else 10 end)::int as rank, (case when p > 0 then p - 1 else instr(nk, '{longest}') - 1 end)::int as "at", (case when p > 0 then {len(key)} else {len(longest)} end)::int as len, 'note' as via
 from (select id, label, nk, instr(nk, '{key}') p from tx) where p > 0 or ({every})"""


INDEX = NAMES + ", " + TAXA + f", tx as (select id, family, trim(key) label, {wild_sql('key')} k, {key_sql('notes')} nk from taxa)"
COLS = ["kind", "id", "label", "rank", "at", "len", "via"]


@query(f"with {INDEX} select * from ({name_sql('balaw')}) where via is null union all select * from ({taxon_sql('bron')}) where via is null and rank < 8")
def search_exact_prefix_contains(spark, d):
    n, t = index(spark, d)
    return sr.name_hits(n, "balaw").where("via is null").unionByName(sr.taxon_hits(t, "bron").where("via is null and rank < 8"))


@query(f"with {INDEX} select * from ({name_sql('Lemitó')}) where via = 'phonetic' union all select * from ({name_sql('mimu')}) where via = 'phonetic'")
def search_phonetic(spark, d):
    n, _ = index(spark, d)
    return sr.name_hits(n, "Lemitó").unionByName(sr.name_hits(n, "mimu")).where("via = 'phonetic'")


@query(f"with {INDEX} select * from ({name_sql('balewit')}) where via = 'near' union all select * from ({name_sql('tegumo')}) where via = 'near'")
def search_near(spark, d):
    n, _ = index(spark, d)
    return sr.name_hits(n, "balewit").unionByName(sr.name_hits(n, "tegumo")).where("via = 'near'")


@query(f"with {INDEX} select * from ({taxon_sql('anthus')}) where rank = 8")
def search_taxa_demoted(spark, d):
    return sr.taxon_hits(index(spark, d)[1], "anthus").where("rank = 8")


@query(f"with {INDEX} select * from ({note_sql('irritate the skin')}) where rank = 9")
def search_notes_phrase(spark, d):
    return sr.note_hits(index(spark, d)[1], "irritate the skin").where("rank = 9")


@query(f"with {INDEX} select * from ({note_sql('boils purple dye')}) where rank = 10")
def search_notes_words(spark, d):
    return sr.note_hits(index(spark, d)[1], "boils purple dye").where("rank = 10")


def _ranked_sql(q: str, names_where: str = "true", taxa_where: str = "true") -> str:
    t = taxon_sql(q).replace("from tx)", f"from tx where {taxa_where})")
    n = note_sql(q).replace("from tx)", f"from tx where {taxa_where})")
    m = name_sql(q).replace("from names)", f"from names left join nd using (key) where {names_where})")
    return f"select * from ({m}) union all select * from ({t}) union all select * from ({n}) where id not in (select id from ({t}))"


@query(f"with {INDEX} {_ranked_sql('bala')}")
def search_ranked(spark, d):
    """Flagship: names, taxa and notes in one ranked list."""
    n, t = index(spark, d)
    return sr.ranked(sr.search(n, t, "bala"))


@query(f"with {INDEX} {_ranked_sql('bel', names_where=chr(39) + '|' + chr(39) + ' || dialects || ' + chr(39) + '|' + chr(39) + ' like ' + chr(39) + '%|Mar|%' + chr(39) + ' and confidence >= 60 and upper(strip_accents(name[1])) = ' + chr(39) + 'B' + chr(39), taxa_where='upper(strip_accents(label[1])) = ' + chr(39) + 'B' + chr(39))}")
def search_filtered(spark, d):
    n, t = index(spark, d)
    return sr.ranked(sr.search(n, t, "bel", sr.Filters(min_confidence=60, dialect="Mar", letter="B")))


@query(f"with {INDEX} select 'name' as kind, id, name as label, 4 as rank, -1 as \"at\", 0 as len, null::varchar as via from names")
def search_empty_browse(spark, d):
    n, t = index(spark, d)
    return sr.search(n, t, "27 !")


@query()
def search_page(spark, d):
    """The second page of 200 hits in the order of presentation."""
    n, t = index(spark, d)
    return sr.page(sr.search(n, t, "be"), 1)


@query(f"with {NAMES} select id, name, regexp_extract(lower(strip_accents(name)), 'b[^a-z]*a[^a-z]*l[^a-z]*a') as marked from names where not regexp_matches(name, '[0-9�]') and regexp_matches(key, 'bala')")
def highlight_span(spark, d):
    n = names(spark, d).where(~F.col("name").rlike("[0-9�]")).where(F.contains("key", F.lit("bala")))
    return n.select("id", "name", F.lower(tx.deaccent(sr.highlight(F.col("name"), F.instr("key", "bala") - 1, F.lit(4)))).alias("marked"))


@query()
def snippet_window(spark, d):
    """Part of each note around the words "irritate the skin"."""
    q = tx.fold_query("irritate the skin")
    n = part2(spark, d, "notes").withColumn("k", tx.search_key("notes", False)).where(F.contains("k", F.lit(q)))
    return n.select("seq", sr.snippet(F.regexp_replace("notes", r"\s", " "), F.instr("k", q) - 1, F.lit(len(q))).alias("snippet"))


@query(f"with {NAMES} select upper(strip_accents(name[1])) as letter, count(*)::bigint as n_names from names where regexp_matches(upper(strip_accents(name[1])), '^[A-Z]$') group by 1")
def initial_letter_index(spark, d):
    return browse.letters(names(spark, d))


@query(f"with {NAMES} select id, name from names where upper(strip_accents(name[1])) = 'N'")
def browse_letter(spark, d):
    return browse.of_letter(names(spark, d), "N").select("id", "name")


@query(f"with {NAMES} select id, name from names join nd using (key) where '|' || dialects || '|' like '%|Zul|%'")
def browse_language(spark, d):
    return browse.of_language(names(spark, d), "Zul").select("id", "name")


@query(f"with {TAXA} select genus, count(*)::bigint as n_taxa from (select coalesce(string_split(key, ' ')[1], '') genus from taxa where family = 'Stomlornaceae') group by 1")
def browse_family(spark, d):
    t = taxa(spark, d).where("family = 'Stomlornaceae'").withColumn("genus", F.get(F.split("key", " "), F.lit(0)))
    return t.groupBy("genus").agg(F.count("*").alias("n_taxa"))


@query(f"""with {LINKS}, n as (select {wild_sql("headword")} k, min(seq) id, arg_min(headword, seq) as name, string_agg(distinct printed_page, ', ') filter (printed_page is not null) p, count(distinct printed_page)::bigint n_printed from p1 group by 1)
select n.id, n.name, n.n_printed, (select count(*) from links where name_key = 'balawit')::bigint as n_taxa from n where k = 'balawit'""")
def detail_lookup(spark, d):
    e = part1(spark, d, "headword", "printed_page").withColumn("k", tx.search_key("headword")).where("k = 'balawit'")
    one = e.groupBy("k").agg(F.min("seq").alias("id"), F.min_by("headword", "seq").alias("name"), F.count_distinct("printed_page").alias("n_printed"))
    t = links(spark, d).where("name_key = 'balawit'").agg(F.count("*").alias("n_taxa"))
    return one.crossJoin(F.broadcast(t)).select("id", "name", "n_printed", "n_taxa")


# ---------------------------------------------------------------- sinks, sets, tooling
@query()
def content_version_hash(spark, d):
    """One version stamp per stage table, timestamps aside."""
    rows = [(t, sinks.content_hash(read(spark, d, t), ("loaded_at", "recorded_at"))) for t in ("part1_vernacular", "part2_scientific", "taxa_corrections")]
    return spark.createDataFrame(rows, "table string, version string")


@query(GRAMMAR_SQL + f", {P2} select 1 as part, seq, x[1:300] as line from e where head is null union all select 2, seq, name from p2 where not regexp_matches(name, '^[A-Za-z. ]+$')")
def union_issues(spark, d):
    a = sinks.dead_letters(parsed_entries(spark, d), "parsed", "line_read").select(F.lit(1).alias("part"), "seq", F.col("line_read").alias("line"))
    b = part2(spark, d, "name").where(~F.col("name").rlike("^[A-Za-z. ]+$")).select(F.lit(2).alias("part"), "seq", F.col("name").alias("line"))
    return a.unionByName(b)


@query(f"with {P1}, {P2}, a as (select distinct upper(genus) g from p2 where genus is not null), b as (select distinct upper(regexp_extract(c, '([A-Za-z]{{3,}})', 1)) g from (select unnest(taxa) c from p1)), c as (select g from b where g <> '') select g as genus, 'listed' as side from a where g not in (select g from c) union all select g, 'present' from c where g not in (select g from a)")
def genus_drift(spark, d):
    a = part2(spark, d, "genus").where("genus is not null").select(F.upper("genus").alias("genus"))
    b = part1(spark, d, "taxa").select(F.explode("taxa").alias("c")).select(F.upper(F.regexp_extract("c", "([A-Za-z]{3,})", 1)).alias("genus")).where("genus <> ''")
    return sinks.drift(a, b, "genus")


@query(f"with {P1} select volume_id, count(*)::bigint as n_entries, count(*) filter (len(flags) > 0)::bigint as n_flagged, count(*) filter (len(taxa) = 0)::bigint as n_without_taxa, count(distinct page)::bigint as n_pages from p1 group by 1")
def parse_report(spark, d):
    e = part1(spark, d, "volume_id", "flags", "taxa", "page")
    return e.groupBy("volume_id").agg(F.count("*").alias("n_entries"), F.count_if(F.size("flags") > 0).alias("n_flagged"), F.count_if(F.size("taxa") == 0).alias("n_without_taxa"), F.count_distinct("page").alias("n_pages"))


@query(f"with {P1} select seq, confidence from p1 where confidence is null or confidence < 70")
def doubtful_entries(spark, d):
    return tooling.doubtful(part1(spark, d, "confidence"))


@query()
def headword_corrections(spark, d):
    """Corrections re-derived for every page: what the scanner read against the corrected headwords."""
    e = part1(spark, d, "volume_id", "page", "headword", "ocr_headword", "confidence")
    left = e.select("volume_id", "page", F.col("seq").cast("long").alias("line_no"), F.coalesce("ocr_headword", "headword").alias("text"), "confidence")
    right = e.select("volume_id", "page", F.col("seq").cast("long").alias("line_no"), F.col("headword").alias("text"))
    return tooling.headword_corrections(left, right, ["volume_id", "page"])


@query(f"with {P1}, k as (select *, regexp_replace(lower(strip_accents(headword)), '[^a-z]', '', 'g') h from p1), n as (select *, row_number() over (partition by volume_id, page, h order by seq) i, count(*) over (partition by volume_id, page, h) c from k) select f.correction_id, n.seq from taxa_corrections f join n on f.volume_id = n.volume_id and f.page = n.page and regexp_replace(lower(strip_accents(f.was)), '[^a-z]', '', 'g') = n.h and f.occurrence = n.i")
def keyed_transcript_match(spark, d):
    e = part1(spark, d, "volume_id", "page", F.col("headword").alias("head"))
    f = first_deliveries(read(spark, d, "taxa_corrections"), "correction_id", "volume_id", "page", F.col("was").alias("head"), F.col("occurrence").alias("nth"))
    return tooling.match_heads(e, f, ["volume_id", "page"])[0].select("correction_id", "seq")


@query(GRAMMAR_SQL + f", t as (select distinct unnest({MARKERS_SQL}) marker from e where head is not null) select marker, dialect_code as code from t left join ref_dialects on lower(regexp_replace(regexp_replace(regexp_replace(marker, '\\s+', '', 'g'), '^[,;.''‘’]+', ''), '[.:?''‘’]+$', '')) = lower(dialect_code)")
def canonical_markers(spark, d):
    t = parsed_entries(spark, d).where("parsed").select(F.explode(grammar.markers(F.col("locs"))).alias("marker")).distinct()
    codes = read(spark, d, "ref_dialects").select(F.lower("dialect_code").alias("_k"), F.col("dialect_code").alias("code"))
    return t.join(codes, F.lower(grammar.bare_marker(F.col("marker"))) == F.col("_k"), "left").select("marker", "code")


@query(f"""with {P1}, {P2}, l as (select volume_id, page, unnest(string_split(raw, chr(10))) line from p1 union all select volume_id, page, unnest(string_split(notes, chr(10))) from p2),
m as (select volume_id, case when regexp_matches(line, '^PART I\\. ') then 'part I' else 'part II' end section, min(page) first_page from l where regexp_matches(line, '^PART II?\\. ') group by 1, 2), z as (select volume_id, max(page) e from l group by 1)
select volume_id, section, first_page::int as first_page, greatest(first_page, coalesce(lead(first_page) over (partition by volume_id order by first_page, section) - 1, e))::int as last_page from m join z using (volume_id)""")
def section_pages(spark, d):
    a = part1(spark, d, "volume_id", "page", F.col("raw").alias("t")).unionByName(part2(spark, d, "volume_id", "page", F.col("notes").alias("t")))
    lines = a.select("volume_id", "page", F.explode(F.split("t", "\n")).alias("line"))
    return grammar.sections(lines, ["volume_id"], "page", "line", {"part I": r"^PART I\. ", "part II": r"^PART II\. "}).select("volume_id", "section", "first_page", "last_page")


@query(f"with {P1} select seq, box[3] < 0.05 or box[4] < 0.004 or box[4] > 0.6 as implausible, round(box[3] / (box[4] * 1.4), 6) as frame_aspect, round(100 / box[3], 6) as width, round(-100 * box[1] / box[3], 6) as left_offset from p1 where box is not null and box[3] > 0 and box[4] > 0")
def crop_boxes(spark, d):
    b = part1(spark, d, "box").where("box is not null and box[2] > 0 and box[3] > 0")
    c = scans.crop(F.col("box"), F.lit(1.4))
    return b.select("seq", scans.implausible_box(F.col("box")).alias("implausible"), F.round(c["frame_aspect"], 6).alias("frame_aspect"), F.round(c["width"], 6).alias("width"), F.round(c["left"], 6).alias("left_offset"))


@query("select event_id, case when event_id % 3 = 0 then 'name' when event_id % 3 = 1 then 'browse' end as kind, case when event_id % 3 = 0 then event_id end as id, case when event_id % 3 = 1 then 'family' end as view, case when event_id % 3 = 1 then event_type || ' x' end as key from events")
def routes(spark, d):
    n = F.col("event_id") % 3
    url = F.when(n == 0, F.concat(F.lit("#name/"), F.col("event_id").cast("string"))).when(n == 1, F.concat(F.lit("#browse/family/"), F.col("event_type"), F.lit("%20x"))).otherwise(F.lit("#name/x"))
    r = browse.route(url)
    return read(spark, d, "events").select("event_id", *[r[c].alias(c) for c in ("kind", "id", "view", "key")])


@query()
def page_sequence_align(spark, d):
    """Pages of Part I against the same pages three leaves on, as another scan of the book would have them."""
    p = part1(spark, d, "volume_id", "page", "raw").groupBy("volume_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda s: s["raw"]), " ").alias("text"))
    p = cut(p)
    return match.align_page_sequences(p, p.withColumn("page", F.col("page") + 3), ["volume_id"], "page", "text")


@query()
def locate_on_scan(spark, d):
    """Where the headword of each entry stands among the lines of its page's markup."""
    h = hocr_markup(spark, d).withColumn("_k", F.struct("volume_id", F.col("page").alias("leaf")))
    w = scans.hocr_words(h.select("_k", "html"), "_k", "html")
    lines = w.groupBy(F.col("_k.volume_id").alias("volume_id"), F.col("_k.leaf").alias("page"), F.col("line").cast("long").alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda s: s["text"]), " ").alias("text"))
    e = part1(spark, d, "volume_id", "page", "headword").where("headword is not null").select("volume_id", "page", "seq", F.col("headword").alias("text"))
    return locate(e, cut(lines), ["volume_id", "page"], "seq", "text")


QUERIES |= {"p4_found": orphans.p4_found, "p4_orphans_by_month": orphans.p4_orphans_by_month}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
