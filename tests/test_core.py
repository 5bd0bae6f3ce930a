"""Golden lines and invariants of the reference's operators, beside the SQL checks of test_queries.py."""

import random

import pytest
from pyspark.sql import functions as F

from vernalex.functions import text as tx
from vernalex.operators import align, audit, carry, grammar, graph, match, overrides, search, tooling
from vernalex.sources import scans, sinks


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("s,key", [("L6po-l6po", "lopolopo"), ("c4gon", "cagon"), ("DÚÑGON", "dungon"), ("a�b", "a\u0001b"), ("x27y", "xy"), ("", ""), (None, None)])
def test_search_key(spark, s, key):
    assert one(spark, tx.search_key("s"), s) == key
    if s and "�" not in s:
        assert tx.fold_query(s) == key


@pytest.mark.parametrize("a,b", [("ARÓRO", "ARÚRU"), ("DÓSOL", "DÚSUL"), ("TENÁAN", "TINÁAN"), ("BÓBOI", "BÓBOY")])
def test_phonetic(spark, a, b):
    assert one(spark, tx.phonetic(tx.search_key("s")), a) == one(spark, tx.phonetic(tx.search_key("s")), b)


def test_display(spark):
    assert one(spark, tx.initial_of("s"), "ÑGÁLUY") == "N"
    assert one(spark, tx.display_binomial("s"), "B. CUMGLAROSA") == "B. cumglarosa"
    assert one(spark, tx.entity_decode("s"), "&amp;lt; &lt;b&gt; &#39;&quot;") == "&lt; <b> '\""
    r = one(spark, tx.split_authority("s"), "Licuala spectabilis Miq.")
    assert (r.name, r.authority) == ("Licuala spectabilis", "Miq.")


GOLDEN = [
    ("ANAHAO, T., V. Licuala spectabilis Miq.", "ANAHAO", ", T., V.", None, "Licuala spectabilis Miq."),
    ("AMORES SECOS, Sp.-Fil. Chrysopogon aciculatus", "AMORES SECOS", ", Sp.-Fil.", None, "Chrysopogon aciculatus"),
    ("Captiao, V., T.- Cynomorium coccineum Blanco.", "Captiao", ", V., T.", None, "Cynomorium coccineum Blanco."),
    ("Ma.arsis, T. Malaisia tortuosa Blanco.", "Maarsis", ", T.", None, "Malaisia tortuosa Blanco."),
    ("Dam6-Hia; T. Mimosa pudica L.", "Dam6-Hia", "; T.", None, "Mimosa pudica L."),
    ("Buyén (Balabac). Mussaenda grandiflora Rolfe.", "Buyén", None, "Balabac", "Mussaenda grandiflora Rolfe."),
    ("Bitis (Zamboanga). 'Trewia.", "Bitis", None, "Zamboanga", "Trewia."),
    ("AGAS-As. Scolopia", "AGAS-As", None, None, "Scolopia"),
    ("AJOS-AJOS NGA MApoTi, V. Habranthus", "AJOS-AJOS NGA MApoTi", ", V.", None, "Habranthus"),
    ("HoJAS DE BUYO. Piper betle L.", "HoJAS DE BUYO", None, None, "Piper betle L."),
    (".ManaBanaBA, T. Duabanga moluccana Blume.", "ManaBanaBA", ", T.", None, "Duabanga moluccana Blume."),
]


def test_entry_grammar(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN] + [("Forst.",), ("species",), ("12",), ("",)], "line string")
    got = {r.line: r for r in grammar.parse_entry_lines(df, "line").collect()}
    for line, head, locs, place, sci in GOLDEN:
        r = got[line]
        assert (r["head"], r.locs, r.place, r.sci) == (head, locs, place, sci), line
    assert not got["Forst."].parsed and not got["species"].parsed
    assert "12" not in got and "" not in got


def test_taxon_list(spark):
    assert one(spark, grammar.taxon_list(F.col("s")), "Vitex negundo L.--Vitex obovata Thunb.") == ["Vitex negundo L", "Vitex obovata Thunb"]


@pytest.mark.parametrize("line,heading", [
    ("A. ASPERA Linn.", True), ("Cocos NuciFERA Linn.", True), ("Cyperus. (Cyperaceae.)", True), (". ARGENTEA Blume.", True), (">>. MINUTIFLORA Bedd.", True), ("  MARIANENSIS Chois. Tugui, T.", True),
    ("Mobóti, V.;", False), ("Cachtimba, Il.;", False), ("Arbon (Paragua); Baraybay, T.", False), ("        deep", False), ("wrapped prose", False), ("123", False),
])
def test_headings(spark, line, heading):
    assert one(spark, grammar.is_heading(F.col("s")), line) is heading


def test_restore_initial(spark):
    for line in (". ARGENTEA Blume.", ">>. MINUTIFLORA Bedd.", "Pp>p>. ROLFEI Vidal.", "  MARIANENSIS Chois."):
        assert one(spark, grammar.restore_initial(F.col("s")), line).startswith("?. ")
    assert one(spark, grammar.restore_initial(F.col("s")), "A. ASPERA Linn.") == "A. ASPERA Linn."


def test_run_together(spark):
    df = spark.createDataFrame([(1, "A. LUCIDA Benth. Tinaqui, V. A. ODORATISSIMA Benth."), (2, "AFZELIA BIJUGA A. Gray."), (3, None)], "k int, text string")
    got = [(r.k, r.piece, r.text) for r in grammar.split_run_together(df, "text").orderBy("k", "piece").collect()]
    assert got == [(1, 0, "A. LUCIDA Benth. Tinaqui, V."), (1, 1, "A. ODORATISSIMA Benth."), (2, 0, "AFZELIA BIJUGA A. Gray.")]


def test_block(spark):
    r = one(spark, grammar.parse_block(F.col("s")), "ACHRAS SAPOTA Linn. (Sapotaceae.) A tree. Chico, T.; Sapote (Masbate)")
    assert (r.name, r.authority, r.family_raw) == ("ACHRAS SAPOTA", "Linn", "Sapotaceae")
    n = one(spark, grammar.split_notes(F.col("s")), r.rest)
    assert n.notes == "A tree." and [(v.name, v.dialects, v.place) for v in n.vernaculars] == [("Chico", ["T"], None), ("Sapote", [], "Masbate")]
    r = one(spark, grammar.parse_block(F.col("s")), "A. PAVONINA Linn. A tall tree.")
    assert (r.name, r.authority) == ("A. PAVONINA", "Linn")


def test_margin(spark):
    lines = [(1, " " * 6 + "x" * 30)] * 5 + [(1, "stray line of more than twenty")] + [(1, " " * 9 + "y" * 30)] * 5
    assert grammar.page_margins(spark.createDataFrame(lines, "page int, line string"), ["page"], "line").first().margin == 6


def brute_near(left, right):
    def d(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    out = {}
    for a in left:
        hits = sorted(b for b in right if d(a, b) <= 1)
        out[a] = (a, "exact") if a in right else (hits[0], "near") if len(hits) == 1 else (None, "ambiguous" if hits else "none")
    return out


def test_near_lookup_against_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    left, right = words[:80] + words[:5], words[60:]
    frames = [spark.createDataFrame([(w,) for w in ws] + [(None,)], "key string") for ws in (left, right)]
    got = {r.key: (r.found, r.how) for r in match.near_lookup(*frames, "key").collect()}
    assert got == brute_near(set(left), set(right))


def test_snap(spark):
    fam = spark.createDataFrame([(1, "Leguminosae"), (2, "Apocynaceae"), (3, "Amarantaceae")], "i int, f string")
    v = spark.createDataFrame([("Legwminosew",), ("Apocinacee",), ("Amarantacew",), ("Leguminosae",), ("Cebu",), (None,)], "v string")
    got = {r.v: (r.snapped, r.how) for r in match.snap(v, "v", fam, "f", "i").collect()}
    assert got["Leguminosae"] == ("Leguminosae", "exact") and got["Cebu"] == (None, "none")
    assert got["Legwminosew"][0] == "Leguminosae" and got["Apocinacee"][0] == "Apocynaceae" and got["Amarantacew"][0] == "Amarantaceae"


def test_stubs_are_sequential(spark):
    keys = spark.createDataFrame([("abcd", 1), ("abce", 2), ("zzzz", 3), ("known", 4), ("knowm", 5), ("abxe", 6)], "key string, order long")
    known = spark.createDataFrame([("known",)], "key string")
    got = {r.key: (r.target, r.how) for r in graph.resolve_stubs(keys, known).collect()}
    assert got == {"abcd": ("abcd", "stub"), "abce": ("abcd", "near"), "zzzz": ("zzzz", "stub"), "known": ("known", "exact"), "knowm": ("known", "near"), "abxe": ("abxe", "stub")}


def test_overrides_applied_or_stale_once(spark):
    e = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "seq int, head string")
    e = overrides.number_occurrences(e, ["head"], ["seq"])
    c = spark.createDataFrame([(1, "A", 2), (2, "A", 3), (3, "B", 1), (4, "B", 1), (5, None, 1)], "cid int, head string, occurrence int")
    applied, stale = overrides.override(e, c, ["head", "occurrence"], "cid")
    on = {r.seq: r.cid for r in applied.collect()}
    assert on == {1: None, 2: 1, 3: 4} and {r.cid for r in stale.collect()} == {2, 3, 5}


def test_carry_down_equals_plain_window(spark):
    rng = random.Random(2)
    rows = [(v, i // 7, i, rng.choice([None, None, f"g{i}"])) for v in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "v int, page int, seq int, g string")
    got = {(r.v, r.seq): r.open for r in carry.carry_down(df, "g", "seq", ["v"], "page", "open").collect()}
    for v in (1, 2):
        last = None
        for r in [x for x in rows if x[0] == v]:
            last = r[3] or last
            assert got[(v, r[2])] == last


def test_alignment():
    assert align.align(["a", "b", "c"], ["a", "c"], lambda x, y: 1.0 if x == y else 0.0) == [(0, 0), (1, None), (2, 1)]
    assert align.ordered_similarity("abc", "abc") == 1.0 and align.ordered_similarity("", "") == 0.0 and align.ordered_similarity("BÁDI-badi", "badibadi") == 1.0 and align.ordered_similarity("TEGUMO", "TEXGUMO") == 12 / 13 and align.ordered_similarity("", "a") == 0.0
    assert align.prefix_similarity("BALAWIT, Isa. Migrenis", "BALAWIT") == 1.0


def test_align_pages(spark):
    a = spark.createDataFrame([(1, 1, "ABC"), (1, 2, "DEF"), (2, 3, "X"), (1, 4, None)], "page int, seq long, text string")
    b = spark.createDataFrame([(1, 9, "DEF"), (3, 7, "Y")], "page int, seq long, text string")
    got = {(r.page, r.left_seq, r.right_seq) for r in align.align_pages(a, b, ["page"], "seq", "text").collect()}
    assert (1, 2, 9) in got and (2, 3, None) in got and (3, None, 7) in got


def test_upper_median(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 3, 4)] + [(2, None)], "g int, v int")
    got = {r.g: (r.n, r.n_missing, r.median) for r in audit.upper_median(df, "v", ["g"]).collect()}
    assert got == {1: (4, 0, 3), 2: (0, 1, None)}


def hits(spark, words, q):
    n = search.index_names(spark.createDataFrame([(i, w, ["M"], 90) for i, w in enumerate(words)], "id int, name string, dialects array<string>, confidence int"))
    return {r.label: (r.rank, r.at, r.len, r.via) for r in search.name_hits(n, q).collect()}


def test_search_tiers(spark):
    got = hits(spark, ["DÚÑGON", "DONGÓN", "DUÑGÚN", "MALADÚÑGUN", "D�NGON", "DUNGEN", "OTHER"], "dungon")
    assert got["DÚÑGON"] == (0, 0, 6, None) and got["DONGÓN"] == (1, 0, 6, "phonetic") and got["DUÑGÚN"] == (1, 0, 6, "phonetic")
    assert got["MALADÚÑGUN"] == (5, 4, 6, "phonetic") and got["D�NGON"][0] == 0 and got["DUNGEN"] == (7, 0, 6, "near") and "OTHER" not in got


def test_short_and_empty_queries(spark):
    assert hits(spark, ["DÚÑGON", "DONG"], "do") == {"DONG": (2, 0, 2, None)}
    assert set(hits(spark, ["AB", "CD"], "27 !").values()) == {(4, -1, 0, None)}


def test_wild_near(spark):
    assert hits(spark, ["BAL�WIX"], "balawit")["BAL�WIX"][0] == 7
    assert hits(spark, ["BAL�WITO"], "balowit")["BAL�WITO"][0] in (2, 7)


def test_highlight_round_trip(spark):
    for name, q in (("MALADÚÑGUN", "dungun"), ("L6po-l6po", "polop"), ("A B-C", "bc")):
        k = tx.fold_query(name)
        marked = one(spark, search.highlight(F.col("s"), F.lit(k.index(q)), F.lit(len(q))), name)
        assert tx.fold_query(marked) == q


def test_snippet(spark):
    t = "one two three used in the practice of medicine " + "tail " * 40
    k = tx.fold_query(t)
    s = one(spark, search.snippet(F.col("s"), F.lit(k.index("practice")), F.lit(8)), t)
    assert "practice" in s and s.startswith("…") and s.endswith("…")


def test_hocr(spark):
    html = "<div class='ocr_page'><span class='ocr_line'><span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 90'>A&amp;B</span> <span class='ocrx_word' title='bbox 5 2 9 4; x_wconf 40'> </span></span></div>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "no markup")], "k int, html string")
    got = scans.hocr_words(df, "k", "html").collect()
    assert [(r.k, r.page, r.line, r.text, r.conf, r.x0, r.y1) for r in got] == [(1, 0, 0, "A&B", 90, 1, 4)]


def test_page_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\f\fc\n\f \n"), (2, None)], "k int, t string")
    got = [(r.k, r.page, r.line_no, r.line) for r in scans.page_lines(df, "k", "t").orderBy("page", "line_no").collect()]
    assert got == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, ""), (1, 3, 1, "c"), (1, 3, 2, "")]


def test_readers(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"page": 3, "source": "s", "entries": [{"page": 3, "was": "A", "headword": "B"}]}')
    r = scans.read_corrections(spark, str(tmp_path)).first()
    assert (r.page, r.was, r.headword, r.pos) == (3, "A", "B", 0)
    (tmp_path / "n").mkdir()
    (tmp_path / "n/x.json").write_text('{"pages": [{"leafNum": 1, "pageNumber": "7"}, {"leafNum": 2}]}')
    assert [tuple(r) for r in scans.read_page_numbers(spark, str(tmp_path / "n")).collect()] == [(1, "7")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("# note\n\n HEAD#2 | Xus albus\nOTHER | -\n")
    rows = scans.read_transcript(spark, str(tmp_path / "t")).select(scans.transcript_item(F.col("line")).alias("i")).collect()
    assert [(r.i["head"], r.i.nth, r.i.rest) for r in rows] == [("HEAD", 2, "Xus albus"), ("OTHER", None, "-")]


def test_write_if_changed(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 10)], "k int, v string, stamp int")
    assert sinks.write_if_changed(spark, a, p, ("stamp",))
    assert not sinks.write_if_changed(spark, a.withColumn("stamp", F.lit(11)).orderBy(F.desc("k")), p, ("stamp",))
    assert sinks.write_if_changed(spark, a.union(a.limit(1)).cache(), p, ("stamp",))


def test_tooling(spark):
    e = spark.createDataFrame([(1, 1, "A-B"), (1, 2, "A B"), (1, 3, "C")], "page int, seq int, head string")
    i = spark.createDataFrame([(1, "ab", 2), (1, "AB", None), (1, "c", None), (1, "d", None)], "page int, head string, nth int")
    matched, refused = tooling.match_heads(e, i, ["page"])
    assert {(r["head"], r.seq) for r in matched.collect()} == {("ab", 2), ("c", 3)} and {r["head"] for r in refused.collect()} == {"AB", "d"}


def test_guard(spark):
    a = spark.createDataFrame([(0.9,), (0.1,), (None,)], "similarity double")
    with pytest.raises(ValueError):
        audit.guard_alignment(a)


@pytest.mark.parametrize("token,code", [("I].", "Il"), ("VY.", "V"), ("It.", "Il"), ("IT.", "T"), ("sp.-fil.", "Sp.-Fil"), ("Bic.", None), (" v.", "V"), (None, None)])
def test_canonical_marker(spark, token, code):
    c = grammar.canonical_marker(F.col("s"), ["Il", "V", "T", "Sp.-Fil"], {"I]": "Il", "VY": "V", "It": "Il", "IT": "T"})
    assert one(spark, c, token) == code


def test_sections(spark):
    rows = [(1, 1, "cover"), (1, 5, "PART I"), (1, 6, "PART I"), (1, 9, "PART II"), (1, 12, "end"), (2, 3, "x")]
    got = grammar.sections(spark.createDataFrame(rows, "v int, page int, line string"), ["v"], "page", "line", {"a": "^PART I$", "b": "^PART II$"})
    assert {tuple(r) for r in got.select("v", "section", "first_page", "last_page").collect()} == {(1, "a", 5, 8), (1, "b", 9, 12)}


def test_routes(spark):
    from vernalex.operators import browse

    r = one(spark, browse.route(F.col("s")), "#browse/family/A%20b")
    assert (r.kind, r.id, r.view, r.key) == ("browse", None, "family", "A b")
    assert one(spark, browse.route(F.col("s")), "#taxon/12").id == 12 and one(spark, browse.route(F.col("s")), "#x") is None
    assert one(spark, grammar.unresolved_family(F.col("s")), "X alba (Xaceae.) tree") == "Xaceae" and one(spark, grammar.unresolved_family(F.col("s")), "(Tay)") is None


def test_boxes(spark):
    b = one(spark, scans.normal_box(*[F.lit(float(x)) for x in (0, 100, 500, 130, 1000, 2000)]), "")
    assert b == [0.0, 0.047, 0.508, 0.021]
    assert one(spark, scans.implausible_box(F.array(*[F.lit(x) for x in (0.1, 0.1, 0.01, 0.1)])), "") is True


def test_page_sequences(spark):
    rng = random.Random(4)
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(90)) for _ in range(30)]
    ours = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)] + [(1, 40, ""), (1, 41, "nothing alike anywhere")], "v int, page int, text string")
    theirs = spark.createDataFrame([(1, i + 2 + (i > 20), w) for i, w in enumerate(words)], "v int, page int, text string")
    got = {r.page: r.their_page for r in match.align_page_sequences(ours, theirs, ["v"], "page", "text").collect()}
    assert got == {i: i + 2 + (i > 20) for i in range(30)} | {40: None, 41: None}


def test_locate(spark):
    e = spark.createDataFrame([(1, 1, "ABACA tree"), (1, 2, "BALITE fig")], "page int, seq long, text string")
    lines = spark.createDataFrame([(1, 0, "123"), (1, 1, "ABACA tree used"), (1, 2, "for rope"), (1, 3, "BALITE fig"), (1, 4, "STOP")], "page int, seq long, text string")
    got = {(r.seq, r.first_line, r.last_line) for r in align.locate(e, lines, ["page"], "seq", "text", span=True, stop=lambda t: t == "STOP").collect()}
    assert got == {(1, 1, 2), (2, 3, 3)}


def test_corrections_written_and_read(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "ABACA ALBA", "Xaceae"), (1, 2, "BETULA NIGRA", None)], "page int, line_no long, text string, family string")
    t = spark.createDataFrame([(1, 1, "ABACA ALBA", "Yaceae"), (1, 2, "BETULLA NIGRA", None)], "page int, line_no long, text string, family string")
    c = tooling.name_corrections(e, t, ["page"])
    assert {(r.was, r.name, r.family) for r in c.collect()} == {("ABACA ALBA", "ABACA ALBA", "Yaceae"), ("BETULA NIGRA", "BETULLA NIGRA", None)}
    sinks.write_corrections(c, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).where("page = 1").count() == 2
