from conftest import at

from vernalex.llm import noise


def kinds(part1, part2, p1=(), p2=()):
    return {(r.src_table[:5], r.seq, r.field_name, r.kind) for r in noise.damage(part1(*p1), part2(*p2)).collect()}


def entry(seq, raw, headword=None, **kw):
    return {"seq": seq, "raw": raw, "headword": headword or raw.split(",")[0], "page": 19, "printed_page": "11"} | kw


def test_entries(part1, part2):
    head = "NAMES OF MEDICINAL HERBS"
    p1 = [
        entry(1, "BADÍ, Sur. Petrosta zongrirrta Pettig.--Vendia alba and other species."),
        entry(2, "BA*Í, Sur. Petrosta alba"),
        entry(3, "BÁDI, Sur. Petros-\ntA alba".replace("tA", "ta")),
        entry(4, "BÁDI, Sur. Petro- sta alba"),
        entry(5, "BÁDI, Sur. Petrosta alba.\n19"),
        entry(6, "BÁDI, Sur. Petrosta q--"),
        entry(7, "BÁDI-\nBÁDI, Sur. Petrosta [illegible]", headword="BÁDI-BÁDI"),
        entry(8, "BÁ1I, H1l. Petrosta alba", headword="BÁDI", ocr_headword="BÁ1I"),
        entry(9, "BÁdI, Sur. 'Petrosta alba?"),
        entry(10, "BÁDI (Zambal-Norte), Cr.-Or. Petrosta Q.Mor.", headword="BÁDI"),
        entry(11, "BÁDI, Sur. Petrosta alba and othcr spccies."),
        entry(20, f"{head}    l9\nBÁDI, Sur. Petrosta alba", page=20),
        entry(21, f"BÁDI, Sur. \n{head}\n    Petrosta alba", page=21),
        entry(22, "NAMFS OF MED1CINAL HERBS.\nBÁDI, Sur. Petrosta alba", page=22, headword="BÁDI"),
        entry(23, f"{head}\nBÁDI, Sur. Petrosta alba", page=23, headword="BÁDI"),
        entry(24, "", headword=""),
        {"seq": 25, "raw": None, "headword": None},
        entry(5, "BÁDI, Sur. Petrosta alba.\n19", loaded_at=at(20)),
    ]
    for e in p1:
        if e["seq"] in (20, 21):
            e["headword"] = "BÁDI"
    # the corpus knows the words that entries 1 and 11 end with
    p1 += [entry(k, "BÁDI, Sur. Vendia alba and other species.") for k in range(50, 75)]
    got = kinds(part1, part2, p1)
    assert got == {
        ("part1", 2, "raw", "chars"), ("part1", 2, "headword", "chars"), ("part1", 3, "raw", "hyphen"), ("part1", 4, "raw", "hyphen"), ("part1", 5, "raw", "furniture"), ("part1", 7, "raw", "hyphen"), ("part1", 8, "raw", "chars"),
        ("part1", 9, "raw", "chars"), ("part1", 9, "headword", "chars"), ("part1", 11, "raw", "chars"), ("part1", 20, "raw", "furniture"), ("part1", 21, "raw", "furniture"), ("part1", 22, "raw", "furniture"), ("part1", 23, "raw", "furniture"),
    }


GOOD = "The wood is used for making rope and the leaves, which are one- to\nthree-clustered, burn with a yellow flame."


def notes(seq, text, **kw):
    return {"seq": seq, "name": "X", "notes": text, "page": 72, "printed_page": "64"} | kw


def test_notes(part1, part2):
    p2 = [notes(k, GOOD) for k in range(100, 140)] + [
        notes(1, "The wood is used for mak-\ning rope."),
        notes(2, "The wood is used for mak- ing rope."),
        notes(3, "Tbe wood is used for making rope."),
        notes(4, "The wo0d is used."),
        notes(5, "The wood is\n72\nused."),
        notes(6, "The wood is us�d."),
        notes(7, "The leaves, one-\nto three-clustered."),
        notes(8, None),
        notes(9, "x " * 20_000),
        notes(10, "The wood is fr()m rope; 10 to 20 leaves."),
    ]
    got = {g for g in kinds(part1, part2, (), p2) if g[1] < 100}
    assert got == {("part2", 1, "notes", "hyphen"), ("part2", 2, "notes", "hyphen"), ("part2", 3, "notes", "chars"), ("part2", 4, "notes", "chars"), ("part2", 5, "notes", "furniture"), ("part2", 6, "notes", "chars"), ("part2", 10, "notes", "chars")}


def test_notes_are_searched_once(part1, part2, monkeypatch):
    from vernalex.plans import lineage

    plans, cut, small = [], lineage.cut, lineage.small

    def spy(df, *by):
        plans.append(df)
        return cut(df, *by)

    for m in (lineage, noise):
        monkeypatch.setattr(m, "cut", spy)
    p2 = [notes(k, GOOD) for k in range(100, 140)] + [notes(1, "The wood is used for mak-\ning rope."), notes(2, "Good for mak-ing rope."), notes(3, "Tbe wood is used.")]
    out = noise.damage(part1(), part2(*p2))
    plans.append(out)
    shown = [df._jdf.queryExecution().optimizedPlan().toString() for df in plans]
    # breaks are marked for one written table; words are split off the notes there and, where these change, off the rejoined ones
    assert sum(f"$1{noise.TORN}" in x for x in shown) == 1
    assert sum(r"[^\p{L}]+" in x for x in shown) == 2
    want = {("part2_scientific", 1, "notes", "hyphen"), ("part2_scientific", 2, "notes", "hyphen"), ("part2_scientific", 3, "notes", "chars")}
    assert {tuple(r) for r in out.collect()} == want
    # more misread words than can be broadcast
    monkeypatch.setattr(noise, "small", lambda df: small(df, -1))
    assert {tuple(r) for r in noise.damage(part1(), part2(*p2)).collect()} == want


def test_every_marked_text_is_looked_at(spark):
    from pyspark.sql import functions as F

    marks = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    marks = marks.unionByName(spark.createDataFrame([("()",), (".b",), (",ab",), ("!!",), ("1st",)], "c string"))
    texts = marks.select(F.explode(F.array(*[F.concat(F.lit(a), "c", F.lit(b)) for a in ("", "a", "A", " ", "(") for b in ("", "a", "ab", "B", " ", ")")])).alias("t"))
    held = F.col("t").rlike(noise.MARKED)
    assert texts.where(held).count() > 5_000
    assert texts.where(held & ~F.col("t").rlike(noise.MAYBE_MARKED)).count() == 0


def test_repair(part1, part2):
    p2 = [notes(k, GOOD) for k in range(100, 140)] + [notes(1, "Tbe wo0d is\n72\nus�d for mak-\ning rope.")]
    p1 = [entry(1, "BÁDI-\nBÁDI, Sur. Petros-\nta alba\n19", headword="BÁDI-BÁDI")]
    got = {(r.seq, r.field_name): r.text for r in noise.repaired(part1(*p1), part2(*p2)).collect()}
    assert got[(1, "raw")] == "BÁDI-BÁDI, Sur. Petrosta alba"
    assert got[(1, "notes")] == "The wood is used for making rope."
    assert got[(100, "notes")] == GOOD.replace("\n", " ")


def test_breaks_by_the_corpus(part1, part2):
    plain = "The leaves are three-clustered; the wood is for making rope."
    p2 = [notes(k, plain) for k in range(100, 140)] + [
        notes(1, "Leaves Three-\nclustered, some three- clustered."),
        notes(2, "Good for mak-ing and mak-\ning rope."),
        notes(3, "An un-\nheard word; one- or\ntwo-\nto three-clustered."),
    ]
    got = {r.seq: r.text for r in noise.repaired(part1(), part2(*p2)).collect()}
    assert got[1] == "Leaves Three-clustered, some three-clustered."
    assert got[2] == "Good for making and making rope."
    assert got[3] == "An unheard word; one- or two- to three-clustered."
    assert got[100] == plain
    assert kinds(part1, part2, (), p2) == {("part2", k, "notes", "hyphen") for k in (1, 2, 3)}


def test_repair_of_entries(part1, part2):
    p1 = [entry(k, "BÁDIN NGA LOTE, Hil. Petrosta cuplicum Olm.") for k in range(100, 103)] + [
        entry(1, "BÁD*N, H1l. Petrosta cupl1cum Olm."),
        entry(2, "S3TÍ-SeT|, Sur. Pe|rosta alba and othcr spccies."),
        *[entry(k, "BÁDIN NGA LOTE, Hil. Petrosta cuplicum and other species.") for k in range(110, 136)],
        entry(3, "LO.TE; Hil. Petrosta [illegible] 2nd"),
        entry(4, "XU}AN, Sur. Petrosta"),
        entry(5, "BÁ1I, Sur. Petrosta", headword="BÁDI", ocr_headword="BÁ1I"),
        entry(7, "MÍL0-MÍLO, Sur.\nPetrosta q--"),
    ]
    next(e for e in p1 if e["seq"] == 3)["headword"] = "LO.TE"
    got = {(r.seq, r.field_name): r.text for r in noise.repaired(part1(*p1), part2()).collect()}
    assert got[(1, "headword")] == "BÁDIN" and got[(1, "raw")] == "BÁDIN, Hil. Petrosta cuplicum Olm."
    assert got[(2, "headword")] == "SETÍ-SET|" and got[(2, "raw")] == "SETÍ-SET|, Sur. Petrosta alba and other species."
    assert got[(3, "headword")] == "LOTE" and got[(3, "raw")] == "LOTE; Hil. Petrosta [illegible] 2nd"
    # a mark that may be any letter is not guessed
    assert got[(4, "headword")] == "XU}AN"
    assert got[(5, "raw")] == "BÁDI, Sur. Petrosta"
    assert got[(7, "headword")] == "MÍLO-MÍLO" and got[(7, "raw")] == "MÍLO-MÍLO, Sur. Petrosta q--"
    assert got[(100, "raw")] == p1[0]["raw"]


def test_a_heading_misread_in_another_way_on_each_page(part1, part2):
    heads = ["FLORA OF THE OUTER PROVINCES", "FL0RA OF THF OUTER PROVINCES", "FLORA OF TIIE OUTER PR0VINCES", "FLORA OE THE OUTER PROVINCFS", "FLQRA OF THE OUTFR PROVINCES 44"]
    p1 = [entry(k, f"BÁDI, Sur.\n{h}\nPetrosta alba", page=30 + k) for k, h in enumerate(heads)] + [entry(9, "BÁDI, Sur.\nANOTHER LINE WITHOUT FELLOWS\nPetrosta alba", page=40)]
    assert {g[1] for g in kinds(part1, part2, p1) if g[3] == "furniture"} == set(range(5))


def test_many_headings(spark, part1, part2):
    from pyspark.sql import functions as F

    head = F.translate(F.substring(F.sha2(F.floor(F.col("id") / 3).cast("string"), 256), 1, 40), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    head = F.concat_ws(" ", F.lit("QUIRE"), F.substring(head, 1, 20), F.substring(head, 21, 20))
    rows = spark.range(3 * 5_100).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("int").alias("page"), F.concat(F.lit("BÁDI, Sur.\n"), head, F.lit("\nPetrosta alba")).alias("raw"))
    p1 = part1().drop("seq", "page", "raw").limit(0)
    p1 = rows.join(p1.withColumn("seq", F.lit(0)), "seq", "left").withColumns({"headword": F.lit("BÁDI"), "loaded_at": F.current_timestamp()})
    got = noise.damage(p1, part2()).where("kind = 'furniture'")
    assert got.count() == 3 * 5_100


def test_long_words(part1, part2):
    long = "abcdefghij" * 6
    p2 = [notes(k, f"The {long}h wood is used for making rope.") for k in range(100, 140)] + [notes(1, f"The {long}b wood is used."), notes(2, "y" * 100_000)]
    assert {g for g in kinds(part1, part2, (), p2) if g[1] < 100} == {("part2", 1, "notes", "chars")}


def test_empty(part1, part2):
    assert kinds(part1, part2) == set()


def test_clash(part1, part2):
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("text", "own", "body", "furniture", "kind", "word", "n", "line")}
    assert noise.damage(part1(entry(2, "BA*Í, Sur. Petrosta alba")).withColumns(extra), part2().withColumns(extra)).count() == 2
