import pytest

from vernalex.llm.canonical import NONE, Dialects, Families, Trie, canonical_values, limit

FAM = Families([("Stomlornaceae", None), ("Cremflenaceae", None), ("Crlmflemaceae", None), ("Brustarniferae", None), ("Lommibaceae", "Drorcrunosae"), ("Zumgenebineae", None)])
DIA = Dialects([("A", "Adoran"), ("Cor", "Corvayan"), ("Kal", "Kaltaran"), ("M", "Marindi"), ("Mar", "Maranti"), ("Or", "Orzuelo"), ("Cr.-Or", "Creole Orzuelo"), ("Lum", "Lumbanes")])


@pytest.mark.parametrize("v,c", [
    ("Stomlornacece", "Stomlornaceae"), ("STOMLORNACEAE", "Stomlornaceae"), ("Stomlo�naceae", "Stomlornaceae"), ("Stom- lornaceae", "Stomlornaceae"), ("fam Stomlornaceae.", "Stomlornaceae"), ("(Stomlornaceae (?)", "Stomlornaceae"),
    ("Stomlornaceae Hartl.", "Stomlornaceae"), ("Stomlorn.", "Stomlornaceae"), ("Stomlornacew", "Stomlornaceae"), ("crlmflemaceae", "Crlmflemaceae"), ("Cremflenaceæ", "Cremflenaceae"), ("Brustarn...", "Brustarniferae"), ("Zumgeneba", "Zumgenebineae"),
    ("Drorcrunosae", "Lommibaceae"), ("Batarin", NONE), ("see Part I", NONE), ("--", NONE), ("", NONE), ("lanplelnaceae", NONE), ("x" * 5000, NONE),
])
def test_families(v, c):
    assert FAM.resolve(v) == c


@pytest.mark.parametrize("v,c", [
    ("a", "A"), ("'A)", "A"), ("C.", NONE), ("F", NONE), ("COR", "Cor"), ("C0r", "Cor"), ("Co*", "Cor"), ("Cnor", "Cor"), (" Cr. - Or", "Cr.-Or"), ("CrOr", "Cr.-Or"), ("Kalta.", "Kal"), ("Kataran", "Kal"), ("Marandi", "Mar"), ("Marin", "M"), ("creole orzuelo", "Cr.-Or"),
    ("Or.", "Or"), ("Ubandi", NONE), ("Teq", NONE), ("idem", NONE), ("?", NONE), ("", NONE), ("Lumarao", NONE),
])
def test_dialects(v, c):
    assert DIA.resolve(v) == c


def test_trie_against_brute_force():
    import random

    def d(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng = random.Random(3)
    words = ["".join(rng.choice("pqxz") for _ in range(rng.randint(3, 8))) for _ in range(120)]
    t = Trie()
    for w in words:
        t.add(w, w)
    for q in words[:30] + ["".join(rng.choice("pqxz") for _ in range(6)) for _ in range(30)]:
        for most in (1, 2):
            # doubled letters cost 0.9, so a sum of three may pass a limit of 2 only beyond 2.69
            assert set(t.within(q, most)) == {w for w in words if d(q, w) <= most}
    assert limit(2) == 0


def test_tables(spark, part1, part2):
    fam = spark.createDataFrame([(1, "Stomlornaceae", None), (2, "Lommibaceae", "Drorcrunosae")], "family_id int, family string, also_known_as string")
    dia = spark.createDataFrame([("A", "Adoran"), ("Cor", "Corvayan")], "dialect_code string, dialect_name string")
    p1 = part1({"seq": 1, "dialects": ["A", "Corva.", None, "F"]}, {"seq": 1, "dialects": ["A", "Corva.", None, "F"]}, {"seq": 2, "dialects": []}, {"seq": 3, "dialects": None})
    p2 = part2({"seq": 9, "family": "stomlornacex"}, {"seq": 8, "family": None}, {"seq": 7, "family": "Stomlornaceae"}, {"seq": 6, "family": ""})
    got = {(r.src_table, r.seq, r.pos, r.canonical) for r in canonical_values(p1, p2, fam, dia).collect()}
    assert got == {("part1_vernacular", 1, 1, "Cor"), ("part1_vernacular", 1, 3, NONE), ("part2_scientific", 9, 0, "Stomlornaceae"), ("part2_scientific", 6, 0, NONE)}
    assert canonical_values(part1(), part2(), fam.limit(0), dia.limit(0)).count() == 0


def test_all_candidates():
    got = DIA.candidates("Marandi")
    assert set(got) == {"Mar", "M"} and got["Mar"] < got["M"]
    assert FAM.candidates("stomlornaceae") == {"Stomlornaceae": 0.0} and FAM.candidates("--") == {}


def test_farther_candidates():
    got = FAM.candidates("Crlmflemacee")
    assert set(got) == {"Crlmflemaceae", "Cremflenaceae"} and got["Crlmflemaceae"] < got["Cremflenaceae"] <= 3
    got = DIA.candidates("Cor.")
    assert set(got) == {"Cor", "Or", "Cr.-Or"} and got["Cor"] == 0.0
    assert DIA.resolve("Cor.") == "Cor" and DIA.candidates("?") == {}
