from vernalex.llm.leakage import Items, leaks, rolling, same_word, tokens

ITEM = "Read the entry and answer: the pencilled query leaves blank beside a white index card on leaf 30, because every later copy never separates from the name TADÁS by order of Ilongor"


def longest(text, item=ITEM):
    t = Items([(1, item)]).tiles(text)
    return t[1][0][2] if 1 in t else 0


def test_damage_aside():
    assert longest("x y z. " + ITEM.upper() + " and more") == len(tokens(ITEM))
    assert longest("Read the cntry and answer: the penciUed query lcaves blank beside a whitc index c@rd on leaf 30, bec-\nause every later copy") >= 20
    assert longest("the pencilledquery leaves bl ank beside a white index card on\n42\nleaf 30 because every later") >= 14


def test_short_passage_is_none():
    assert longest("he said the pencilled query leaves blank beside a white index and left") < 12
    assert longest("nothing in common here at all") == 0


def test_reordered_is_covered(spark):
    w = ITEM.split()
    docs = spark.createDataFrame([(1, " ".join(w[16:] + ["so"] + w[:16]), "x"), (2, None, "x"), (3, "", "x"), (4, ITEM, "x"), (4, ITEM, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "short")], "item_id long, text string")
    got = {(r.item_id, r.doc_id): r for r in leaks(docs, items).collect()}
    assert set(got) == {(7, 1), (7, 4)} and got[(7, 1)].coverage > 0.9 and got[(7, 1)].n_tiles >= 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, items).count() == 0
    assert leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), items).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    import vernalex.llm.leakage as m

    items = spark.createDataFrame([(k, f"{ITEM} number {k} of the whole long list of questions") for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    one = sorted(tuple(r) for r in leaks(docs, items).collect())
    monkeypatch.setattr(m, "BLOCK_CHARS", 300)
    assert sorted(tuple(r) for r in leaks(docs, items).collect()) == one


def test_very_long_text():
    t = ("word " * 50_000) + ITEM
    assert longest(t) == len(tokens(ITEM))


def test_words():
    assert same_word("tbree", "three") and same_word("le#f", "leaf") and not same_word("of", "or") and not same_word("red", "bud")
    assert [k for k, _ in rolling(["a", "b"], 3)] == [] and len(list(rolling(["a", "b", "c", "a", "b", "c"], 3))) == 4
    h = [x for _, x in rolling(["a", "b", "c", "a", "b", "c"], 3)]
    assert h[0] == h[3] and tokens(None) == []


def test_a_passage_of_many_items_is_found_in_all():
    shared = "the cream wrapper sets against that spiny twig after glossy rains and the lowest line leaves blank beside a brown index card with nine queries"
    items = Items([(k, f"question {k * 7} begins: {shared} number {k * 11} ends it") for k in range(9)])
    damaged = " ".join("xq#zzq" if k % 4 == 3 else w for k, w in enumerate(shared.split()))
    assert set(items.tiles(damaged)) == set(range(9)) == set(items.tiles("so " + shared))


def test_overlapping_pieces_cover_the_whole():
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}{k % 7}x" for k in range(30)]
    words = [w.translate(str.maketrans("0123456", "bcdfghj")) for w in words]
    t = Items([(1, " ".join(words))]).tiles(" ".join(words[:18]) + " zz qq zz " + " ".join(words[11:]))[1]
    assert sum(m for _, _, m in t) == 30 and t[0][2] == 19


def test_tiling_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(60):
        d = [rng.choice("abcdef") * 4 for _ in range(rng.randint(5, 40))]
        t = [rng.choice("abcdef") * 4 for _ in range(rng.randint(5, 25))]
        got = sorted(m for _, _, m in Items([(1, " ".join(t))]).tiles(" ".join(d)).get(1, []))
        marked_d, marked_t, want = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(d)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and i + n not in marked_d and j + n not in marked_t:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < 4:
                break
            want.append(n)
            marked_d |= set(range(i, i + n))
            marked_t |= set(range(j, j + n))
        assert (got or [0])[-1] == max(want, default=0) and sum(got) >= 0.8 * sum(want)
