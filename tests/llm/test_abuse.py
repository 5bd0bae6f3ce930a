import random

from vernalex.llm import abuse

ORDINARY = ["The {} is used for making rope by the natives.", "A tall shrub with {} flowers and rigid leaves.", "It grows in the margins of streams and is {}.", "The naked ovary of the {} is hairy at the tip.", "Send more of the {} from the coast, dried flat."]
ABUSIVE = ["You stupid worthless pig, nobody wants your {} here.", "I will come and break your ugly neck, you {} coward.", "Those people are filthy vermin and should be {} into the sea."]
FILL = ["young bark", "seed", "common", "yellow", "driven", "rotten", "old root", "broad leaf", "rare", "twig"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = [rng.choice(ORDINARY).format(rng.choice(FILL)) for _ in range(6)]
        y = int(i % 5 == 0)
        if y:
            s.insert(rng.randint(0, 6), rng.choice(ABUSIVE).format(rng.choice(FILL)))
        out.append((i, " ".join(s), y))
    return out


def test_held_out_accuracy_with_wrong_labels():
    rng = random.Random(9)
    labelled = [(d, t, 1 - y if rng.random() < 0.04 else y) for d, t, y in corpus(400, 1)]
    m = abuse.fit(labelled)
    dist = abuse.Distance(m.abusive, m.ordinary)
    test = corpus(300, 2)
    said = {d: max(map(dist.gain, abuse.windows(t))) >= m.threshold for d, t, _ in test}
    hit = sum(said[d] for d, _, y in test if y)
    assert hit >= 58 and sum(said.values()) - hit <= 3


def test_label_resamples_agree():
    rng = random.Random(5)
    labelled = [(d, t, 1 - y if rng.random() < 0.05 else y) for d, t, y in corpus(400, 4)]
    test = corpus(300, 6)
    for seed in range(4):
        m = abuse.fit(random.Random(seed).sample(labelled, 300))
        dist = abuse.Distance(m.abusive, m.ordinary)
        said = {d: max(map(dist.gain, abuse.windows(t))) >= m.threshold for d, t, _ in test}
        hit = sum(said[d] for d, _, y in test if y)
        assert hit >= 54 and sum(said.values()) - hit <= 3


def test_wrong_labels_train_nothing():
    m = abuse.fit([(d, t, 1 - y if d in (5, 6, 7) else y) for d, t, y in corpus(400, 1)])
    assert b"worthless pig" in m.abusive and b"making rope" not in m.abusive and b"worthless pig" not in m.ordinary


def test_disguises():
    assert abuse.normal("st*pid, s t u p i d, s.t.u.p.i.d, stuuuupid 5tup1d").split() == ["stpid", "stupid", "stupid", "stupid", "stupid"]
    assert abuse.normal("") == "" and abuse.windows(None) == [] and abuse.windows("12 !! --") == []


def test_words_of_any_language_stay():
    assert abuse.windows("Du bist ein Schweinehund und dein Bruder ist ein Drecksack.") == ["du bist ein schweinehund und dein bruder ist ein drecksack"]
    assert abuse.windows("Ты Дурак! Ёлка.") == ["ты дурак", "елка"] and abuse.windows("You are a Bastard and a Wanker") == ["you are a bastard and a wanker"]
    assert abuse.windows("Ask Mr. Pettigar.\n\nHe left. It was well-\nknown.") == ["ask mr pettigar", "he left", "it was wellknown"]


def test_every_word_lies_in_a_window():
    words = [f"w{chr(97 + k // 20)}r{chr(97 + k % 20)}" for k in range(200)]
    assert {w for win in abuse.windows(" ".join(words)) for w in win.split()} == set(words)
    assert "".join(abuse.windows("xy" * 400)[0].split()) == "xy" * 144 and all(len(w) < 400 for w in abuse.windows("xy" * 40_000))


def test_bounds_of_training(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (2, "b" * 500), (3, None), (4, "c" * 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, "r", d % 2) for d in (1, 2, 3, 4)], "doc_id long, reviewer string, abusive int")
    assert [d for d, _, _ in abuse.training_rows(docs, labels, chars=100)] == [1, 3, 4]
    assert len(abuse.training_rows(docs, labels, bound=2)) == 2


def test_no_labels_flag_nothing(spark):
    docs = spark.createDataFrame([(1, "You pig.", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, abuse_score string")
    labels = spark.createDataFrame([], "doc_id long, reviewer string, abusive int")
    s = abuse.scored_documents(docs, labels, ("abuse_score",))
    assert s.where("abusive").count() == 0 and s.count() == 3
    assert abuse.scored_documents(docs.limit(0), labels).count() == 0


def test_score_table(spark):
    rows = corpus(200, 3)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(900, None), (901, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, "a", y) for d, _, y in rows[:150]] + [(0, "b", 1), (1, "b", None), (2, "b", 1)], "doc_id long, reviewer string, abusive int")
    got = {r.doc_id: r for r in abuse.scored_documents(docs, labels).collect()}
    assert got[900].abuse_score is None and not got[900].abusive and not got[901].abusive
    assert all(got[d].abusive == bool(y) for d, _, y in rows if d != 2)
