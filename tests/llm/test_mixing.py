import pytest

from vernalex.llm import mixing

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(mixing.TOKENIZER), reason="the public tokenizer is not here")
DOCS = "doc_id long, text string, lang string, source string, genus string, tokens string, w string"
GOALS = "source string, target_share double, max_repeats int"


def doc(i, source, n=20, lang="en", genus="G"):
    return (i, "tree " * n, lang, source, genus, "x", "y")


def run(spark, docs, goals, **kw):
    uses, shares, _ = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(goals, GOALS), **kw)
    return {r.doc_id: r.n_repeats for r in uses.collect()}, {r.source: r for r in shares.collect()}


def test_shares_and_caps(spark):
    docs = [doc(i, "big", lang="en" if i % 3 else None, genus=f"G{i % 4}") for i in range(300)] + [doc(1000 + i, "Small ", genus=None) for i in range(10)] + [doc(2000, "other"), doc(2001, None), (2002, None, None, "big", None, None, None), (2003, "", "en", "big", "G", "x", "y")]
    uses, shares = run(spark, docs, [("big", 0.5, 2), ("small", 0.4, 8), ("absent", 0.1, 3)])
    assert abs(shares["big"].actual_share - 5 / 9) < 0.02 and abs(shares["small"].actual_share - 4 / 9) < 0.02
    assert shares["absent"].tokens == 0 and shares["small"].most_repeats <= 8 and shares["big"].most_repeats <= 2
    assert not {2000, 2001, 2002, 2003} & set(uses)


def test_total_and_shortage(spark):
    docs = [doc(i, "big") for i in range(200)] + [doc(1000 + i, "small") for i in range(5)]
    uses, shares = run(spark, docs, [("big", 0.5, 1), ("small", 0.5, 2)], total_tokens=4000)
    assert shares["small"].tokens <= 2 * shares["small"].available_tokens and abs(shares["big"].tokens - 2000) < 100


def test_empty(spark):
    uses, shares = run(spark, [], [("big", 1.0, None)])
    assert uses == {} and shares["big"].tokens == 0
    uses, shares = run(spark, [doc(1, "big")], [])
    assert uses == {} and shares == {}


def test_repeated_rows_and_nulls_in_targets(spark):
    uses, shares = run(spark, [doc(1, "a"), doc(1, "a"), doc(2, "a")], [("a", 1.0, None), (None, 0.5, 1)])
    assert set(uses) == {1, 2} and max(uses.values()) == 1


def test_marginals_are_raked(spark):
    # one source is mostly French, the other mostly English; the mix keeps the languages of the listed text where caps allow
    docs = [doc(i, "a", lang="fr" if i % 4 else "en") for i in range(400)] + [doc(1000 + i, "b", lang="en" if i % 4 else "fr") for i in range(400)]
    _, _, m = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], GOALS), total_tokens=8000)
    got = {r.value: r for r in m.where("marginal = 'lang'").collect()}
    assert all(abs(r.actual_share - r.wanted_share) < 0.05 for r in got.values())
