import random

from vernalex.llm.groups import connected_groups


def groups(spark, rows):
    df = spark.createDataFrame(rows, "a long, b long, id long, label long, p long")
    return {r.record_id: r.group_id for r in connected_groups(df, "a", "b").collect()}


def brute(rows):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in rows:
        if a is None or b is None:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def r(a, b):
    return (a, b, 1, 2, 3)


def test_against_union_find(spark):
    rng = random.Random(5)
    rows = [r(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(220)]
    assert groups(spark, rows) == brute(rows)


def test_chain_star_repeats_nulls(spark):
    chain = [r(k + 1, k) for k in range(1000, 1100)]
    star = [r(5000, k) for k in range(5001, 5300)] * 2
    odd = [r(7, 7), r(8, None), r(None, None), r(1, 2), r(2, 1)]
    rows = chain + star + odd
    assert groups(spark, rows) == brute(rows)


def test_empty(spark):
    assert groups(spark, []) == {}
