import random
from datetime import datetime, timedelta

from ontoloom.operators.references import orphans, parents, references

T0 = datetime(2024, 1, 1)
PARENT = "id string, since timestamp_ntz, until timestamp_ntz, key string, t int"
REF = "row_id long, target string, at timestamp_ntz, end int"


def brute(ps, rs):
    return {r for r, k, t in rs if k is not None and (t is None or not any(p == k and s is not None and s <= t and (u is None or u > t) for p, s, u in ps))}


def found(spark, ps, rs, n=4):
    alive = parents(spark.createDataFrame([(*p, "clash", 1) for p in ps], PARENT), "s", "id", "since", "until")
    refs = references(spark.createDataFrame([(*r, 0) for r in rs], REF), "t", "row_id", "target", "s", "at")
    rows = orphans(refs, alive, n).collect()
    assert len({r["row_key"] for r in rows}) == len(rows)
    return {r["row_key"] for r in rows}


def test_random_with_hot_key(spark):
    rnd = random.Random(2)
    day = lambda: T0 + timedelta(days=rnd.randrange(60))
    names = ["hot"] * 8 + [f"k{i}" for i in range(12)] + ["", "é"]
    ps = [(rnd.choice(names), day(), rnd.choice([None, day(), day()])) for _ in range(40)] + [(None, day(), None), ("k1", None, None)]
    rs = [(i, rnd.choice([*names, "missing"]), day()) for i in range(600)] + [(900, None, T0), (901, "k1", None)]
    for n in (1, 7):
        assert found(spark, ps, rs, n) == brute(ps, rs)


def test_key_over_many_ranges(spark):
    ps = [("hot", T0, T0 + timedelta(days=50)), ("hot", T0 + timedelta(days=10), T0 + timedelta(days=12))]
    rs = [(i, "hot", T0 + timedelta(minutes=i * 30)) for i in range(3000)]
    assert found(spark, ps, rs, 9) == brute(ps, rs)


def test_empty(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], [(1, "a", T0)]) == {1}
    assert found(spark, [("a", T0, None)], []) == set()
