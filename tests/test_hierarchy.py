import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ontoloom.operators.cycles import break_cycles, closing_edges, find_cycles
from ontoloom.operators.hierarchy import descendants, parent_links, resolve

LINKS = "node string, parent string"


def walk(parents):
    out = {}
    for n in parents:
        seen, at = [n], n
        while parents.get(at) is not None:
            at = parents[at]
            if at in seen:
                out[n] = (min(seen[seen.index(at) :]), -1, None)
                break
            seen.append(at)
        else:
            out[n] = (at, len(seen) - 1, seen[::-1])
    return out


def solve(spark, parents, with_paths=False, **options):
    rows = resolve(spark.createDataFrame(list(parents.items()), LINKS), with_paths, **options).collect()
    assert len(rows) == len(parents)
    return {r["node"]: (r["root"], r["depth"], *([r["path"]] if with_paths else [])) for r in rows}


def no_paths(parents):
    return {n: x[:2] for n, x in walk(parents).items()}


def test_shapes(spark):
    parents = {f"c{i:03}": f"c{i + 1:03}" for i in range(150)}  # a long chain whose last parent has no row
    parents |= {f"h{i}": "hub" for i in range(200)} | {"hub": None, "self": "self", "": "hub", "é ü": ""}
    parents |= {f"r{i}": f"r{(i + 1) % 37}" for i in range(37)} | {"into": "r5", "above": "into"} | {"a": "b", "b": "a"}
    assert solve(spark, parents) == no_paths(parents)
    assert solve(spark, parents, with_paths=True) == walk(parents)


def test_random(spark):
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(200)]
    parents = {n: rnd.choice([*names, "gone", None]) for n in names}
    assert solve(spark, parents) == no_paths(parents)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.one_of(st.none(), st.sampled_from("abcdefghij")), max_size=8))
def test_small(spark, parents):
    assert solve(spark, parents) == no_paths(parents)


def test_empty_and_nulls(spark):
    assert resolve(spark.createDataFrame([], LINKS)).count() == 0
    rows = spark.createDataFrame([(1, "x", "y", 0), (2, None, "y", 0), (3, "x", "z", 0), (4, "y", None, 0)], "k long, uri string, up string, node int")
    got = {r["node"]: r["parent"] for r in parent_links(rows, "uri", "up", "k").collect()}
    assert got == {"x": "y", "y": None}


def test_descendants(spark):
    solved = resolve(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], LINKS), with_paths=True)
    got = {tuple(r) for r in descendants(solved).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_cycles(spark):
    links = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("S", "S"), ("T", None)], LINKS)
    found = find_cycles(links)
    assert {(r["cycle_uri"], tuple(r["path"])) for r in found.collect()} == {("A", ("A", "B", "C", "A")), ("S", ("S", "S"))}
    assert {tuple(r) for r in closing_edges(found).collect()} == {("C", "A"), ("S", "S")}
    assert {tuple(r) for r in break_cycles(links).collect()} == {("A", "B"), ("B", "C"), ("C", None), ("D", "A"), ("S", None), ("T", None)}


@pytest.mark.parametrize("n", [1, 2])
def test_lookup_hot_key(spark, n):
    from ontoloom.runtime import lookup

    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [("cold", -1), ("none", -2), (None, -3)], "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w long")
    got = lookup(left, right, "k", "inner" if n == 1 else "left").groupBy("k", "w").count().collect()
    want = {("hot", 1, 3000), ("cold", 2, 1)} | (set() if n == 1 else {("none", None, 1), (None, None, 1)})
    assert {tuple(r) for r in got} == want
