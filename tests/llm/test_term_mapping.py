import random

from hypothesis import given
from hypothesis import strategies as st

from ontoloom.llm import term_mapping
from ontoloom.llm.term_mapping import allowed, apply_mapping, deletions, distance, map_values, tokens

REF = [("ex:WakeValveGuideline", "Wake Valve Guideline", "WVG"), ("ex:BallastAssessmentNotation", "Ballast Assessment Notation", "BAN"), ("ex:MaterialEntity", "MaterialEntity", None), ("ex:Role", "Role", None), ("ex:Empty", None, None)]


def test_distance():
    assert distance("abc", "acb", 3) == 1 and distance("kitten", "sitting", 3) == 3 and distance("a", "abcdef", 2) == 3
    assert tokens("Found. Netwo. (Valve's 2)") == ["found.", "netwo.", "valve"] and tokens("the SO-CALLED thingLike") == ["the", "so", "called", "thing", "like"]


@given(st.text(alphabet="abc", min_size=1, max_size=14), st.text(alphabet="abc", min_size=1, max_size=14))
def test_deletions_miss_nothing(a, b):
    for d in (0, 1, 2, 3):
        if distance(a, b, d) <= d:
            assert deletions(a, d) & deletions(b, d)


def test_blocks(spark, monkeypatch):
    """The answer does not depend on how many entries are ranked at a time."""
    rnd = random.Random(6)
    words = "catalytic plume logging module harvest inventory element offshore gradient hypothesis viscosity network".split()
    ref = spark.createDataFrame([(f"ex:{i}", " ".join(rnd.sample(words, rnd.randrange(1, 4))), None) for i in range(60)], "uri string, label string, short_form string")
    typed = [(" ".join(w[: rnd.randrange(1, 9)] + rnd.choice(["", "", "x"]) + w[8:] for w in rnd.sample(words, rnd.randrange(1, 4))),) for _ in range(60)]
    values = spark.createDataFrame(typed, "value string")
    rows = lambda: sorted(tuple(r) for r in map_values(values, ref).collect())
    whole = rows()
    monkeypatch.setattr(term_mapping, "BLOCK", 25)
    assert rows() == whole and any(r[1] != "UNMATCHED" for r in whole) and allowed(20) == 3


def test_mapping(spark):
    want = {
        "waie valv eguideline": 0, "Guideline, Wake Valve": 0, "wake_valve_guideline": 0, "W.V.G.": 0, " wvg": 0, "WVGs": 0, "Wake Valve Guidelinees": 0, "Wake Valve Guideline / WVG": 0, "WAKEVALVE GUIDLINE": 0,
        "our Ballast Assess. Notat.": 1, "B.A.N.": 1, "Ballást Assessment Notation [draft]": 1, "bfo:MateriaElntity": 2, "a material entity (BFO)": 2, "MaterialEntities": 2, "Rloe": 3,
        "Wake Valve Notation": None, "Ballast Guideline": None, "???": None, "": None, "n/a": None, "zaculaji pamatole": None, "Wake": None, "x" * 5000: None,
    }
    ref = spark.createDataFrame(REF, "uri string, label string, short_form string")
    # words that say nothing are learned from the values
    want |= {f"{w} {x}": i for w in ("our", "a", "the (see Fig. 2)", "draft", "bfo:") for i, x in ((0, "wake valve guideline"), (1, "ballast assessment notation"), (2, "material entity"), (3, "role"))}
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(want)] * 2 + [(None, -1)], "value string, uri int")
    got = {r["value"]: r["uri"] for r in map_values(rows, ref).collect()}
    assert got == {v: "UNMATCHED" if i is None else REF[i][0] for v, i in want.items()}
    assert apply_mapping(rows, map_values(rows, ref)).count() == 2 * len(want)
    assert map_values(rows.limit(0), ref).count() == 0 and map_values(rows, ref.limit(0)).where("uri <> 'UNMATCHED'").count() == 0


def test_typos(spark):
    rnd = random.Random(5)
    words = "catalytic plume logging module harvest inventory element offshore gradient hypothesis viscosity network bureau isotopic yield".split()
    labels = sorted({" ".join(rnd.sample(words, 3)) for _ in range(60)})
    labels = [x for x in labels if not any(sorted(x.split()) == sorted(y.split()) for y in labels if y < x)]
    ref = spark.createDataFrame([("ex:" + x, x, None) for x in labels], "uri string, label string, short_form string")
    typed = {}
    for x in labels:
        i = rnd.randrange(1, len(x) - 1)
        typed[x[:i] + rnd.choice("qzk") + x[i:]] = "ex:" + x
    got = {r["value"]: r["uri"] for r in map_values(spark.createDataFrame([(v,) for v in typed], "value string"), ref).collect()}
    assert sum(got[v] == u for v, u in typed.items()) >= 0.97 * len(typed)
