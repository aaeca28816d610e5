import random

from ontoloom.llm import truncation
from ontoloom.llm.truncation import truncated, with_language, with_tails

SCHEMA = "row_key long, source string, field string, lang string, text string, n int"


def texts(rnd, n):
    verbs, things, tails = ["measures", "anchors", "delays", "connects"], ["the flow of ions", "a layered surface", "pulses near the seabed", "nutrients in cultured cells"], ["during storage", "after digestion", "in a closed vessel", ""]
    return [f"A {rnd.choice('BCDFG')}{rnd.randrange(99)}thing is a process that {rnd.choice(verbs)} {rnd.choice(things)} {rnd.choice(tails)}".strip() + rnd.choice([".", ".", ".", ""]) for _ in range(n)]


def test_held_out(spark):
    rnd = random.Random(1)
    rows, cut = [], set()
    for i, t in enumerate(texts(rnd, 3000)):
        if rnd.random() < 0.1:
            t = t[: rnd.randrange(25, len(t) - 6)] + rnd.choice(["", "", "…", "�", " [...]"])
            cut.add(i)
        rows.append((i, rnd.choice("ab"), "f", rnd.choice(["en", None]), t, 0))
    rows += [(9000, "a", "f", "en", None, 0), (9001, "a", "f", "en", "", 0), (9002, "a", "f", "en", "null", 0), (9003, None, "g", None, "lone", 0)]
    got = truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3001
    said = {r["row_key"] for r in got if r["is_cut"]}
    assert len(said & cut) >= 0.9 * len(cut) and len(said - cut) <= 0.01 * len(rows)


def test_field_limit(spark):
    rnd = random.Random(2)
    rows = [(i, "s", "f", "en", (t + " " + t)[:70] if i % 2 else t, 0) for i, t in enumerate(texts(rnd, 1200))]
    out = truncated(spark.createDataFrame(rows, SCHEMA))
    assert out.where("at_limit").count() > 400
    assert truncated(out.selectExpr("row_key", "source", "field", "'' as lang", "'' as text").limit(0)).count() == 0


def test_copies_vouch_for_nothing(spark):
    """A cut value repeated under many keys is as cut as a single one, a whole one as whole, and neither moves the others."""
    rnd = random.Random(3)
    rows = [(i, "a", "f", "en", t, 0) for i, t in enumerate(texts(rnd, 1500))]
    cut, whole = "A B7thing is a process that measures the fl", "A B8thing is a process that anchors a layered surface during storage"
    verdicts = lambda n: {r["row_key"]: r["is_cut"] for r in truncated(spark.createDataFrame([*rows, *((10_000 + i, "a", "f", "en", cut, 0) for i in range(n)), *((20_000 + i, "a", "f", "en", whole, 0) for i in range(n))], SCHEMA)).collect()}
    once, often = verdicts(1), verdicts(700)
    assert once[10_000] and not once[20_000]
    assert all(often[k] for k in range(10_000, 10_700)) and not any(often[k] for k in range(20_000, 20_700))
    assert all(often[k] == v for k, v in once.items())


def test_field_limit_of_a_small_table(spark):
    """A pile of few values is a limit where nothing lies around it; values that lie evenly have none."""
    rnd = random.Random(4)
    piled = [(i, "s", "f", "en", (t + " " + t)[:100], 0) for i, t in enumerate(texts(rnd, 6))]
    even = [(100 + i, "s", "g", "en", "".join(rnd.choice("abcd ") for _ in range(39 + i % 20)) + "e", 0) for i in range(60)]
    out = truncated(spark.createDataFrame(piled + even, SCHEMA)).where("at_limit").collect()
    assert {r["field"] for r in out} == {"f"} and len(out) >= 4


def test_languages_and_tails(spark):
    said = {"The flow of the ions is slow": "en", "Le débit des ions est lent pour la cellule": "fr", "Der Fluss der Ionen ist nicht schnell": "de", "El flujo de los iones es lento": "es", "Xylo 42": None, "": None}
    df = spark.createDataFrame([(t, None) for t in said] + [("The flow of the ions", "xx")], "text string, lang string")
    assert {r["text"]: r["lang"] for r in with_language(df).collect()} == said | {"The flow of the ions": "xx"}
    tails = {"A b  c.": ("a b c", "stop"), "A b…": ("a b", "marked"), '"A b"': ("a b", "plain"), '"A b."': ("a b", "stop"), 'A "b" c"': ('a "b" c', "marked"), "A b [...] ": ("a b", "marked"), "": ("", "plain")}
    got = with_tails(spark.createDataFrame([(t,) for t in tails], "text string")).collect()
    assert {r["text"]: (r["core"], r["kind"]) for r in got} == tails


def test_thresholds_of_each_field(spark):
    """Fields of different nature get thresholds of their own, and a field without whole values that of all together."""
    rnd = random.Random(5)
    rows = [(i, "a", "f", "en", t, 0) for i, t in enumerate(texts(rnd, 900))]
    rows += [(10_000 + i, "a", "g", "en", f"Code {rnd.choice('AB')} {rnd.randrange(30)} of part {rnd.randrange(9)}.", 0) for i in range(900)]
    rows += [(20_000 + i, "a", "h", "en", "no stop ever here", 0) for i in range(40)] + [(30_000, "a", "f", "en", "A B7thing is a process that connects nutr", 0)]
    got = {r["row_key"]: r["is_cut"] for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[30_000] and sum(got.values()) <= 20 and not any(got[20_000 + i] for i in range(40))


def test_cuts_of_all_texts(spark, monkeypatch):
    """Thresholds are learned from a cut of every different text that is long enough, however many there are."""
    rnd = random.Random(7)
    said = texts(rnd, 1500) + ["A short one.", "a short one"]
    monkeypatch.setattr(truncation, "SAMPLE", 300, raising=False)  # read by former versions: more texts were cut in part only
    seen, errors = [], truncation._errors
    monkeypatch.setattr(truncation, "_errors", lambda finals, cuts: seen.append(cuts.count()) or errors(finals, cuts))
    truncated(spark.createDataFrame([(i, "a", "f", "en", t, 0) for i, t in enumerate(said + said[:400])], SCHEMA))
    assert seen == [len({t.rstrip(".").lower() for t in said[:1500]})]
