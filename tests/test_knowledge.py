import os
import pathlib
import random
from datetime import datetime, timedelta

from ontoloom.conf import EngineConf
from ontoloom.functions.text import normalize_id
from ontoloom.operators import abox, cycles, leader, limiter, report, tbox, turtle, validation
from ontoloom.operators.corrections import BackendError, apply_corrections, correction_rounds
from ontoloom.operators.leader import deduplicate, leaders, similar_pairs
from ontoloom.plans import prompts
from ontoloom.plans.backends import ReplayBackend, RuleBackend, batches_of, cache_key, with_retry
from ontoloom.plans.pipeline import populate
from ontoloom.queries.knowledge import QUERIES
from ontoloom.sources import readers
from pyspark.sql import functions as F
import pytest

CLS = "uri string, bfo_parent string, subclass_of string, aristotelian_definition string, comment string, first_batch int, seq long"
PRP = "uri string, domain string, range string, comment string, first_batch int, seq long"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def norm(s):
    s = s.lower().strip()
    for c in "_- ":
        s = s.replace(c, "")
    return s[:-1] if s.endswith("s") else s


def grams(s):
    return {s[i : i + 2] for i in range(len(s) - 1)}


def alike(a, b):
    if a == b:
        return True
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    x, y = grams(a), grams(b)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.85


def test_leaders_against_sequence(spark):
    rnd = random.Random(6)
    stems = ["wind_turbine", "amino_acid", "a", "off-shore platform", "glass", "leucine", "isoleucine", "", "x y", "enzyme_complexes"]
    ids = [rnd.choice(stems) + rnd.choice(["", "s", "_1", "_12", rnd.choice("abcxyz"), " of the sea"]) for _ in range(150)]
    led, want = [], {}
    for i in ids:
        n = norm(i)
        want[i] = next((x for x in led if norm(x) == n), None) or next((x for x in led if alike(norm(x), n)), None) or i
        if want[i] == i and i not in led:
            led.append(i)
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)] + [(None, 999)], "id string, seq long")
    got = {r["id"]: r["leader_id"] for r in deduplicate(df.select("id", normalize_id(F.col("id")).alias("norm"), "seq")).collect()}
    assert got == {i: want[i] for i in got} and set(got) == set(ids)
    assert leaders(spark.createDataFrame([], "i long, norm string")).count() == 0


def test_pairs_without_substrings(spark):
    df = spark.createDataFrame([(1, "leucine"), (2, "isoleucine"), (3, "abcdefghijklmnop"), (4, "abcdefghijklmnopq")], "i long, norm string")
    assert rows(similar_pairs(df)) == [(1, 2), (3, 4)] and rows(similar_pairs(df, substring_rule=False)) == [(3, 4)]


def test_leaders_leave_little_on_disk(spark):
    """Distinct names of two common words and a rare one: neither tables nor shuffle files of runs and candidates stay."""
    rnd = random.Random(3)
    stems = ["lower_%s_membrane", "upper_%s_turbine", "hydrated_%s_residue"]
    names = list({rnd.choice(stems) % "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(4000)})
    df = spark.createDataFrame(list(enumerate(names)), "seq long, id string").select("id", normalize_id(F.col("id")).alias("norm"), "seq")
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return sum(f.stat().st_size for f in scratch.rglob("*.parquet")) + sum(os.path.getsize(f) for f in files.getAllFiles().mkString("\n").split() if os.path.exists(f))

    before = held()
    out = deduplicate(df)
    assert held() - before < 100 * len(names) and out.count() == len(names)


def test_pairs_in_rounds_against_brute_force(spark, monkeypatch):
    """All pairs, of odd names too, where digests are dealt to several rounds and bit tables."""
    monkeypatch.setattr(leader, "ROUND_NAMES", 60)
    monkeypatch.setattr(leader, "TABLE_NAMES", 60)
    rnd = random.Random(5)
    pool = ["a", "ab", "aab", "é" * 30, "x" * 90, "ab" * 20, "wind turbine hall", "\U0001f600\U0001f600a", "n\x00\x00", "".join(rnd.choice("abcdefgh") for _ in range(100))]
    while len(pool) < 200:
        w = rnd.choice(pool)
        p = rnd.randrange(len(w) + 1)
        pool += {x for x in (w[:p] + rnd.choice("abxy") + w[p:], w[:p] + w[p + 1 :], w[p:] + w[:p]) if x} - set(pool)
    df = spark.createDataFrame(list(enumerate(pool)), "i long, norm string")
    for threshold, inside in ((0.85, True), (0.6, False)):
        g = [grams(x) for x in pool]
        want = [(i, j) for j, b in enumerate(pool) for i, a in enumerate(pool[:j]) if (inside and (a in b or b in a)) or (g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) >= threshold)]
        assert sorted(map(tuple, similar_pairs(df, threshold, inside).collect())) == sorted(want)


def test_graph_from_one_pass(spark):
    """Both kinds of mentions come from one pass over the text, as they come from two; an end is led where its chunk has it."""
    docs = spark.createDataFrame([(2, "Outer tavos sensor and outer tavo sensor meet nano bilo oxide. Nano bilo oxide beats outer tavo sensors."), (1, "The outer tavo sensor beats Outer Tavo sensor."), (3, None)], "doc_id long, text string")
    backend = RuleBackend({"sensor": "ex:Sensor", "oxide": "ex:Oxide"})
    chunks = readers.prepare(docs)
    for got, want in zip(backend.both(chunks), (backend.entities(chunks), backend.relations(chunks)), strict=True):
        assert rows(got) == rows(want) and got.columns == want.columns
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "uri string")
    kg = populate(docs, one("ex:Sensor", "ex:Oxide"), one("ex:comparedWith"), backend)
    assert rows(kg["typed"]) == rows(kg["entities"], "id", "class_uri") == [("nano_bilo_oxide", "ex:Oxide"), ("outer_tavo_sensor", "ex:Sensor")]
    assert rows(kg["relations"].select("source_id", "target_id").distinct()) == [("outer_tavo_sensor", "nano_bilo_oxide"), ("outer_tavo_sensor", "outer_tavo_sensor")]


def test_tbox(spark):
    cls = spark.createDataFrame([(1, 0, 0, "ex:A", "bfo:Role", None, "d", "c", "q"), (2, 0, 1, "ex:B", None, "ex:A", None, None, "q"), (3, 1, 0, "ex:A", "bfo:Site", "ex:B", "x", "y", "q"), (4, 2, 0, "ex:C", None, None, None, None, None), (5, 0, 2, None, None, None, None, None, None)], "class_row_id long, batch_ix int, pos int, uri string, bfo_parent string, subclass_of string, aristotelian_definition string, comment string, seq string")
    classes = tbox.approved_classes(cls)
    assert rows(classes, "uri", "bfo_parent", "seq") == [("ex:A", "bfo:Role", 1), ("ex:B", None, 2), ("ex:C", None, 4)]
    prp = [(1, 0, 0, "ex:p", "ex:C", "ex:A"), (2, 0, 1, "ex:p", "ex:A", "xsd:string"), (3, 1, 0, "ex:p", "ex:A", "ex:B"), (4, 3, 0, "ex:q", "ex:C", "xsd:int"), (5, 3, 0, "ex:r", None, "ex:A"), (6, 3, 0, "ex:s", "owl:Thing", "ex:C")]
    props = tbox.approved_properties(spark.createDataFrame([(*p, None) for p in prp], "prop_row_id long, batch_ix int, pos int, uri string, domain string, range string, comment string"), classes)
    assert rows(props, "uri", "range", "seq") == [("ex:p", "xsd:string", 2), ("ex:s", "ex:C", 6)]
    cats = spark.createDataFrame([("bfo:Entity", None, False), ("bfo:Continuant", "bfo:Entity", False), ("bfo:MaterialEntity", "bfo:Continuant", True)], "cat string, parent string, is_leaf boolean")
    typed = spark.createDataFrame([("bfo:Continuant",), ("bfo:material entity",), ("BFO:Material_Entity",), ("MaterialEntity",), ("bfo:Foo",), (None,)], "b string")
    assert [r["repaired"] for r in tbox.repair_categories(typed, "b", cats).collect()].count("bfo:Entity") == 3
    assert ("bfo:MaterialEntity", "bfo:Entity > bfo:Continuant > bfo:MaterialEntity", 2) in rows(tbox.lineage(cats))
    assert tbox.approved_classes(cls.limit(0)).count() == 0


def test_verdicts(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")], "child string, parent string")
    verdicts = spark.createDataFrame([("a", "b", True, False), ("c", "d", True, True), ("e", "f", False, False), ("g", "h", False, True)], "child_uri string, parent_uri string, forward_valid boolean, reverse_valid boolean")
    assert rows(cycles.two_way_filter(edges, verdicts)) == [("a", "b"), ("i", "j")]


def tables(spark):
    classes = spark.createDataFrame([("ex:A", "bfo:Role", None, "An A is a Role that x", "n", 0, 1), ("ex:b-c d", None, "ex:A", 'say "x"\\', None, 0, 2), ("ex:", None, "ex:Gone", None, "", 0, 3), ("ex:D", "bfo:Site", "ex:A", "A D is a Role that y", "e\nf", 0, 4)], CLS)
    props = spark.createDataFrame([("ex:P", "ex:A", "xsd:int", "c", 0, 1), ("ex:q", "ex:D", "ex:A", None, 0, 2), ("ex:r", "ex:X", "ex:Y", "c", 0, 3), ("ex:s", None, None, None, 0, 4), *((f"ex:t{i}", "ex:A", "ex:D", "", 0, 10 + i) for i in range(5))], PRP)
    return classes, props


def test_validation(spark):
    classes, props = tables(spark)
    found = validation.validate(classes, props)
    got = rows(found, "code", "subject")
    assert {("class_case", "ex:b-c d"), ("class_name", "ex:b-c d"), ("empty_name", "ex:"), ("property_case", "ex:P"), ("domain", "ex:r"), ("range", "ex:r"), ("domain", "ex:s"), ("range", "ex:s"), ("dangling", "ex:"), ("inversion", "ex:q"), ("conflict", "ex:A -> ex:D"), ("iri", "ex:b-c d")} <= set(got)
    assert ("range", "ex:P") not in got and not validation.is_consistent(found)
    assert "ex:t0, ex:t1, ex:t2, ex:t3" in rows(found.where("code = 'conflict'"), "message")[0][0]
    assert rows(validation.genus(classes), "subject") == [("ex:D",)]
    assert [r["prompt"] for r in prompts.properties_prompt(props.limit(0)).collect()] == ["(none)"] and prompts.classes_prompt(classes).count() == 1
    assert validation.is_consistent(validation.validate(classes.limit(0), props.limit(0)))
    prompt = prompts.errors_prompt(found).collect()[0]["prompt"]
    assert prompt.startswith("ERROR 1: ") and "WARNING 1: " in prompt
    assert prompts.errors_prompt(found.limit(0)).collect()[0]["prompt"] == "No errors detected."


def test_corrections(spark):
    classes, props = tables(spark)
    fix = [(1, "update_domain", "ex:q", "ex:A"), (2, "update_range", "ex:q", "xsd:string"), (3, "remove_class", "ex:D", None), (4, "update_domain", "ex:r", None), (5, "remove_property", "ex:P", None), (6, "remove_subclass", "ex:Zed", "ex:b-c d"), (7, "sing", "ex:A", "x"), (8, "update_range", "ex:t1", "ex:D")]
    c, p = apply_corrections(classes, props, spark.createDataFrame(fix, "seq long, action string, target_uri string, new_value string"))
    assert rows(c, "uri", "subclass_of") == [("ex:", "ex:Gone"), ("ex:A", None), ("ex:b-c d", None)]
    assert rows(p, "uri", "domain", "range") == [("ex:q", "ex:A", "xsd:string"), ("ex:r", "ex:X", "ex:Y"), ("ex:s", None, None)]
    late = [(1, "remove_class", "ex:A", None), (2, "update_domain", "ex:t1", "owl:Thing")]
    assert ("ex:t1",) not in rows(apply_corrections(classes, props, spark.createDataFrame(late, "seq long, action string, target_uri string, new_value string"))[1], "uri")

    def fixes(errors):
        return errors.where("code in ('domain', 'range')").selectExpr("1L as seq", "'remove_property' as action", "subject as target_uri", "cast(null as string) as new_value")

    good = classes.where("uri = 'ex:A' or uri = 'ex:D'")
    assert correction_rounds(good, props.where("uri in ('ex:q', 'ex:r')"), fixes)[2] == 2
    assert correction_rounds(good, props.where("uri = 'ex:q'"), fixes)[2] == 1

    def failing(error):
        def correct(_):
            raise error
        return correct

    assert correction_rounds(good, props, failing(BackendError("no answer")))[2] == 1
    with pytest.raises(ZeroDivisionError):  # faults of the program are not hidden
        correction_rounds(good, props, failing(ZeroDivisionError()))


def test_abox(spark):
    ents = spark.createDataFrame([(1, 1, 0, "A_b", "ex:A"), (2, 1, 0, "ab", "ex:Z"), (3, 1, 1, "c", None), (4, 2, 0, None, "ex:A")], "entity_key long, doc_id long, chunk_ix int, id string, class_uri string")
    rels = spark.createDataFrame([(1, 1, 0, "ab", "ex:q", "c", "e"), (2, 1, 0, "ab", "ex:q", "c", "e"), (3, 1, 1, "ab", "ex:n", None, None), (4, 1, 1, "ab", None, None, None)], "rel_id long, doc_id long, chunk_ix int, source_id string, property_uri string, target_id string, evidence_span string")
    classes, props = tables(spark)
    assert rows(abox.known_entities(ents, classes), "entity_key") == [(1,), (4,)] and rows(abox.unknown_entities(ents, classes), "entity_key") == [(2,), (3,)]
    assert rows(abox.skipped(ents, rels, classes, props)) == [(2, 2, 4)]
    assert rows(abox.remap_relations(rels, ents, abox.exact_leaders(ents)), "rel_id", "source_id", "target_id")[:3] == [(1, "A_b", "c"), (2, "A_b", "c"), (3, "ab", None)]
    assert rows(abox.distinct_relations(rels, "rel_id"), "rel_id") == [(1,), (3,), (4,)] and abox.triples(rels).count() == 3


def test_turtle_round_trip(spark, tmp_path):
    classes, props = tables(spark)
    ents = spark.createDataFrame([(1, "ex:d-pen", "ex:A"), (2, "x\"y", None), (3, None, "ex:A")], "k long, id string, class_uri string")
    rels = spark.createDataFrame([(1, "ex:d-pen", "ex:q", "x\"y"), (2, "a", "ex:P", "4 m"), (3, None, "ex:q", "b")], "k long, source_id string, property_uri string, target_id string")
    out = turtle.export(turtle.class_lines(classes), turtle.property_lines(props), turtle.instance_lines(ents, "k"), turtle.relation_lines(rels, "k", props.where("startswith(range, 'xsd:')")))
    turtle.write_turtle(out, str(tmp_path / "t"))
    text = spark.read.text(str(tmp_path / "t")).count()
    assert text == out.count()
    lines = out.selectExpr("'f' as file", "section * 1000000 + seq * 10 + part as no", "line as value")
    got = rows(turtle.read_turtle(lines))
    assert ("ex:b-c", "d", "rdf:type owl:Class") in got or ("ex:A", "rdf:type", "owl:Class") in got
    assert ("ex:d_pen", "ex:q", "ex:x_y") in got and ("ex:a", "ex:P", '"4 m"') in got and ("ex:q", "rdfs:range", "ex:A") in got and ("ex:D", "rdfs:comment", '"e f"') in got


def test_stability(spark):
    c = spark.createDataFrame([("run_9", "a"), ("run_10", "a"), ("run_10", "b"), ("run_9", "a"), ("x", "z")], "run string, uri string")
    r = spark.createDataFrame([("run_9", "s", "p", None, "e"), ("run_9", "s", "p", None, "f"), ("run_10", "s", "p", None, "g")], "run string, source_id string, property_uri string, target_id string, evidence_span string")
    got = {(x["prev_run"], x["run"]): x for x in report.stability(c, c.limit(0), r).collect()}
    assert set(got) == {("x", "run_9"), ("run_9", "run_10")}
    x = got["run_9", "run_10"]
    assert (x["classes_similarity"], x["properties_similarity"], x["triples_similarity"], x["verdict"]) == (0.5, 1.0, 1.0, "DIVERGENT")
    assert report.stability(c.where("run = 'x'"), c.limit(0), r.limit(0)).count() == 0


def test_limiter(spark):
    conf = EngineConf(requests_per_minute=2, min_gap_s=3.0)
    assert limiter.admit([0, 1, 2, 200], [], conf) == [0, 3, 61, 200] and limiter.admit([60], [0.0, 0.0], conf) == [61]
    t0 = datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, "u", t0 + timedelta(seconds=30 * i)) for i in range(4)] + [(9, "v", t0), (10, "v", None)], "event_id long, user_id string, ts timestamp_ntz")
    assert [r["n_window"] for r in limiter.sliding_count(ev, "user_id", "ts").where("user_id = 'u'").orderBy("event_id").collect()] == [1, 2, 3, 3]
    assert rows(limiter.daily_count(ev, "ts"), "n_requests") == [(5,)] and limiter.daily_count(ev.limit(0), "ts").count() == 0
    got = limiter.schedule(ev, "user_id", "ts", "event_id", conf).where("key = 'u'").orderBy("seq").selectExpr("admitted - min(admitted) over () as a").collect()
    assert [r["a"] for r in got] == [0, 30, 61, 91]


def test_backends(spark, tmp_path):
    assert cache_key("p", text="é") == cache_key("p", text="é") != cache_key("q", text="é")
    waits = []
    with pytest.raises(RuntimeError):
        with_retry(lambda: (_ for _ in ()).throw(RuntimeError("429")), 3, waits.append)
    assert waits == [60, 60]
    cache = spark.createDataFrame([("class", "k", '```json\n{"classes": [{"uri": "ex:A"}'), ("x", "k", "{}")], "prefix string, key string, payload string")
    req = spark.createDataFrame([("class", "k", 1), ("class", "n", 2)], "prefix string, key string, batch int")
    got = ReplayBackend(cache).answers(req, "classes").collect()
    assert len(got) == 1 and '"ex:A"' in got[0]["answer"]
    hit, miss = readers.cached(req, cache)
    assert hit.count() == 1 and miss.count() == 1
    chunks = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "doc_id long, chunk_ix int, text string")
    assert rows(batches_of(chunks)) == [(1, 0, "a\n\nb\n\nc"), (1, 1, "d")]
    docs = spark.createDataFrame([(1, "The outer tavo sensor beats Outer Tavo sensor. Nano bilo oxide and outer tavo sensor meet."), (2, None), (3, "")], "doc_id long, text string")
    classes = spark.createDataFrame([("ex:Sensor",)], "uri string")
    kg = populate(docs, classes, spark.createDataFrame([("ex:comparedWith",)], "uri string"), RuleBackend({"sensor": "ex:Sensor", "oxide": "ex:Oxide"}))
    assert rows(kg["entities"], "id") == [("outer_tavo_sensor",)] and rows(kg["relations"], "source_id", "target_id") == [("nano_bilo_oxide", "outer_tavo_sensor")]
    assert kg["skipped"].collect()[0]["skipped"] == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    assert rows(readers.read_text_documents(spark, str(tmp_path / "in")), "text") == [("one\ntwo",)]
    assert readers.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "in")).endswith("in")
    readers.archive({"classes": classes}, str(tmp_path / "runs"), "run_1")
    assert readers.next_run(spark, str(tmp_path / "runs"), "classes") == "run_2" and spark.read.parquet(str(tmp_path / "runs/classes")).collect()[0]["run"] == "run_1"


def test_saved_state(spark, tmp_path):
    (tmp_path / "run_3").mkdir()
    (tmp_path / "run_3" / "state.json").write_text('{"approved_classes": {"ex:A": {"comment": "c", "bfo_parent": "bfo:Role"}, "ex:B": "bare"}, "entities": {"x": {"class_uri": "ex:A"}}, "relations": [{"source_id": "x", "property_uri": "p", "target_id": "y"}], "subclass_relations": {"ex:B": "ex:A"}}')
    state = readers.read_state(spark, str(tmp_path / "run_3"))
    assert rows(state["classes"], "run", "uri", "comment", "bfo_parent") == [("run_3", "ex:A", "c", "bfo:Role"), ("run_3", "ex:B", "bare", None)]
    assert rows(state["entities"], "id", "class_uri") == [("x", "ex:A")] and rows(state["relations"], "target_id") == [("y",)] and state["canonical_terms"].count() == 0
    assert rows(state["subclass_edges"], "child", "parent") == [("ex:B", "ex:A")]


def test_flagship_merges_similar_names(spark, tmp_path):
    docs = [(1, "The outer tavo sensor meets a nano bilo oxide."), (2, "Here uter tavo sensor meets a nano bilo oxide.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["class_uri"]: (r["n_entities"], r["n_relations"]) for r in QUERIES["knowledge_graph"](spark, str(tmp_path)).collect()}
    assert got["ex:Sensor"] == (1, 2)


def test_pairs_against_brute_force(spark):
    """Names long and short, close, inside one another or neither."""
    rnd = random.Random(12)
    names = {"".join(rnd.choice(["tavo", "bilo", "nano", "outer", "s", "x", "sensor"]) for _ in range(rnd.randrange(1, 7))) for _ in range(250)}
    names |= {n[1:] for n in sorted(names)[::3] if len(n) > 1} | {n[:-2] + "q" + n[-2:] for n in sorted(names)[::4]}
    order = sorted(names)
    got = {(r["i"], r["j"]) for r in similar_pairs(spark.createDataFrame(list(enumerate(order)), "i long, norm string")).collect()}
    assert got == {(i, j) for j in range(len(order)) for i in range(j) if alike(order[i], order[j])}


def test_replay_fills_a_graph(spark):
    """The pipeline takes recorded answers, keyed by the request of each chunk; chunks without one give nothing."""
    docs = spark.createDataFrame([(1, "About sensors."), (2, "Nothing recorded.")], "doc_id long, text string")
    payload = '{"entities": [{"id": "a_b", "class_uri": "ex:S", "evidence_span": "x"}, {"id": "c", "class_uri": "ex:N"}], "relations": [{"source_id": "a_b", "property_uri": "ex:p", "target_id": "c", "evidence_span": "x"}]}'
    backend = ReplayBackend(spark.createDataFrame([("extract", cache_key("Read: About sensors."), payload)], "prefix string, key string, payload string"), lambda text: f"Read: {text}")
    kg = populate(docs, spark.createDataFrame([("ex:S",)], "uri string"), spark.createDataFrame([("ex:p",)], "uri string"), backend)
    assert rows(kg["entities"], "id", "class_uri") == [("a_b", "ex:S")] and rows(kg["relations"], "source_id", "property_uri", "target_id") == [("a_b", "ex:p", "c")]


def test_seeds_and_edges(spark):
    classes, _ = tables(spark)
    seeded = tbox.with_seeds(classes, spark.createDataFrame([("ex:A", "not new"), ("ex:New", None), ("ex:New", None), (None, "x")], "uri string, comment string"))
    assert seeded.count() == classes.count() + 1
    assert rows(seeded.where("uri = 'ex:New'"), "bfo_parent", "aristotelian_definition", "comment") == [("bfo:Entity", "A New is an Entity.", "")]
    some = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", None)], "uri string, subclass_of string")
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "z"), (None, "a"), ("d", None)], "child string, parent string")
    assert rows(tbox.remove_subclass(some, edges), "uri", "subclass_of") == [("b", None), ("c", "a"), ("d", None)]


def test_daily_quota():
    conf = EngineConf(requests_per_minute=100, requests_per_day=2)
    today = [-1, 0]
    got = limiter.admit([10.0, 20.0, 30.0], last := [], conf, today) + limiter.admit([40.0, 86_400.0, 86_500.0, 86_600.0], last, conf, today)
    assert [x is None for x in got] == [False, False, True, True, False, False, True] and today == [1, 2] and len(last) == 4
