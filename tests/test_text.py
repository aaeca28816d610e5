import pytest
from pyspark.sql import functions as F

from ontoloom.conf import EngineConf
from ontoloom.functions import json_repair as J
from ontoloom.functions import text as X
from ontoloom.functions.splitter import chunk, split_text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_ids(spark):
    rows = [("protein_x", "proteinx"), ("enzyme", "enzyme_complex"), ("glass", "glas"), ("customer_1", "customer_12"), ("a", "amino_acid"), ("ex:leucine", "ex:isoleucine"), ("-", "x"), ("", ""), (None, "x")]
    a, b = X.normalize_id(F.col("a")), X.normalize_id(F.col("b"))
    got = values(spark, rows, "a string, b string", a, b, X.similar(a, b))
    assert [g[2] for g in got] == [True, True, True, True, True, False, False, True, None]
    assert got[2][:2] == ("glas", "gla") and got[0][0] == "proteinx"
    assert values(spark, [("A b—c \tS",)], "a string", a) == [("ab—c",)]


def test_similarity_flags(spark):
    rows = [("leucine", "isoleucine"), ("abcdefghij", "abcdefghik")]
    got = values(spark, rows, "a string, b string", X.similar(F.col("a"), F.col("b"), substring_rule=False), X.jaccard(X.bigrams(F.col("a")), X.bigrams(F.col("b"))))
    assert got[0][0] is False and got[1] == (False, pytest.approx(0.8))
    assert values(spark, [("a", "")], "a string, b string", X.jaccard(X.bigrams(F.col("a")), X.bigrams(F.col("b")))) == [(1.0,)]


def test_cleaning(spark):
    rows = [("a REFERENCES b Acknowledgments c",), ("a references b",), ("x © 21, 22  y\nVolume 4, Issue 2 ISSN: 1234-5678",), ("  é \r\nz ",), ("",), (None,)]
    got = values(spark, rows, "t string", X.section_cut(F.col("t")), X.clean(F.col("t")))
    assert got[0][0] == "a " and got[1][0] == "a references b" and got[2][1] == "x y" and got[3][1] == "é z" and got[4] == ("", "") and got[5] == (None, None)


def test_uris(spark):
    got = values(spark, [("ex:A",), ("Foo",), ("skos:x",), ("http://e/x",), (None,)], "u string", X.ensure_prefix(F.col("u")))
    assert [g[0] for g in got] == ["ex:A", "ex:Foo", "ex:skos:x", "ex:http://e/x", None]
    assert values(spark, [('a"b\\c\nd',)], "u string", X.escape_literal(F.col("u"))) == [('a\\"b\\\\c d',)]
    assert values(spark, [("ex:d-pen",), ("é",)], "u string", X.safe_id(F.col("u"))) == [("d_pen",), ("_",)]


def test_splitter(spark):
    assert split_text("aaa. bbb. ccc. ddd", 10, 4) == ["aaa. bbb", ". ccc. ddd"]
    assert split_text("", 10, 2) == [] and split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    text = ". ".join(f"sentence {i} of a longer text" for i in range(400))
    parts = split_text(text, 300, 60)
    assert all(len(p) <= 300 for p in parts) and all(p in text for p in parts)
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, text, 0), (3, "again", 0)], "doc_id long, text string, chunk_ix int")
    assert chunk(df, 300, 60).count() == len(parts) + 1 and chunk(df.limit(0)).count() == 0


def test_json():
    assert J.repair('{"a": [1, 2, {"b": "c') == '{"a": [1, 2, {"b": "c"}]}'
    assert J.repair('{"a": "x\\"y", "b"') == '{"a": "x\\"y"}' and J.repair("") == "" and J.repair("no") == ""
    assert J.extract('Sure:\n```json\n{"a": 1}\n```') == {"a": 1} and J.extract('x {"a": 1} y') == {"a": 1} and J.extract("nothing") is None
    assert J.extract('```\n{"classes": [{"uri": "ex:A"}, {"uri": "ex:') == {"classes": [{"uri": "ex:A"}, {"uri": "ex:"}]}
    long = '{"a": [' + ", ".join(f'{{"k": "{i}"}}' for i in range(3000)) + ', {"k": "cut'
    assert J.repair(long).endswith('"cut"}]}')


def test_normalize():
    assert J.normalize(["q?", {"question": "r?", "scope": "instance"}], "questions") == {"questions": [{"scope": "class", "question": "q?"}, {"scope": "instance", "question": "r?"}]}
    got = J.normalize({"thoughts": "t", "approved_classes": {"ex:A": "note"}}, "classes")
    assert got["reasoning_steps"] == ["t"] and got["classes"][0] | {"comment": "note", "bfo_parent": "bfo:Entity"} == got["classes"][0]
    assert J.normalize({"approved_properties": {"ex:p": {"domain": "ex:A"}, "ex:q": "text"}}, "properties")["properties"] == [{"domain": "ex:A", "range": "ex:Thing", "comment": "", "uri": "ex:p"}]
    assert J.normalize(None, "corrections") == {"reasoning_steps": ["Extracted via fallback."], "corrections": []} and J.normalize({"results": [1, {}]}, "validations") == {"validations": [{}]}


def test_conf(monkeypatch):
    monkeypatch.setenv("ONTOLOOM_CHUNK_SIZE", "99")
    assert EngineConf.from_env().chunk_size == 99
    monkeypatch.setenv("ONTOLOOM_CHUNK_SIZE", "x")
    with pytest.raises(ValueError):
        EngineConf.from_env()
