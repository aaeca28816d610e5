import unicodedata

from ontoloom.llm.format_duplicates import collapse, copies, leaf, merkle, nested_records, parse_record, text_records


def found(df):
    return {tuple(r)[1:] for r in copies(df).collect()}


def test_leaf_and_merkle():
    assert leaf("  Lower·Vokohofa–Sensor ") == leaf("<LOWER_VOKOHOFA_SENSOR>") == "lowervokohofasensor"
    assert leaf("désaéré") == leaf(unicodedata.normalize("NFD", "DÉSAÉRÉ")) != leaf("desaere")
    assert leaf("Straße") == leaf("STRASSE") and leaf("Σίγμας") == leaf("ΣΊΓΜΑΣ") and leaf("β") != leaf("b")
    assert leaf(1.5) != leaf(15) and leaf(-3) != leaf(3) and leaf(1.0) == leaf(1) == leaf("1") and leaf(True) != leaf(1) and leaf(1e300) != leaf(float("inf"))
    assert len({leaf(x) for x in ("क", "का", "कि", "की")}) == 4 and len({leaf(x) for x in ("ที่", "ที", "ท")}) == 3 and leaf("क-का") == leaf("कका")
    assert leaf(unicodedata.normalize("NFD", "한국")) == leaf("한국") and leaf("a\ufe0f") == "a"
    assert parse_record('{"x": 1.50}') == parse_record('{"x": 1.5}') and merkle(parse_record('{"x": 1.50}')) != merkle(parse_record('{"x": 150}'))
    a, b = {"id": "A-b", "Sub": {"x": [1, "Y"], "n": None}}, {"SUB": {"N": None, "X": ["1", "y "]}, "Id": "a B"}
    assert merkle(a) == merkle(b)
    assert merkle({"x": None}) != merkle({"x": ""}) and merkle({"x": None}) != merkle({}) and merkle(["a", "b"]) != merkle(["b", "a"])
    assert parse_record("{'a' : 'x \"y\"' }") == {"a": 'x "y"'} and parse_record("{broken") == "{broken"


def test_text_records(spark):
    ids = ["Ab c", "aB_C", None, "", "--", "áb", "áB", "x" * 20000, "X" * 20000, "Ab-c", "ß", "SS"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ids, 1)] + [(None, "ab c", "")], "k long, id string, key string")
    assert found(text_records(df, "t", "k", "id")) == {(1, 2), (1, 10), (4, 5), (6, 7), (8, 9), (11, 12)}


def test_scripts(spark):
    ids = ["का", "क", "कि", "क ा", unicodedata.normalize("NFD", "한국"), "한국", "한 국"]
    df = spark.createDataFrame(list(enumerate(ids)), "k long, id string")
    assert found(text_records(df, "t", "k", "id")) == {(0, 3), (4, 5), (4, 6)}


def test_nested_records(spark):
    rows = [
        (1, "entity", '{"id": "a_b", "class_uri": "ex:C"}'), (2, "Entity", "{'CLASS_URI' : 'ex:c' , 'Id' : '\"A b\"' }"), (3, "class", '{"id": "a_b", "class_uri": "ex:C"}'),
        (4, None, '{"id": 1}'), (5, None, '{"id": "1"}'), (6, "entity", None), (7, "entity", '{"id": "a_b"'), (8, "entity", "id: a_b"), (9, "entity", '{"id": "a_b", "class_uri": "ex:C", "x": null}'),
    ]
    got = found(nested_records(spark.createDataFrame(rows, "k long, kind string, payload string"), "r", "k", "kind", "payload"))
    assert got == {(1, 2), (4, 5), (7, 8)}


def test_hot_record_and_empty(spark):
    df = spark.range(5000).selectExpr("id as k", "case when id % 3 = 0 then concat('HOT', repeat('_', cast(id % 7 as int))) else concat('x', cast(id as string)) end as t")
    records = text_records(df, "t", "k", "t")
    assert found(records) == {(0, i) for i in range(3, 5000, 3)}
    assert collapse(records).where("copies > 1").select("copies").collect()[0][0] == 1667
    assert found(records.limit(0)) == set()
