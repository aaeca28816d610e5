import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ontoloom.llm.splitting import split_documents, split_spans


def check(text, size, overlap):
    spans = split_spans(text, size, overlap)
    assert (spans == []) == (text == "")
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= size for a, b in spans)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b < d and b - c <= overlap
    return spans


@given(st.text(alphabet="ab .\n,;\r", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_invariants(text, size, overlap):
    check(text, size, overlap % size)


def test_overlap():
    """Any overlap below the size is honoured, and is exact where a text has no boundaries; one that is not below it is an error."""
    for size, overlap in ((10, 8), (10, 9), (100, 60), (7, 0)):
        spans = check("x" * 500, size, overlap)
        assert all(b - c == overlap for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    for size, overlap in ((10, 10), (5, 9), (0, 1)):
        with pytest.raises(ValueError):
            split_spans("x" * 50, size, overlap)


def test_boundaries_and_balance():
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    spans = check(text, 500, 60)
    assert all(text[b - 1] == " " and text[b - 2] == "." for _, b in spans[:-1])
    assert max(b - a for a, b in spans) - min(b - a for a, b in spans) < 200
    solid = "x" * 1000
    assert len(check(solid, 100, 10)) == 11 and all(b - c == 10 for (_, b), (c, _) in zip(split_spans(solid, 100, 10), split_spans(solid, 100, 10)[1:]))
    assert check("é" * 100, 100, 10) == [(0, 100)]


def test_documents(spark):
    rnd = random.Random(3)
    texts = ["", None, "short", "w" * 801, " ".join("word" * rnd.randrange(1, 4) for _ in range(900)), "a b. " * 20000]
    docs = spark.createDataFrame([(i, t, s, 7) for i, t in enumerate(texts) for s in ["card", None, "*"][i % 3 : i % 3 + 1]], "doc_id long, text string, source string, size int")
    settings = spark.createDataFrame([("*", 1000, 50), ("card", 800, 80)], "source string, chunk_size int, chunk_overlap int")
    rows = split_documents(docs, settings).orderBy("doc_id", "piece_ix").collect()
    assert {r["doc_id"] for r in rows} == {3, 4, 5}
    for r in rows:
        assert r["piece"] == texts[r["doc_id"]][r["begin"] : r["end"]] and len(r["piece"]) <= (800 if r["doc_id"] == 3 else 1000)
    assert split_documents(docs.limit(0), settings).count() == 0
    assert split_documents(docs, settings.where("source = 'card'")).select("doc_id").distinct().count() == 1
