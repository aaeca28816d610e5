import random

import numpy as np
import pytest

from ontoloom.llm import mixing

DOCS = "doc_id long, source string, text string, tokens int"


def test_cube():
    rnd = np.random.default_rng(1)
    size, p = rnd.integers(1, 500, 400), rnd.uniform(0, 1, 400)
    out = mixing.flight(p, size, 3)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    landed = mixing.land(out, size)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= 500
    means = np.mean([mixing.land(mixing.flight(p[:12], size[:12], s), size[:12]) for s in range(3000)], 0)
    assert np.abs(means - p[:12]).max() < 0.08
    assert mixing.flight(np.array([0.5] * 5), np.array([7] * 5), 1).sum() == pytest.approx(2.5)
    assert len(mixing.flight(np.zeros(0), np.zeros(0), 1)) == 0


def test_tokens():
    tiktoken = pytest.importorskip("tiktoken")
    assert tiktoken
    texts = ["The model's  yield —\n\n désaéré 42.5 % !!", "", None, "  a b  ", "x" * 500, "日本語 テキスト"]
    enc = mixing._encoding(mixing.TOKENIZER)
    assert mixing.count_tokens(texts, mixing.TOKENIZER, {}) == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def test_shares(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("aaaaabbc") if i % 50 else None, " ".join(["word"] * rnd.randrange(1, 60)), 1) for i in range(3000)] + [(5000, "a", None, 0), (5001, "a", "", 0), (5002, "z", "no target", 0)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 4), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mix(spark.createDataFrame(rows, DOCS), targets)
    out = {r["source"]: r for r in mixing.report(mixed, plan).collect()}
    assert set(out) == {"a", "b", "c"}
    for s, share in (("a", 0.3), ("b", 0.3), ("c", 0.4)):
        assert out[s]["actual_share"] == pytest.approx(share, abs=0.002) and out[s]["most_copies"] <= out[s]["max_repeats"]
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    empty, plan = mixing.mix(spark.createDataFrame([], DOCS), targets)
    assert empty.count() == 0 and mixing.report(empty, plan).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rows = [(i, "ab"[i % 2], "word " * (1 + i % 17), 0) for i in range(1200)]
    mixed, plan = mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], "source string, target_share double, max_repeats int"))
    for r in mixing.report(mixed, plan).collect():
        assert r["actual_share"] == pytest.approx(r["target_share"], abs=0.002)
