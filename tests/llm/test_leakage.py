import random

import numpy as np

from ontoloom.llm import leakage
from ontoloom.llm.leakage import Index, aligned, find_leaks, words

VOCAB = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ra", "se", "ti", "vo", "zu") for b in ("dor", "fen", "gal", "hum", "jit", "kol", "lan", "mer", "nox", "pel")]


def test_words():
    assert words("Le ni-\nveau d&eacute;j­à <sup>4</sup>vu [12] ÉTÉ") == ["le", "niveau", "deja", "4", "vu", "ete"]
    assert words("") == [] and aligned(np.array([1, 2, 3]), np.array([9, 1, 2, 3])) == [(0, 1), (1, 2), (2, 3)]


def test_found(spark):
    rnd = random.Random(7)
    text = lambda n: [rnd.choice(VOCAB) for _ in range(n)]
    items = {i: text(rnd.randrange(40, 90)) for i in range(60)}
    docs, want = {}, set()
    for d in range(300):
        body = text(rnd.randrange(0, 400)) if d % 3 else [f"w{rnd.randrange(999)}" for _ in range(300)]
        if d % 2:
            i = rnd.randrange(60)
            share = rnd.choice([0.2, 0.6, 1.0])
            n = int(share * len(items[i]))
            begin = rnd.randrange(len(items[i]) - n + 1)
            part = [w if rnd.random() > 0.1 else "other" for w in items[i][begin : begin + n]]
            at = rnd.randrange(len(body) + 1)
            body = [*body[:at], *(w.upper() if share == 1 else w for w in part), *body[at:]]
            if share > 0.5:
                want.add((d, i))
        docs[d] = ",\n".join(body)
    df = spark.createDataFrame([*docs.items(), (900, None), (901, ""), (902, "x" * 100000)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, spark.createDataFrame([(i, " ".join(w), "q") for i, w in items.items()] + [(77, None, "q"), (78, "", "q")], "item_id long, text string, doc_id string")).collect()}
    assert want <= got and len(got - want) <= 2
    assert find_leaks(df.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_recall_of_the_index():
    """Retrieval against brute force: every item that the alignment accepts is a candidate of the index."""
    rnd = random.Random(8)
    items = [[rnd.choice(VOCAB) for _ in range(50)] for _ in range(40)]
    index = Index(list(range(40)), items)
    brute = found = 0
    for _ in range(150):
        i = rnd.randrange(40)
        n = rnd.randrange(10, 50)
        part = [w for w in items[i][:n] if rnd.random() > 0.12]
        coded = np.array([index.terms.get(w, len(index.terms)) for w in [*["x"] * 30, *part, *["y"] * 30]], np.int64)
        if 3 * len(aligned(index.coded[i], coded)) >= 50:
            brute += 1
            found += i in index.candidates(coded)
    assert brute > 40 and found >= 0.97 * brute


def test_a_third():
    """A third of the words is a case and less is none; a single word of the item behind a gap makes no third."""
    rnd = random.Random(9)
    item = rnd.sample(VOCAB, 60)
    index = Index([1], [item])
    around = lambda part: ["foreign"] * 70 + part + ["other"] * 70
    for n in (20, 21, 22, 23):
        for begin in (0, 17, 60 - n):
            assert index.leaks(around(item[begin : begin + n])) == [(1, n, 60)]
    assert not index.leaks(around(item[10:29]))
    assert not index.leaks(around([*item[10:29], item[30]])) and not index.leaks(around([item[8], *item[10:29], item[30]]))
    altered = [w if i % 10 != 5 else "changed" for i, w in enumerate(item[:24])]
    assert index.leaks(around(altered)) == [(1, 24, 60)]  # changed words within running text are carried too


def test_long_items():
    """Items many passages long are found whole, by a third of their words and with one word in five altered."""
    rnd = random.Random(10)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    items = [text(n) for n in (50, 500, 800, 1200, 2000)]
    index = Index(list(range(5)), items)
    for i, item in enumerate(items):
        n = len(item)
        whole, third = item, item[n // 4 : n // 4 + -(-n // 3)]
        altered = [w if rnd.random() > 0.2 else "changed" for w in item]
        for part in (whole, third, altered):
            found = index.leaks([*text(100), *part, *text(100)])
            assert [x[0] for x in found] == [i]
        assert not index.leaks([*text(100), *item[: n // 4], *text(100)])


def test_several_runs():
    """Parts of an item in different places of a text add up, in any order; scattered words do not."""
    rnd = random.Random(11)
    item = rnd.sample(VOCAB, 60)
    index = Index([1], [item])
    for gap in (10, 150, 700):
        body = ["foreign"] * 70 + item[:12] + ["between"] * gap + item[40:52] + ["other"] * 70
        assert index.leaks(body) == [(1, 24, 60)]
        body = ["foreign"] * 70 + item[40:52] + ["between"] * gap + item[:12] + ["other"] * 70
        assert index.leaks(body) == [(1, 24, 60)]
        assert not index.leaks(item[:6] + ["between"] * gap + item[20:26] + ["between"] * gap + item[40:46] + ["other"] * gap + item[50:56])
    assert not index.leaks([w for x in item[:30] for w in (x, "a", "b")])


def test_items_of_one_word_and_blocks(spark, monkeypatch):
    rnd = random.Random(12)
    items = [(i, " ".join(rnd.sample(VOCAB, 30))) for i in range(50)] + [(50, "lonely"), (51, None), (52, " ")]
    texts = [(i, f"some words {items[i][1]} and more") for i in range(50)] + [(60, "a lonely word"), (61, None), (62, "")]
    docs, listed = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(50)} | {(60, 50)}
    rows = lambda: sorted(tuple(r) for r in find_leaks(docs, listed).collect())
    whole = rows()
    assert {r[:2] for r in whole} == want
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 7)  # eight blocks, two readings
    assert rows() == whole
