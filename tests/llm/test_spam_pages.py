import random

import numpy as np
import pyarrow as pa

from ontoloom.llm import spam_pages as pages
from ontoloom.llm.spam_pages import score_pages, spam_pages

PROSE = ["The yield of {0} reached 4 % in most trials.", "We observed that {0} is stable near the inlet, because {1} absorbs heat.", "Compared with {0}, {1} binds salts more slowly over a year.", "Tables 4, 5, 6 and 7 list {0}, {1}, Outer Oxide, 17, 18, Clear Basin, 5, 6, 7, Nano Lume, 8, 9 and Vona, 12.", "It is not yet clear why {0} becomes dense under low pressure."]


def test_band():
    bits = np.random.default_rng(1).lognormal(0.5, 0.2, 50_000)
    low, high = pages.band(bits)
    assert 0 < low < bits.min() and high > bits.max() and pages.band(bits[:0]) == (-np.inf, np.inf)
    # symmetric on the log scale, so both sides are tested alike
    assert abs(np.log(high / np.median(bits)) - np.log(np.median(bits) / low)) < 0.2


def test_perplexity_decides(spark, monkeypatch):
    """Without the perplexity test nothing is flagged; with an inverted one everything that has words is."""
    docs = spark.createDataFrame([(i, " ".join(PROSE).format("outer oxide", "tidal cell")) for i in range(30)] + [(30, "outer oxide, tidal cell, nano rotor, " * 20)], "doc_id long, text string")
    assert [r["doc_id"] for r in spam_pages(docs).collect()] == [30]
    monkeypatch.setattr(pages, "band", lambda bits: (-np.inf, np.inf))
    assert spam_pages(docs).count() == 0
    monkeypatch.setattr(pages, "band", lambda bits: (np.inf, np.inf))
    assert spam_pages(docs).count() == 31


def test_pages(spark):
    rnd = random.Random(3)
    names = [f"{a} {b}" for a in ("outer", "frozen", "nano", "tidal") for b in ("sensor", "oxide", "rotor", "ligand", "basin")]
    pad = lambda: " ".join(rnd.choices(["slow", "Dense", "clear", "Vona", "salt", "heat"], k=rnd.randrange(4)))
    name = lambda: f"{pad()} {rnd.choice(names)} {pad()}" + rnd.choice(["", "", ",", ":", " (see Fig. 3)", "; 4, 5", ", Lume,", ". J. Vona,"])
    prose = lambda n: " ".join(rnd.choice(PROSE).format(name(), name()) for _ in range(n))
    keywords = lambda n: ", ".join(rnd.choice(names) for _ in range(n)) + ", "
    links = lambda n: "\n".join(f"* [{x}](https://a.invalid/{x[:4]})" for x in rnd.choices(names, k=n))
    tags = lambda n: " ".join("#" + x.replace(" ", "_") for x in rnd.choices(names, k=n))
    urls = lambda n: "\n".join(f"http://a.example/{x.replace(' ', '-')}/{rnd.randrange(9999)}" for x in rnd.choices(names, k=n))
    offers = lambda n: "\n".join(f"buy {x} Vowali" for x in rnd.choices(names, k=n))
    refs = lambda n: "\n".join(f"[{i}] Vona, A. and Lume, B. Survey of {rnd.choice(names)}. J. Appl. Chem. {i}(2), {i * 7}-{i * 9}." for i in range(n))
    index = lambda n: "\n".join(f"{rnd.choice(names).title()}, {i}, {i + 9}, {i + 70}" for i in range(n))
    notes = lambda n: "\n".join(f"* [{rnd.choice(names)}](https://a.example/{i}) {prose(1)}" for i in range(n))
    table = lambda n: "\n".join(f"{1990 + i};{i * 3.7:.1f};0.{i}" for i in range(n))
    seq = lambda n: ">r1\n" + "\n".join("".join(rnd.choices("ACDEFGHIKLMNPQRSTVWY", k=60)) for _ in range(n))
    spam = [f(n) for f in (keywords, links, tags, urls, offers) for n in (15, 60, 300)] + [prose(1) + "\n" + keywords(60) + links(40)]
    fine = [prose(n) for n in range(2, 40)] + [f(40) for f in (refs, index, notes, table, seq)] + [prose(12) + "\n" + keywords(10), None, "", " ", "word"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(spam + fine)], "doc_id long, text string, share double")
    assert {r["doc_id"] for r in spam_pages(docs).collect()} == set(range(len(spam)))
    assert score_pages(docs).count() == len(spam + fine) and spam_pages(docs.limit(0)).count() == 0


def test_ranks(spark, monkeypatch):
    """Quantiles of a table are those of all its numbers, also where they are narrowed down in several rounds."""
    bits = np.concatenate([np.random.default_rng(2).lognormal(0.5, 0.4, 5000), np.full(700, 1.25)])
    places = spark.createDataFrame([(int(v),) for v in bits.view(np.int64)], "place long")
    for at_once in (100_000, 0):
        monkeypatch.setattr(pages, "AT_ONCE", at_once)
        assert np.allclose(pages.band(places), pages.band(bits), rtol=1e-12, atol=0)
        assert np.allclose(pages._quantiles(places, np.array([0, 0.3, 1]), len(bits)), np.quantile(bits, [0, 0.3, 1]), rtol=1e-12, atol=0)
    assert pages.band(places.limit(0)) == (-np.inf, np.inf) and pages.band(places.limit(1))[0] > 0


def test_band_of_all_documents(spark, monkeypatch):
    """The band is fitted on the prose windows of every document, however many there are."""
    rnd = random.Random(6)
    words = lambda: " ".join(rnd.choices(["outer oxide", "Tidal Cell", "on the inlet", "if so", "salts,", "to it", "17"], k=rnd.randrange(1, 5)))
    texts = [rnd.choice(PROSE).format(words(), words()) for _ in range(9000)]
    fitted, band = [], pages.band
    monkeypatch.setattr(pages, "band", lambda bits: fitted.append(band(bits)) or fitted[-1])
    pages.score_pages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    coded = next(pages._coded(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])))
    counts = next(pages._train(iter([coded])))
    codes, key, window, doc = pages._windows(coded)
    sums = np.bincount(window, pages.Model(counts["key"].to_numpy(), counts["n"].to_numpy()).bits(key, 1))
    bits = (sums / np.bincount(window))[pages._prose(codes, window, len(doc))]
    assert len(bits) > 8000 and np.allclose(fitted[0], band(bits), rtol=1e-9, atol=0)
