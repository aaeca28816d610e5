"""Keyword-stuffed and link-list pages: function-word and word-class sequences under a prose-trained n-gram model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint, drop, spread

# Function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """
    the a an of and or to in into is are was were be been it its that this these with as on by at from for not no
    once when while why because whereas which who after over under near without during only more most all above does do did
    between but if than should we they he she you our their has have had can will would may there then so also
    der die das und oder ist sind war von mit für den dem des ein eine einer einem nach im am auf zu bei als dass wird warum
    während ohne gegen sich nicht auch aus noch zwischen durch über unter er sie wir
    le la les de du et ou un une est sont dans que qui par pour sur sans pendant tandis près après plus au aux se ne il
    elle ce cette ces en à l d où encore pourquoi
    el los las y del al una con por se es más mientras sin para tras durante cerca lo su sus como aún qué entre sobre pero
    """.split()
)

#: Words since the last function word or figure are counted up to LONGEST; in prose such runs stay below PROSE_RUN.
LONGEST, PROSE_RUN = 14, 10
#: Tokens in a window, and the tokens that a link or tag, usually much longer than a word, counts as.
WINDOW, LINK_TOKENS = 16, 4
#: Windows of fewer tokens say nothing.
LEAST = 6
#: A page is flagged if more than this share of its characters stands in windows of abnormal perplexity.
SHARE = 0.5
#: The model is trained on windows with at least this share of function words, without links and long runs of words.
PROSE_WORDS = 0.15
#: The band of normal perplexity: on the scale of log bits a token, its edges lie BAND times as far from the median of
#: prose windows as the outermost TAIL of them does.
BAND, TAIL = 1.5, 0.001
#: Values at given ranks are found by DIGIT bits a round, until no more than AT_ONCE values can be meant.
DIGIT, AT_ONCE = 16, 100_000

_TOKEN = re.compile(r"https?://\S+|#\w+|<[^<>\n]{1,200}>|\]\([^)\s]*\)|[^\W\d_]+|\d+(?:[.,]\d+)*|\n|[^\w\s]|_")
_MARKS = ".,;:!?()[]|•»*-–/\"="

_NAMES = ["^", "\n", "9", "UPPER", "LONG", "OTHER", "URL", "TAG", "HTML", "LINK", *_MARKS, *sorted(FUNCTION_WORDS)]
_ID = {n: i for i, n in enumerate(_NAMES)}
_LOWER, _TITLE = len(_NAMES), len(_NAMES) + LONGEST + 1  # each followed by its run lengths
SIZE = _TITLE + LONGEST + 1
_START, _BREAK = _ID["^"], _ID["\n"]
_FIRST_FUNCTION = len(_NAMES) - len(FUNCTION_WORDS)
_RECORD_IDS = [_ID["9"], _ID["UPPER"], _ID["LONG"]]  # figures, capitals and letter strings: neither words nor links
_LINK_IDS = [_ID["URL"], _ID["TAG"], _ID["HTML"], _ID["LINK"]]


def _class(token: str) -> int:
    c = token[0]
    if c.isalpha():
        if token.startswith("http") and "://" in token:
            return _ID["URL"]
        known = _ID.get(token.lower(), -1)
        if known >= _FIRST_FUNCTION:
            return known
        if len(token) > 24:
            return _ID["LONG"]
        if len(token) > 1 and token.isupper():
            return _ID["UPPER"]
        return _TITLE if c.isupper() else _LOWER
    if c.isdigit():
        return _ID["9"]
    if len(token) > 1:
        return _ID[{"#": "TAG", "<": "HTML"}.get(c, "LINK")]
    return _ID.get(token, _ID["OTHER"])


def code(text: str, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Class and length of every word, mark and link of a text, and the length of all its tokens.

    Words carry the number of words since the last function word or figure. Figures, capitals and letter strings end such
    a run, but are no part of the sequence: they are neither function words nor word classes of a sentence.
    """
    tokens = _TOKEN.findall(text)
    ids = []
    for t in tokens:
        k = memo.get(t)
        if k is None:
            k = _class(t)
            if len(memo) < 100_000 and len(t) < 25:
                memo[t] = k
        ids.append(k)
    c = np.array(ids, np.uint16)
    n = np.fromiter(map(len, tokens), np.int32, len(tokens))
    keep = c != _BREAK
    c, n = c[keep], n[keep]
    if not len(c):
        return c, n, 0
    word, record = c >= _LOWER, np.isin(c, _RECORD_IDS)
    steps = np.cumsum(word + 2 * np.isin(c, _LINK_IDS))
    base = np.maximum.accumulate(np.where(_function(c) | record, steps, 0))
    run = np.minimum(steps - base, LONGEST)
    c[word] += run[word].astype(np.uint16)
    return c[~record], n[~record], int(n.sum()) + len(n)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    for b in batches:
        rows = [code(t or "", memo) for t in b["text"].to_pylist()]
        cols = [pa.array([c.tobytes() for c, _, _ in rows], pa.binary()), pa.array([n.tobytes() for _, n, _ in rows], pa.binary()), pa.array([t for _, _, t in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], ["doc_id", "codes", "sizes", "chars"])


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch in one array, the keys of their trigrams, the window of each token and the document of each window."""
    docs = [np.frombuffer(x, np.uint16).astype(np.int64) for x in b["codes"].to_pylist()]
    codes = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(begin, size)
    weight = np.cumsum(np.where(np.isin(codes, _LINK_IDS), LINK_TOKENS, 1))
    ends = np.cumsum(size)
    before = np.concatenate([[0], weight])[begin]
    per_doc = -(-(np.concatenate([[0], weight])[ends] - before) // WINDOW)
    window = np.repeat(np.cumsum(per_doc) - per_doc, size) + (weight - 1 - np.repeat(before, size)) // WINDOW
    one, two = np.roll(codes, 1), np.roll(codes, 2)
    one[place < 1] = _START
    two[place < 2] = _START
    return codes, (two * SIZE + one) * SIZE + codes, window, np.repeat(np.arange(len(docs)), per_doc)


def _function(codes: np.ndarray) -> np.ndarray:
    return (codes >= _FIRST_FUNCTION) & (codes < _LOWER)


def _sum(window: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(window, x, n)


def _prose(codes: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
    """Which windows read like prose."""
    size = _sum(window, np.ones(len(codes)), n)
    run = np.where(codes >= _TITLE, codes - _TITLE, np.where(codes >= _LOWER, codes - _LOWER, 0))
    other = _sum(window, np.isin(codes, _LINK_IDS) | (run >= PROSE_RUN), n)
    return (_sum(window, _function(codes), n) >= PROSE_WORDS * size) & (other == 0) & (size >= LEAST)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial trigram counts over windows of prose."""
    for b in batches:
        codes, key, window, doc = _windows(b)
        if len(codes):
            keys, counts = np.unique(key[_prose(codes, window, len(doc))[window]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])


class Model:
    """Interpolated trigram model over word classes."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, self.n = key[order], n[order].astype(float)
        self.context = np.zeros(SIZE * SIZE)
        np.add.at(self.context, self.key // SIZE, self.n)
        self.pair = np.zeros(SIZE * SIZE)
        np.add.at(self.pair, self.key % (SIZE * SIZE), self.n)
        self.last = self.pair.reshape(SIZE, SIZE).sum(1)
        self.one = (self.pair.reshape(SIZE, SIZE).sum(0) + 0.5) / (self.n.sum() + 0.5 * SIZE)

    def bits(self, key: np.ndarray, own: int = 0) -> np.ndarray:
        """Surprisal of each trigram. own: how often a trigram that was trained on is left out, to judge it as a new one."""
        pair, first = key % (SIZE * SIZE), key // SIZE
        p = (np.maximum(self.pair[pair] - own, 0) + 4 * self.one[key % SIZE]) / (np.maximum(self.last[pair // SIZE] - own, 0) + 4)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            seen = np.where(self.key[at] == key, self.n[at], 0.0)
        else:
            seen = np.zeros(len(key))
        return -np.log2((np.maximum(seen - own, 0) + 4 * p) / (np.maximum(self.context[first] - own, 0) + 4))


def _perplexities(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Bits a token of every prose window, as if it had not been trained on, as integers of the same order."""
    model = Model(*shared.value)
    for b in batches:
        codes, key, window, doc = _windows(b)
        n = len(doc)
        mean = _sum(window, model.bits(key, 1), n) / np.maximum(_sum(window, np.ones(len(codes)), n), 1)
        bits = mean[_prose(codes, window, n)]
        # positive numbers are in the order of their bit patterns
        yield pa.RecordBatch.from_arrays([pa.array(bits[bits > 0].view(np.int64))], ["place"])


def _at_ranks(places: DataFrame, ranks: np.ndarray, n: int) -> np.ndarray:
    """The values of `place` (n rows, none negative) at these ranks from 0 on.

    Rows are counted by their leading bits, then within the parts that hold a rank; so no round sends the driver more than
    2 ** DIGIT counts a rank or AT_ONCE in all, however many rows there are.
    """
    found, rest = np.zeros(len(ranks), np.int64), np.array(ranks, np.int64)  # leading bits, and the rank among those that share them
    shift, held = 63, n
    while shift:
        known, shift = shift, 0 if held <= AT_ONCE else max(0, shift - DIGIT)
        part = places if known == 63 else places.where(F.shiftright("place", known).isin([int(p) for p in set(found)]))
        counts = part.groupBy(F.shiftright("place", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("p")
        p, upto = counts["p"].to_numpy(np.int64), np.concatenate([[0], np.cumsum(counts["n"].to_numpy(np.int64))])
        rest = rest + upto[np.searchsorted(p, found << (known - shift))]
        at = np.searchsorted(upto, rest, "right") - 1
        found, rest, held = p[at], rest - upto[at], int(np.diff(upto)[np.unique(at)].sum())
    return found


def _quantiles(places: DataFrame, shares: np.ndarray, n: int) -> np.ndarray:
    """Exact quantiles of the numbers that `place` (n rows) stands for, in between two of them as numpy has it."""
    rank = shares * (n - 1)
    below = np.floor(rank).astype(np.int64)
    a, b = _at_ranks(places, np.concatenate([below, np.minimum(below + 1, n - 1)]), n).view(np.float64).reshape(2, -1)
    return a + (b - a) * (rank - below)


def band(bits: np.ndarray | DataFrame) -> tuple[float, float]:
    """The normal range of bits a token, from those of all prose windows; without any, everything is normal.

    bits: an array, or a table with what `_perplexities` gives.
    """
    shares = np.array([TAIL, 0.5, 1 - TAIL])
    if isinstance(bits, np.ndarray):
        bits = bits[bits > 0]
        marks = np.quantile(bits, shares) if len(bits) else None
    else:
        n = bits.count()
        marks = _quantiles(bits, shares, n) if n else None
    if marks is None:
        return -np.inf, np.inf
    low, mid, high = np.log(marks)
    return float(np.exp(mid - BAND * (mid - low))), float(np.exp(mid + BAND * (high - mid)))


def _score(batches: Iterator[pa.RecordBatch], shared, low: float, high: float) -> Iterator[pa.RecordBatch]:
    model = Model(*shared.value)
    for b in batches:
        codes, key, window, doc = _windows(b)
        sizes = np.concatenate([np.frombuffer(x, np.int32) for x in b["sizes"].to_pylist()]) if b.num_rows else np.zeros(0)
        n, docs = len(doc), b.num_rows
        bits = model.bits(key)
        tokens = np.maximum(_sum(window, np.ones(len(codes)), n), 1)
        mean = _sum(window, bits, n) / tokens
        weight = _sum(window, np.where(np.isin(codes, _LINK_IDS), LINK_TOKENS, 1), n)
        odd = (weight >= LEAST) & ((mean > high) | (mean < low))
        share = np.bincount(doc, _sum(window, sizes + 1.0, n) * odd, docs) / np.maximum(b["chars"].to_numpy(), 1)
        entropy = np.bincount(doc, _sum(window, bits, n), docs) / np.maximum(np.bincount(doc, tokens, docs), 1)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(entropy), pa.array(share)], ["doc_id", "entropy", "share"])


def score_pages(docs: DataFrame) -> DataFrame:
    """Score every document: doc_id, entropy (bits a token), share (of its characters in windows of abnormal perplexity).

    docs: doc_id, text, whole. Each text becomes a sequence of function words and word classes, a word's class carrying
    the number of words since the last function word or figure. A trigram model is trained on the windows of all documents
    that read like prose; the band of normal perplexity is fitted on the same windows, those of all documents. A window is
    odd if its perplexity lies above or below that band, and nothing else decides. Null and empty texts score 0, as does
    everything where no text reads like prose. The model has one count per trigram of classes that occurs in prose, so its
    size is bounded by the alphabet, not by the documents.
    """
    coded = checkpoint(spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(_coded, "doc_id bigint, codes binary, sizes binary, chars bigint"))
    counts = coded.mapInArrow(_train, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)))
    places = checkpoint(coded.select("codes").mapInArrow(lambda it: _perplexities(it, shared), "place bigint"))
    low, high = band(places)
    drop(places)
    return coded.mapInArrow(lambda it: _score(it, shared, low, high), "doc_id bigint, entropy double, share double")


def spam_pages(docs: DataFrame) -> DataFrame:
    """Documents most of whose text is repeated keywords, links or tags."""
    return score_pages(docs).where(F.col("share") > SHARE)
