"""Evaluation texts leaking into training text: BM25 index of the test items with block-max WAND, then exact alignment."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint, spread

#: Words of a training passage and the step from one passage to the next.
PASSAGE, STEP = 64, 32
#: BM25.
K1, B = 1.2, 0.75
#: A passage is a candidate for an item from this share of the item's score against itself, or, for an item longer
#: than a passage, of the part of that score that a passage can hold.
RETRIEVE = 0.1
#: A document must carry one in so many of an item's words as running text.
CARRIED = 3
#: A part of an item counts if so many of its words stand in a row, at least DENSE of them unchanged, with as few words put
#: between; several such parts of one document add up.
RUN, DENSE = 8, 2 / 3
#: Items to a block of postings, items to one index, and indexes held against the documents in one reading; a longer list
#: takes more readings. Statistics are those of the whole list, so results do not depend on these numbers.
POSTING_BLOCK, INDEX_ITEMS, INDEXES = 16, 4_000, 5

_TAG = re.compile(r"</?[a-zA-Z]{1,8}(?:\s[^<>]{0,80})?/?>|\[\d{1,3}\]|\(\*\)")
_HYPHEN = re.compile(r"(?<=\w)[-‐­]\s*[\r\n]+\s*(?=\w)")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
_COMBINING = re.compile(r"[̀-ͯ]+")


def words(text: str) -> list[str]:
    """Words of a text however it is set: no case, accents, tags, note marks, line-end hyphens or hidden characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text or "(*" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text or "\r" in text:
        text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
    return _WORD.findall(text.casefold())


def _spread(first: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of all postings of `terms` in a posting array whose lists begin at `first`."""
    size = first[terms + 1] - first[terms]
    return np.repeat(first[terms] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


@dataclass
class Index:
    """Inverted BM25 index of one set of items over pairs of neighbouring words.

    Pairs instead of single words keep words of the field, which every document has, from reaching a threshold. Each
    pair has its postings (item, impact) and, for pruning, its greatest impact per block of items.
    """

    ids: list[int]
    items: list[list[str]]
    freqs: list[list[int]] | None = None  # items of the whole list that have each pair of each item; None: these are all
    total: tuple[int, float] | None = None  # items of the whole list and their pairs on average
    terms: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.terms = {w: i for i, w in enumerate(sorted({w for ws in self.items for w in ws}))}
        self.coded = [np.array([self.terms[w] for w in ws], np.int64) for ws in self.items]
        self.single = any(len(c) == 1 for c in self.coded)
        pairs = [self._pairs(c) for c in self.coded]
        n = len(self.items)
        everything, avg = self.total or (n, max(1.0, sum(map(len, pairs)) / max(1, len(pairs))))
        self.known = np.unique(np.concatenate(pairs)) if n else np.zeros(0, np.int64)
        place = [np.searchsorted(self.known, p) for p in pairs]
        df = np.bincount(np.concatenate([np.unique(p) for p in place]), minlength=len(self.known)) if n else np.zeros(0)
        if self.freqs is not None:
            for p, f in zip(place, self.freqs, strict=True):
                df[p] = f
        rows: list[tuple[int, int, float]] = []
        own = np.zeros(n)
        for i, p in enumerate(place):
            for t, tf in Counter(p.tolist()).items():
                x = math.log(1 + (everything - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p) / avg))
                rows.append((t, i, x))
                own[i] += x
        rows.sort()
        self.first = np.searchsorted(np.array([t for t, _, _ in rows]), np.arange(len(self.known) + 1))
        self.item, self.impact = np.array([i for _, i, _ in rows], np.int64), np.array([x for _, _, x in rows])
        peaks: dict[tuple[int, int], float] = {}
        for t, i, x in rows:
            peaks[t, i // POSTING_BLOCK] = max(x, peaks.get((t, i // POSTING_BLOCK), 0.0))
        tops = sorted((t, b, x) for (t, b), x in peaks.items())
        self.block_first = np.searchsorted(np.array([t for t, _, _ in tops]), np.arange(len(self.known) + 1))
        self.block, self.block_peak = np.array([b for _, b, _ in tops], np.int64), np.array([x for _, _, x in tops])
        self.term_peak = np.array([self.block_peak[a:z].max() for a, z in zip(self.block_first, self.block_first[1:], strict=False)])
        self.least = own * RETRIEVE * np.array([min(1.0, PASSAGE / max(1, len(c))) for c in self.coded])
        self.block_least = np.array([self.least[b : b + POSTING_BLOCK].min() for b in range(0, n, POSTING_BLOCK)])
        self.floor = float(self.least.min()) if n else np.inf

    def _pairs(self, coded: np.ndarray) -> np.ndarray:
        return coded[:-1] * (len(self.terms) + 1) + coded[1:]

    def candidates(self, coded: np.ndarray) -> dict[int, list[int]]:
        """Items that some passage reaches the threshold of, with the starts of those passages."""
        found: dict[int, list[int]] = {}
        pairs = self._pairs(coded)
        near = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        at = np.flatnonzero(self.known[near] == pairs)
        near = near[at]
        if self.term_peak[near].sum() < self.floor:  # not even the whole text reaches any item's threshold
            return found
        for s in range(0, max(1, len(coded) - PASSAGE + STEP), STEP):
            lo, hi = np.searchsorted(at, (s, s + PASSAGE)).tolist()
            terms = np.unique(near[lo:hi])
            if self.term_peak[terms].sum() < self.floor:
                continue
            q = _spread(self.block_first, terms)
            alive = np.bincount(self.block[q], self.block_peak[q], len(self.block_least)) >= self.block_least
            if not alive.any():
                continue
            q = _spread(self.first, terms)
            q = q[alive[self.item[q] // POSTING_BLOCK]]
            for i in np.flatnonzero(np.bincount(self.item[q], self.impact[q], len(self.ids)) >= self.least).tolist():
                found.setdefault(i, []).append(s)
        return found

    def leaks(self, found_words: list[str]) -> list[tuple[int, int, int]]:
        """(item_id, words carried, words of the item) for every item of which a text with these words carries enough."""
        none = len(self.terms)
        get = self.terms.get
        coded = np.array([get(w, none) for w in found_words], np.int64)
        if not len(coded) or not self.ids:
            return []
        out = [(self.ids[i], 1, 1) for i, c in enumerate(self.coded) if len(c) == 1 and c[0] in coded] if self.single else []
        if len(coded) < 2 or not len(self.known):
            return out
        for i, starts in self.candidates(coded).items():
            item = self.coded[i]
            enough, most = len(item) / CARRIED, 0
            covered = np.zeros(len(item), bool)
            begin, end = None, None
            for s in [*starts, None]:
                if begin is not None and (s is None or s > end):
                    # an alignment spans less than three times the item, so parts of six times the item, overlapping by half, hold it
                    for a in range(max(0, begin - PASSAGE), end + PASSAGE, 3 * max(len(item), PASSAGE)):
                        part = coded[a : min(end + PASSAGE, a + 6 * max(len(item), PASSAGE))]
                        most = max(most, _parts(item, part, covered))
                    begin = None
                if s is not None:
                    begin, end = (s if begin is None else begin), s + PASSAGE
            best = max(most, int(covered.sum()))
            if best >= enough:
                out.append((self.ids[i], best, len(item)))
        return out


def _parts(item: np.ndarray, part: np.ndarray, covered: np.ndarray) -> int:
    """Mark in `covered` the words of `item` in dense runs of `part`; return the words of its best alignment, dense or not."""
    if len(part) < 2:
        return 0
    least = min(RUN, max(2, len(item) // CARRIED))
    pair = np.isin(item[:-1] << 32 | item[1:], part[:-1] << 32 | part[1:])
    near = np.append(pair, False)
    near[1:] |= pair
    if near.sum() < 0.6 * least:  # fewer than three in five words of a run stand beside a neighbour of theirs
        return 0
    hits = aligned(item, part)
    if len(hits) < least:
        return len(hits)
    (i, j), (y, z) = hits[0], hits[-1]
    if len(hits) >= DENSE * max(y - i + 1, z - j + 1):
        covered[i : y + 1] = True
    # other runs may stand before or behind this one
    _parts(item, part[:j], covered)
    _parts(item, part[z + 1 :], covered)
    return len(hits)


def aligned(item: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Places (in item, in part) of the equal words of the best local alignment (word 1, lost, changed or added word -0.5).

    A single word at either end of it that stands behind lost or added words is left out: articles and conjunctions
    next to a quotation are found so by chance.
    """
    equal = item[:, None] == part[None, :]
    gap, n, m = 0.5, len(item), len(part)
    score = np.zeros((n + 1, m + 1), np.float32)
    along = np.arange(m, dtype=np.float32) * gap
    for i in range(1, n + 1):
        gain = np.where(equal[i - 1], np.float32(1), np.float32(-gap))
        row = np.maximum(np.maximum(score[i - 1, :-1] + gain, score[i - 1, 1:] - gap), 0)
        score[i, 1:] = np.maximum.accumulate(row + along) - along
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    hits: list[tuple[int, int]] = []
    while i > 0 and j > 0 and score[i, j] > 1e-6:
        if abs(score[i, j] - (score[i - 1, j - 1] + (1 if equal[i - 1, j - 1] else -gap))) < 1e-4:
            i, j = i - 1, j - 1
            if equal[i, j]:
                hits.append((int(i), int(j)))
        elif abs(score[i, j] - (score[i - 1, j] - gap)) < 1e-4:
            i -= 1
        else:
            j -= 1
    late, early = _by_chance(hits), _by_chance(hits[::-1])
    return hits[late : len(hits) - early][::-1]


def _by_chance(hits: list[tuple[int, int]]) -> int:
    """How many single words (item, part) begin an alignment, each off the diagonal of the next."""
    n = 0
    while n + 1 < len(hits) and hits[n][0] - hits[n][1] != hits[n + 1][0] - hits[n + 1][1]:
        n += 1
    return n if n + 1 < len(hits) else 0


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs of neighbouring words of every item that has any."""
    for b in batches:
        rows = [(i, w) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) if t and (w := words(t))]
        pairs = [[f"{x} {y}" for x, y in zip(w, w[1:], strict=False)] for _, w in rows]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.string()))], ["item_id", "words", "pairs"])


def indexed(items: DataFrame) -> tuple[DataFrame, tuple[int, float]]:
    """item_id, words and, for each pair of neighbours, the number of items that have it; the number of items and their mean of pairs."""
    # rows with the same id and text are one item
    listed = checkpoint(items.select("item_id", "text").distinct().mapInArrow(_listed, "item_id bigint, words array<string>, pairs array<string>").withColumn("row", F.monotonically_increasing_id()))
    flat = listed.select("row", F.posexplode("pairs").alias("pos", "pair"))
    df = flat.groupBy("pair").agg(F.count_distinct("row").alias("df"))
    freqs = flat.join(df, "pair").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "df"))), lambda x: x["df"]).alias("freqs"))
    n, mean = listed.agg(F.count(F.lit(1)), F.avg(F.size("pairs"))).first()
    return listed.join(freqs, "row", "left").select("item_id", "words", F.coalesce("freqs", F.array().cast("array<bigint>")).alias("freqs")), (n, max(1.0, mean or 0.0))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document that carries at least a third of a test item's words as running text, with the item.

    docs: doc_id, text; items: item_id, text. The stated set of test items is indexed in blocks of INDEX_ITEMS, INDEXES of
    which are held against all passages of all documents, whole texts, in one reading; the passages overlap by half. An
    item may be carried in several runs, whose words add up. An item of one word is carried by texts with that word.
    Null and empty texts leak nothing; repeated documents are reported each.
    Returns doc_id, item_id, n_carried, n_words.
    """
    spark = docs.sparkSession
    listed, total = indexed(items)
    blocks = max(1, -(-total[0] // INDEX_ITEMS))
    listed = checkpoint(listed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    found = None
    for k in range(0, blocks, INDEXES):
        shared = []
        for j in range(k, min(blocks, k + INDEXES)):
            rows = listed.where(F.col("block") == j).orderBy("item_id", "words").collect()  # about INDEX_ITEMS
            shared.append(spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["words"] for r in rows], [r["freqs"] for r in rows])))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = [Index(*x.value, total) for x in shared]
            for b in batches:
                out = []
                for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    if t and (w := words(t)):
                        out += {(d, *x) for index in indexes for x in index.leaks(w)}
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "n_carried", "n_words"])

        one = spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(search, "doc_id bigint, item_id bigint, n_carried int, n_words int")
        found = one if found is None else found.unionByName(one)
    return found
