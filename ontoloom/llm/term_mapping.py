"""Mapping freely typed values to a reference list: token-level repair by edit distance, then soft TF-IDF."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint, lookup, spread

#: Reference entries ranked at a time; a longer list is taken in as many blocks as it needs. Statistics are those of the whole list.
BLOCK = 20_000
#: Least soft TF-IDF of a match.
LEAST = 0.6
#: A word of no entry says nothing if at least so many entries are complete without it, and of the values that hold it at
#: least this share.
NOISE_ENTRIES, NOISE_SHARE = 3, 0.5
#: Letters of a word whose deletions are joined, and the most edits of any word.
PREFIX, EDITS = 8, 3

_CAMEL = re.compile(r"(?<=[a-zà-ÿ0-9])(?=[A-ZÀ-Þ])|(?<=[A-ZÀ-Þ])(?=[A-ZÀ-Þ][a-zà-ÿ])")
_WORD = re.compile(r"[^\W_]+\.?")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def tokens(value: str) -> list[str]:
    """Tokens of a typed value, numbers and the s of a genitive left out; an abbreviation keeps its full stop."""
    plain = re.sub(r"['’]s\b", " ", value)
    parts = plain if plain.isupper() or plain.islower() else _CAMEL.sub(" ", plain)
    found = [fold(w) for w in _WORD.findall(parts)]
    return [w for w in found if not w.rstrip(".").isdigit()]


def compact(words: list[str]) -> str:
    """Words as one."""
    return "".join(w.rstrip(".") for w in words)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            c = before[j - 1] + (x != y)
            c = min(c, before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before2[j - 2] + 1)
            row[j] = c
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return before[-1]


def allowed(n: int) -> int:
    """Edits that a word of n letters may have."""
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 8 else EDITS


def deletions(word: str, edits: int) -> set[str]:
    """The first PREFIX letters of a word with up to `edits` of them left out.

    Words within so many edits (a swap of neighbours is one) of each other share one of these: leaving out of both what an
    alignment of them changes gives the same letters, of which the shorter beginning is reached from both.
    """
    start = word[:PREFIX]
    return {"".join(c for i, c in enumerate(start) if i not in gone) for k in range(min(edits, len(start)) + 1) for gone in combinations(range(len(start)), k)}


def forms(token: str) -> list[tuple[str, int]]:
    """What a token may be a form of, with a rank: itself, or a singular."""
    word = token.rstrip(".")
    out = [(word, 1)]
    for end, new in (("ies", "y"), ("es", ""), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 3:
            out.append((word[: -len(end)] + new, 2))
    return out


def _key(edits: int, text: str) -> int:
    return edits << 56 | zlib.crc32(text.encode()) << 24 | zlib.adler32(text.encode()) & 0xFFFFFF


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of labels, neighbours written as one word and short forms: word, parts, edits."""
    for b in batches:
        rows = []
        for label, short in zip(b["label"], b["short_form"], strict=True):
            ws = tokens(label)
            rows += [("".join(ws[i:j]), ws[i:j], allowed(sum(map(len, ws[i:j])))) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)]
            if short and (one := compact(tokens(short))):
                rows.append((one, [one], 0))
        yield pd.DataFrame([(w, [x.rstrip(".") for x in p], e) for w, p, e in ((w.rstrip("."), p, e) for w, p, e in rows)], columns=["word", "parts", "edits"])


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join keys of vocabulary words: deletions, and beginnings for abbreviations of single words."""
    for b in batches:
        rows: list[tuple[str, int]] = []
        for w, parts, e in zip(b["word"].to_pylist(), b["parts"].to_pylist(), b["edits"].to_pylist(), strict=True):
            rows += [(w, _key(e, x)) for x in deletions(w, e)]
            if len(parts) == 1:
                rows += [(w, _key(100, w[:n])) for n in range(3, len(w) + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64())], ["word", "key"])


def _token_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join keys of tokens: deletions of all their forms for every number of edits that a word of such length may have."""
    for b in batches:
        rows: list[tuple[str, int]] = []
        for t in b["token"].to_pylist():
            keys = set()
            for form, _ in forms(t):
                for e in {allowed(n) for n in range(max(1, len(form) - EDITS), len(form) + EDITS + 1)}:
                    keys |= {_key(e, x) for x in deletions(form, e)}
            if t.endswith(".") and len(t) > 3:
                keys.add(_key(100, t[:-1]))
            rows += [(t, k) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64())], ["token", "key"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a token and a word that hold, with rank (abbreviation, equal, singular, by edits) and similarity."""
    for b in batches:
        rows = []
        for t, w, single, e in zip(b["token"].to_pylist(), b["word"].to_pylist(), b["single"].to_pylist(), b["edits"].to_pylist(), strict=True):
            if single and t.endswith(".") and len(t) > 3 and w.startswith(t[:-1]):
                rows.append((t, w, 0, 0.95))
                continue
            best = None
            for form, rank in forms(t):
                d = distance(form, w, e)
                found = (rank, 1.0 if rank == 1 else 0.98) if d == 0 else (2 + d, 1 - d / len(w)) if d <= e else None
                best = found if best is None or (found and found < best) else best
            if best:
                rows.append((t, w, *best))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)], ["token", "word", "rank", "sim"])


def vocabulary(reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary of the whole reference (word, parts, edits) and its join keys (word, key), both written."""
    listed = reference.where("label is not null").select("label", "short_form").mapInPandas(_vocabulary, "word string, parts array<string>, edits int")
    words = listed.where("word <> ''").groupBy("word").agg(F.min(F.struct(F.size("parts").alias("n"), "parts")).alias("p"), F.max("edits").alias("edits"))
    words = checkpoint(words.select("word", "p.parts", "edits"))
    return words, checkpoint(words.mapInArrow(_word_keys, "word string, key bigint"))


def repair(words: DataFrame, known: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(token, rank, fits): the vocabulary words that each distinct token may stand for, those of the best rank.

    Tokens and vocabulary meet in an equi-join on shared deletions of their beginnings, which misses none within the
    edits allowed, and are then compared whole.
    """
    vocab, keys = known
    asked = spread(words, "token").mapInArrow(_token_keys, "token string, key bigint")
    pairs = asked.join(keys, "key").select("token", "word").distinct()
    single = F.size("parts") == 1
    short = F.abs(F.length("token") - F.length("word")) <= F.col("edits") + 3  # a plural ending of three letters at most
    pairs = checkpoint(pairs.join(vocab, "word").where(short | (single & F.col("token").endswith("."))).select("token", "word", single.alias("single"), "edits"))
    held = spread(pairs, "token").mapInArrow(_verified, "token string, word string, rank int, sim double").join(vocab.select("word", "parts"), "word")
    best = held.groupBy("token").agg(F.min("rank").alias("r"), F.collect_list(F.struct("rank", "word", "parts", "sim")).alias("all"))
    fits = F.transform(F.filter("all", lambda x: x["rank"] == F.col("r")), lambda x: F.struct(x["word"].alias("word"), x["parts"].alias("parts"), x["sim"].alias("sim")))
    return checkpoint(best.select("token", F.col("r").alias("rank"), F.array_sort(fits).alias("fits")))


@dataclass
class Entries:
    """One block of reference entries with the words of their labels; a short form is an entry of one word."""

    rows: list[tuple[str, str, list[str]]]  # uri, short form ("" for none), words
    idf: dict[str, float]
    by_word: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self) -> None:
        for i, (_, _, ws) in enumerate(self.rows):
            for w in set(ws):
                self.by_word[w].append(i)

    def rank(self, bag: list[tuple[str, list[tuple[str, list[str], float]]]]) -> tuple[str, float, list[str]] | None:
        """The entry all of whose words are accounted for with the fewest tokens over, then the highest soft TF-IDF.

        bag: tokens, each with the words that it may stand for, their parts and similarities. Returns uri, score and the
        tokens of the bag that are over, or None.
        """
        held = {i for _, fits in bag for _, parts, _ in fits for p in parts for i in self.by_word.get(p, ())}
        best: tuple[int, float, str, list[str]] | None = None
        for i in held:
            uri, short, ws = self.rows[i]
            need, total, norm, over = Counter(ws), 0.0, 0.0, []
            for token, fits in bag:
                if short and token.rstrip(".") == short:
                    continue
                fit = max(((sim, parts) for _, parts, sim in fits if not Counter(parts) - need), key=lambda x: x[0], default=None)
                if fit is None:
                    over.append(token.rstrip("."))
                    continue
                need.subtract(fit[1])
                for p in fit[1]:
                    total += self.idf[p] ** 2 * fit[0]
                    norm += self.idf[p] ** 2
            if norm and not any(c > 0 for c in need.values()):
                score = total / math.sqrt(sum(self.idf[w] ** 2 for w in ws) * norm)
                found = (len(over), -score, uri, over)
                if score >= LEAST and (best is None or found < best):
                    best = found
        return best and (best[2], -best[1], best[3])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for uri, label, short in zip(b["uri"], b["label"], b["short_form"], strict=True):
            one = compact(tokens(short)) if short else ""
            rows.append((uri, one, [w.rstrip(".") for w in tokens(label)]))
            if one:
                rows.append((uri, "", [one]))
        yield pd.DataFrame(rows, columns=["uri", "short", "words"])


def _blocks(rows: DataFrame) -> Iterator[Entries]:
    """The entries in blocks of about BLOCK, with word statistics of the whole list."""
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    blocks = max(1, -(-n // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uri"), F.lit(blocks)))
    for k in range(blocks):
        block = rows.where(F.col("block") == k)
        own = block.select(F.explode("words").alias("word")).distinct().join(df, "word").collect()  # the words of about BLOCK entries
        listed = block.select("uri", "short", "words").orderBy("uri", "short", "words").collect()
        yield Entries([tuple(r) for r in listed], {r["word"]: math.log(1 + n / r["df"]) for r in own})


def _split(value: pd.Series) -> pd.Series:
    return value.map(tokens)


def _ranker(shared: Broadcast):
    def rank(bag: pd.Series) -> pd.DataFrame:
        bags = ([(t["token"], [(c["word"], list(c["parts"]), c["sim"]) for c in (t["fits"] if t["fits"] is not None else ())]) for t in b] for b in bag)
        return pd.DataFrame([shared.value.rank(b) or (None, 0.0, []) for b in bags], columns=["uri", "score", "over"])

    return F.pandas_udf(rank, "uri string, score double, over array<string>")


def _ranked(bags: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, uri, score, over): the best entry of all blocks for each bag of repaired tokens; uri null without any."""
    found = None
    for block in _blocks(entries):
        shared = bags.sparkSession.sparkContext.broadcast(block)  # about BLOCK entries
        one = spread(bags, "value").select("value", _ranker(shared)("bag").alias("m")).select("value", "m.*")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("value").agg(F.min(F.when(F.col("uri").isNotNull(), F.struct(F.size("over").alias("n"), (-F.col("score")).alias("s"), "uri", "over"))).alias("m"))
    return checkpoint(best.select("value", "m.uri", (-F.col("m.s")).alias("score"), "m.over"))


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """The reference entry meant by each distinct value.

    values: a column value, repeated or not; reference: uri, label, short_form. Distinct values are taken
    apart into tokens, each distinct token is repaired once against the vocabulary of the whole reference, and the
    repaired tokens are put back together to rank whole entries. An entry is meant if every word of its label is
    accounted for and the tokens over say nothing: these are learned as words of no entry without which many values name
    many entries (articles, notes, marks of drafts). What is left is repaired as one word, for values that are torn,
    run together or spelled with full stops; several words at the same distance name no entry. Otherwise the value, also
    an empty one, is UNMATCHED.
    The reference is ranked in blocks of BLOCK entries, each entry in one of them; of several matches the one with fewest
    tokens over wins, then the highest score, then the smallest uri. Null values are left out. Returns value, uri, score.
    """
    known = vocabulary(reference)
    entries = checkpoint(reference.where("label is not null").mapInPandas(_entries, "uri string, short string, words array<string>").where("size(words) > 0"))
    distinct = checkpoint(values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("rows")).select("value"))
    listed = checkpoint(spread(distinct, "value").select("value", F.posexplode_outer(F.pandas_udf(_split, "array<string>")("value")).alias("pos", "token")))
    words = checkpoint(listed.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token"))
    placed = lookup(listed, repair(words, known), "token")
    bags = checkpoint(placed.groupBy("value").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token", "fits")))).alias("bag")))
    best = _ranked(bags, entries)

    # words of no entry: of the values that hold them, how many are complete without them, and for how many entries
    bare = listed.where("token is not null").select("value", "pos", F.regexp_replace("token", r"\.$", "").alias("token"))
    over = best.select("value", "uri", F.explode("over").alias("token")).distinct()
    counts = over.groupBy("token").agg(F.count_distinct("uri").alias("entries"), F.count(F.lit(1)).alias("n_complete"))
    held = lookup(bare.select("value", "token").distinct(), counts, "token", "inner").where(F.col("entries") >= NOISE_ENTRIES)
    noise = checkpoint(held.groupBy("token", "n_complete").agg(F.count(F.lit(1)).alias("n")).where(F.col("n_complete") >= NOISE_SHARE * F.col("n")).select("token", F.lit(True).alias("noise")))
    open_ = lookup(over.select("value", "token"), noise, "token").groupBy("value").agg(F.count_if(F.col("noise").isNull()).alias("open"))
    settled = best.join(open_, "value", "left").where("uri is not null and coalesce(open, 0) = 0").select("value", "uri", "score")
    settled = checkpoint(settled)

    # the others as one word, with and without the words that say nothing
    rest = lookup(bare.join(settled.select("value"), "value", "left_anti"), noise, "token")
    parts = rest.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "noise"))).alias("t"))
    joined = lambda t: F.array_join(F.transform(t, lambda x: x["token"]), "")
    ones = checkpoint(parts.select("value", F.posexplode(F.array_distinct(F.array(joined(F.col("t")), joined(F.filter("t", lambda x: x["noise"].isNull()))))).alias("which", "token")).where("token <> ''"))
    whole = repair(checkpoint(ones.select("token").distinct()), known).where("size(fits) = 1")
    nearest = lookup(ones, whole, "token", "inner").groupBy("value").agg(F.min(F.struct("rank", "which", "token", "fits")).alias("b"))
    late = _ranked(checkpoint(nearest.select("value", F.array(F.struct(F.lit(0).alias("pos"), F.col("b.token").alias("token"), F.col("b.fits").alias("fits"))).alias("bag"))), entries)
    found = settled.unionByName(late.where("uri is not null").select("value", "uri", "score"))
    out = distinct.join(found, "value", "left")
    return out.select("value", F.coalesce("uri", F.lit("UNMATCHED")).alias("uri"), F.coalesce("score", F.lit(0.0)).alias("score"))


def apply_mapping(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with a column value, joined with their mapping; a value may hold any share of the rows."""
    return lookup(rows, mapping.select("value", F.col("uri").alias("matched_uri")), "value", "inner")
