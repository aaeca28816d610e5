"""Text cut off by field limits: end-of-text against continuation under a backward character n-gram model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint

#: Context lengths of the model, longest first.
ORDERS = (16, 10, 6, 3)
#: A context counts if the corpus has it this often; otherwise the next shorter one is asked.
SUPPORT = 8
#: Thresholds are learned from synthetic cuts of all texts of at least CUT_FROM characters and from values that end in a full
#: stop; a language and field with fewer than FEW of either takes the thresholds of all together.
CUT_FROM, FEW = 20, 50
#: The share of cut values assumed before the first look at a group, and the bounds of the share found in it.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.001, 0.95
#: Thresholds lie on a grid of this step.
GRID = 0.05
#: Bits of the table that says which contexts are asked for; where it fills up, contexts are only counted in vain.
TABLE_BITS = 24
#: A length is a limit if it is this many times as frequent as its neighbours, and so frequent by chance with a
#: probability of at most exp(-LIMIT_TAIL) (Chernoff's bound of the Poisson tail; 12 values against 3, or 4 against none).
LIMIT_PEAK, LIMIT_TAIL = 4.0, 7.6

# Frequent function words by language.
_LANGUAGES = {
    "en": "the of and to that is are was which with for from by as this not its it or be",
    "fr": "le la les des du et est une que qui dans pour par sur avec sont au ou ce ne",
    "de": "der die das und ist ein eine den dem von mit für auf nicht wird sich als zu bei im",
    "es": "el la los las de y es una que en por con para del se su al lo como sin",
}

#: What cutting and repairing leave at the end of a value.
_MARK = r"(?:\s*(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\x{FFFD}|\\[nrtu\\]?))+\s*$"
_SPACE = r"[\s\x{00A0}]+$"


def with_tails(rows: DataFrame) -> DataFrame:
    """Rows with `core`, the text before what follows its last word, and `kind`, that of its tail: marked, stop or plain.

    Step by step, so that each pattern is matched once a row.
    """
    rows = rows.withColumn("_t", F.regexp_replace("text", _SPACE, ""))
    quoted = F.col("_t").startswith('"') & F.col("_t").endswith('"') & (F.length("_t") > 1)
    rows = rows.withColumn("_t", F.when(quoted, F.col("_t").substr(F.lit(2), F.length("_t") - 2)).otherwise(F.regexp_replace("_t", r'^"', "")))
    # a quote that closes nothing was added to a cut value
    quotes = F.length("_t") - F.length(F.replace("_t", F.lit('"'), F.lit("")))
    rows = rows.withColumn("_stray", F.col("_t").endswith('"') & (quotes % 2 == 1))
    rows = rows.withColumn("_t", F.when(F.col("_stray"), F.regexp_replace("_t", r'"$', "")).otherwise(F.col("_t")))
    rows = rows.withColumn("_c", F.regexp_replace("_t", _MARK, ""))
    marked = F.col("_stray") | (F.length("_c") < F.length("_t"))
    rows = rows.withColumn("_stop", F.col("_c").rlike(r"[.!?。]$")).withColumn("kind", F.when(marked, "marked").when(F.col("_stop"), "stop").otherwise("plain"))
    bare = F.when(F.col("_stop"), F.col("_c").substr(F.lit(1), F.length("_c") - 1)).otherwise(F.col("_c"))
    return rows.withColumn("core", F.lower(F.regexp_replace(bare, r"\s+", " "))).drop("_t", "_c", "_stray", "_stop")


def with_language(rows: DataFrame) -> DataFrame:
    """Rows with `lang` filled, where it is null, by the language most of whose function words the text holds.

    It stays null if the text holds none, or as many of two languages.
    """
    rows = rows.withColumn("_w", F.when(F.col("lang").isNull(), F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))))
    own = [F.size(F.array_intersect("_w", F.array(*map(F.lit, w.split())))).alias(k) for k, w in _LANGUAGES.items()]
    ranked = F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(k).alias("lang")) for k, n in zip(_LANGUAGES, own, strict=True)]))
    rows = rows.withColumn("_b", F.when(F.col("lang").isNull(), ranked))
    clear = (F.col("_b")[0]["n"] < 0) & (F.col("_b")[0]["n"] < F.col("_b")[1]["n"])
    return rows.withColumn("lang", F.coalesce("lang", F.when(clear, F.col("_b")[0]["lang"]))).drop("_w", "_b")


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k codes before every position, the whole array being one long text."""
    base = np.uint64(1099511628211)
    h = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            shifted = np.zeros(len(codes) + 1, np.uint64)
            shifted[i + 1 :] = codes[: len(codes) - i]
            h += (shifted + np.uint64(1)) * base ** np.uint64(i + 1)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)


def _positions(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each led by ORDERS[0] start codes, the end position of each text and a mask of inner positions."""
    pad = "\x02" * ORDERS[0]
    joined = "".join(pad + t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([ORDERS[0] + len(t) for t in texts])
    inner = np.ones(len(codes) + 1, bool)
    inner[ends] = False
    starts = ends - np.array([ORDERS[0] + len(t) for t in texts])
    for i in range(ORDERS[0]):
        inner[starts + i] = False
    return codes, ends, inner


def _asked(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the contexts `table` may hold; their lower bits are the place in it."""
    place = h & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _count(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Partial counts of the contexts asked for, per model: how often a text ends there and how often it goes on."""
    for b in batches:
        models = b["model"].to_numpy(zero_copy_only=False)
        texts = np.array(b["core"].to_pylist(), object)
        for f in set(models):
            codes, ends, inner = _positions(list(texts[models == f]))
            for k in ORDERS:
                h = _hashes(codes, k)
                on, off = h[inner], h[ends]
                ctx, n = np.unique(on[_asked(on, table)], return_counts=True)
                end, m = np.unique(off[_asked(off, table)], return_counts=True)
                both = np.concatenate([ctx, end]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(both), pa.string()), pa.array(both), pa.array(np.concatenate([np.zeros(len(n), np.int64), m])), pa.array(np.concatenate([n, np.zeros(len(m), np.int64)]))],
                    ["model", "ctx", "ends", "goes"],
                )


def _final(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    """The contexts at the end of every text or, with `cut`, at a place between a fifth and the last twentieth that its digest chooses."""
    for b in batches:
        texts = b["core"].to_pylist()
        codes, ends, _ = _positions(texts)
        if cut:
            ends = ends - np.array([len(t) - int(len(t) * (0.2 + 0.75 * (zlib.crc32(t.encode()) % 1000) / 1000)) for t in texts], np.int64)
        hs = [pa.array(_hashes(codes, k)[ends].view(np.int64)) for k in ORDERS]
        keep = [c for c in b.schema.names if c != "core"]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *hs], [*keep, *(f"c{k}" for k in ORDERS)])


def _table(asked: DataFrame) -> np.ndarray:
    """Bit table of the contexts asked for: 2 ** TABLE_BITS bits, however many there are."""
    place = F.col("ctx").bitwiseAND((1 << TABLE_BITS) - 1)
    words = asked.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(ctx & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy(np.int64).view(np.uint64)
    return table


def _best(errors: DataFrame, groups: DataFrame) -> DataFrame:
    """The threshold of each group (model, ..., pi): the one of its model's with the fewest expected errors, then the lowest."""
    cost = (1 - F.col("pi")) * F.col("whole_below") + F.col("pi") * F.col("cut_above")
    return groups.join(errors, "model").groupBy(*groups.columns).agg(F.min(F.struct(F.round(cost, 9).alias("cost"), "at")).alias("b")).select(*groups.columns, F.col("b.at").alias("threshold"))


def _errors(finals: DataFrame, cuts: DataFrame) -> DataFrame:
    """(model, at, whole_below, cut_above): shares of whole values below, and of synthetic cuts from, each point of the grid.

    Whole are the values that end in a full stop. The model `*` takes all models together.
    """
    at = F.floor(F.greatest(F.least(F.col("log_odds"), F.lit(12.0)), F.lit(-15.0)) / GRID)
    sets = finals.where("kind = 'stop'").select("model", at.alias("bin"), F.lit(1).alias("w"), F.lit(0).alias("c")).unionByName(cuts.select("model", at.alias("bin"), F.lit(0).alias("w"), F.lit(1).alias("c")))
    bins = sets.groupBy("model", "bin").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    bins = bins.unionByName(bins.groupBy(F.lit("*").alias("model"), "bin").agg(F.sum("w").alias("w"), F.sum("c").alias("c")))
    # a few hundred bins a model
    order = Window.partitionBy("model").orderBy("bin")
    every = Window.partitionBy("model")
    share = lambda c, over: F.sum(c).over(over) / F.greatest(F.sum(c).over(every), F.lit(1))
    return bins.select(
        "model", ((F.col("bin") + 1) * GRID).alias("at"), share("w", order).alias("whole_below"), (1 - share("c", order)).alias("cut_above"), F.sum("w").over(every).alias("n_whole"), F.sum("c").over(every).alias("n_cut")
    ).where(f"model = '*' or (n_whole >= {FEW} and n_cut >= {FEW})")


def truncated(values: DataFrame) -> DataFrame:
    """Score every text value and say whether it was cut before its end.

    values: row_key (bigint), source, field, lang and text; where lang is null it is taken from the function words of the
    text, or is that of most values of the field. The backward model is trained on all different texts of the same language
    and field: for the last 16, 10, 6 and 3 characters before each position it counts how often a text ends there
    and how often it goes on. A value's log-odds come from the longest of its final contexts with enough support, its own
    text left out.

    The threshold is the one with the fewest expected errors between values that end in a full stop, taken as whole, and
    synthetic cuts, one of each different text, of the same language and field, given the share of cut values in the group.
    Groups are values with a mark of cutting, with a full stop or with neither at their end, each apart for lengths that
    pile up in a source and field; a group's share is that of its values below the threshold for PRIOR. Null, empty and
    `null` values are no cases and train nothing.
    Returns row_key, source, field, log_odds, at_limit, kind, is_cut, one row per value with a text.
    """
    rows = values.where(F.col("text").isNotNull() & ~F.lower(F.trim("text")).isin("", "null"))
    rows = with_language(with_tails(rows.select("row_key", "source", "field", "lang", "text")))
    rows = checkpoint(rows.select("row_key", "source", "field", "lang", F.char_length("text").alias("n"), "core", "kind"))
    usual = rows.where("lang is not null").groupBy("field", "lang").agg(F.count(F.lit(1)).alias("c")).groupBy("field").agg(F.max_by("lang", F.struct("c", "lang")).alias("usual"))  # a row a field
    rows = rows.join(usual, "field", "left").withColumn("model", F.concat_ws("/", F.coalesce("lang", "usual", F.lit("")), "field")).drop("lang", "usual")
    # text lengths that pile up: one count per source, field and length, of different texts
    lens = rows.groupBy("source", "field", "n", "core", "kind").agg(F.count(F.lit(1)).alias("copies")).groupBy("source", "field", "n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("kind") != "stop", 1).otherwise(0)).alias("open"))
    near = lens.select("source", "field", F.explode(F.sequence(F.col("n") - 4, F.col("n") + 4)).alias("n"), "open").groupBy("source", "field", "n").agg(F.sum("open").alias("around"))
    mean = (F.col("around") - F.col("open")) / 8
    chance = F.greatest(mean, F.lit(1 / 8))
    tail = F.col("open") * F.log(F.col("open") / chance) - F.col("open") + chance
    limits = lens.join(near, ["source", "field", "n"]).where((F.col("open") > LIMIT_PEAK * mean) & (F.col("open") > chance) & (tail >= LIMIT_TAIL)).select("source", "field", "n", F.lit(True).alias("at_limit"))

    cs = [f"c{k}" for k in ORDERS]
    c_schema = ", ".join(f"{c} bigint" for c in cs)
    schema = f"row_key bigint, source string, field string, model string, n int, kind string, {c_schema}"
    finals = checkpoint(rows.select("row_key", "source", "field", "model", "n", "kind", "core").mapInArrow(lambda it: _final(it, False), schema))
    # copies of a text count once, so that none of them vouches for the end of another
    texts = checkpoint(rows.select("model", "core").distinct())
    cuts = checkpoint(texts.where(F.char_length("core") >= CUT_FROM).mapInArrow(lambda it: _final(it, True), f"model string, {c_schema}"))
    # distinct contexts first: many values end alike
    asked = checkpoint(finals.select("model", *cs, F.lit(False).alias("cut")).unionByName(cuts.select("model", *cs, F.lit(True).alias("cut"))).distinct())
    long = asked.select("model", *cs, "cut", F.posexplode(F.array(*cs)).alias("level", "ctx"))
    shared = rows.sparkSession.sparkContext.broadcast(_table(long.select("ctx")))
    counts = texts.mapInArrow(lambda it: _count(it, shared.value), "model string, ctx bigint, ends bigint, goes bigint").groupBy("model", "ctx").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    known = long.join(counts, ["model", "ctx"]).where(F.col("ends") + F.col("goes") >= SUPPORT)
    best = known.groupBy("model", *cs, "cut").agg(F.min(F.struct("level", "ends", "goes")).alias("b"))
    # a value's own end, and the place of a synthetic cut, are left out of the counts
    odds = checkpoint(best.select("model", *cs, "cut", F.when(F.col("cut"), F.log((F.col("b.ends") + 0.5) / (F.col("b.goes") - 0.5))).otherwise(F.log((F.col("b.ends") - 0.5) / (F.col("b.goes") + 0.5))).alias("log_odds")))
    scored = finals.join(odds.where("not cut").drop("cut"), ["model", *cs], "left").join(limits, ["source", "field", "n"], "left")
    scored = checkpoint(scored.select("row_key", "source", "field", "model", "kind", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), F.coalesce("log_odds", F.lit(0.0)).alias("log_odds")))
    cut_odds = cuts.join(odds.where("cut").drop("cut"), ["model", *cs], "left").select("model", F.coalesce("log_odds", F.lit(0.0)).alias("log_odds"))

    errors = checkpoint(_errors(scored, cut_odds))  # a few hundred rows a model
    models = scored.select("model").distinct().join(errors.where("model <> '*'").select("model", F.lit(True).alias("own")).distinct(), "model", "left").select("model", F.when(F.col("own"), F.col("model")).otherwise("*").alias("from"))
    spread_errors = models.join(errors.withColumnRenamed("model", "from"), "from").select("model", "at", "whole_below", "cut_above")
    first = _best(spread_errors, models.select("model", F.lit(PRIOR).alias("pi"))).select("model", F.col("threshold").alias("first"))
    share = (F.count_if(F.col("log_odds") < F.col("first")) + 1) / (F.count(F.lit(1)) + 2)
    groups = scored.join(first, "model").groupBy("model", "kind", "at_limit").agg(F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), share)).alias("pi"))
    thresholds = checkpoint(_best(spread_errors, groups).select("model", "kind", "at_limit", "threshold"))  # six rows a model at most
    out = scored.join(thresholds, ["model", "kind", "at_limit"], "left")
    return out.select("row_key", "source", "field", "log_odds", "at_limit", "kind", F.coalesce(F.col("log_odds") < F.col("threshold"), F.lit(False)).alias("is_cut"))
