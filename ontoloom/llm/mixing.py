"""Mixing sources to target weights: whole copies plus balanced (cube method) sampling of the fractional rest."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint, spread

#: Public vocabulary whose tokens measure the texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: About so many documents are balanced in one task.
BLOCK = 20_000
#: Blocks whose remainders are balanced together on the next level.
FAN = 256

# Fixed value: the split pattern of the public vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _splitter(path: str):
    import regex

    return regex.compile(_PATTERN)


def count_tokens(texts: list[str | None], path: str, memo: dict[str, int], limit: int = 200_000) -> list[int]:
    """Tokens of each text; 0 for null and empty ones.

    The tokenizer never merges across the pieces of its pattern, so the tokens of a piece are counted once
    and remembered; memo is emptied when it holds `limit` pieces.
    """
    enc, cut = _encoding(path), _splitter(path)
    out = []
    for t in texts:
        n = 0
        if t:
            for piece in cut.findall(t):
                c = memo.get(piece)
                if c is None:
                    if len(memo) >= limit:
                        memo.clear()
                    c = memo[piece] = len(enc.encode_ordinary(piece))
                n += c
        out.append(n)
    return out


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of every document; a null text has 0 tokens. tokenizer: path of a public vocabulary."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(count_tokens(b["text"].to_pylist(), tokenizer, memo), pa.int64())], ["doc_id", "source", "n_tokens"])

    return spread(docs.select("doc_id", "source", "text"), "doc_id").mapInArrow(sizes, "doc_id bigint, source string, n_tokens bigint")


def flight(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase of the cube method: probabilities with at most two left between 0 and 1.

    The constraints are the expected number of documents and of tokens. Three undecided documents at a time
    are moved along the null space of their constraints until one of them is decided, with a random sign
    that keeps every probability in expectation. Both totals stay as they were.
    """
    rng = np.random.default_rng(seed)
    p = prob.astype(float).copy()
    p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    # the constraint columns of document i are (1, size_i): its null space among three has a closed form
    order = rng.permutation(np.flatnonzero((p > 0) & (p < 1)))
    draws = rng.random(len(order) + 1)
    active: list[int] = []
    for step, i in enumerate([*order.tolist(), -1]):
        if i >= 0:
            active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        sa, sb, sc = float(size[a]), float(size[b]), float(size[c])
        u = (sb - sc, sc - sa, sa - sb)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up, down = np.inf, np.inf
        for k, d in zip((a, b, c), u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        move = up if draws[step] * (up + down) < down else -down
        for k, d in zip((a, b, c), u, strict=True):
            p[k] += move * d
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        active = [k for k in active if 0 < p[k] < 1]
    return p


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the one or two documents that are left, so that the token total moves least."""
    p = prob.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[left] * size[left]).sum())
    choices = [[int(i == j) for j in range(len(left))] for i in range(len(left))] + [[0] * len(left), [1] * len(left)]
    best = min(choices, key=lambda x: abs(sum(a * float(size[k]) for a, k in zip(x, left, strict=True)) - want)) if len(left) else []
    p[left] = best
    return p


def _level(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    """Balance each group (source, block); rows: doc_id, source, n_tokens, whole, prob, block."""

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        p = flight(pdf["prob"].to_numpy(), pdf["n_tokens"].to_numpy(), seed + int(pdf["block"].iloc[0]) % 1_000_003)
        return pdf.assign(prob=land(p, pdf["n_tokens"].to_numpy()) if last else p)

    return rows.groupBy("source", "block").applyInPandas(balance, "doc_id bigint, source string, n_tokens bigint, whole int, prob double, block bigint")


def plan_shares(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """How often each source is taken: source, tokens, docs, target_share, max_repeats, budget (tokens), rate.

    The mix is as large as the caps allow: the total T is the least of max_repeats * tokens / target_share over the
    sources that have a target and tokens, with the shares of those sources brought to a sum of 1.
    """
    have = totals.join(targets.where(F.col("target_share") > 0), "source").where("tokens > 0")
    whole = have.agg(F.sum("target_share")).scalar()
    have = have.withColumn("share", F.col("target_share") / whole)
    most = have.agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("share"))).scalar()
    return have.select("source", "tokens", "docs", "target_share", "max_repeats", (most * F.col("share")).alias("budget"), (most * F.col("share") / F.col("tokens")).alias("rate"))


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix and its plan.

    docs: doc_id, source, text; targets: source, target_share, max_repeats. Every document of a source is
    taken floor(rate) times; the fractional rest is a balanced sample of its documents by the cube method,
    in blocks of documents whose undecided one or two go to the next level, until one landing problem per source remains.
    No document is taken more than max_repeats times. Sources without a target, null sources and documents
    without tokens are left out of the mix.
    Returns (doc_id, source, n_tokens, copies) with copies >= 1, and the plan of `plan_shares`.
    """
    sized = checkpoint(token_sizes(docs, tokenizer))
    totals = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = checkpoint(plan_shares(totals, targets))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("long")
    rate = F.least(F.col("rate"), F.col("max_repeats").cast("double"))
    rows = sized.where("n_tokens > 0").join(plan.select("source", "docs", "max_repeats", "rate"), "source")
    rows = rows.select("doc_id", "source", "n_tokens", F.floor(rate + 1e-9).cast("int").alias("whole"), F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), rate.alias("rate"))
    rows = rows.select("doc_id", "source", "n_tokens", "whole", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")).alias("prob"), "block")
    sure = rows.where("prob < 1e-9").select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
    open_ = rows.where("prob >= 1e-9")
    decided = None
    for level in range(3):
        if level:
            open_ = open_.withColumn("block", F.floor(F.col("block") / FAN).cast("long") if level == 1 else F.lit(0).cast("long"))
        done = checkpoint(_level(open_, level == 2, seed + level))
        settled = done.where("prob < 1e-9 or prob > 1 - 1e-9")
        one = settled.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("prob").cast("int")).alias("copies"))
        decided = one if decided is None else decided.unionByName(one)
        open_ = done.where("prob >= 1e-9 and prob <= 1 - 1e-9")
    return sure.unionByName(decided).where("copies > 0"), plan


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Actual against target shares: source, target_share, actual_share, tokens_in, tokens_out, max_repeats, most_copies."""
    out = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_out"), F.max("copies").alias("most_copies"), F.sum("copies").alias("docs_out"))
    joined = plan.join(out, "source", "left").withColumn("tokens_out", F.coalesce("tokens_out", F.lit(0).cast("long")))
    total = joined.agg(F.sum("tokens_out")).scalar()
    return joined.select(
        "source", "target_share", F.try_divide(F.col("tokens_out").cast("double"), total).alias("actual_share"), F.col("tokens").alias("tokens_in"), "tokens_out", F.coalesce("docs_out", F.lit(0)).alias("docs_out"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
