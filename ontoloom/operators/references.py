"""References to records that do not exist: range-partitioned keys, sorted parent arrays, vectorised binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint

_NEVER, _ALWAYS = -(2**63), 2**63 - 1
_OUT = "part int, tag int, h bigint, key string, t bigint, row_key bigint, ref_table string, ref_field string"


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def parents(df: DataFrame, space: str, key: str, since: str, until: str) -> DataFrame:
    """Lifetimes [since, until) of the records of one key space; until null means still there.

    Null keys and null `since` (never there) are left out, as are empty lifetimes. Equal keys and starts are
    aggregated to the longest before anything is shuffled.
    """
    t = df.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.lit(space).alias("space"), F.col(key).alias("key"), _micros(since).alias("t"), F.coalesce(_micros(until), F.lit(_ALWAYS)).alias("end")
    )
    return t.where(F.col("end") > F.col("t")).groupBy("space", "key", "t").agg(F.max("end").alias("end"))


def references(df: DataFrame, ref_table: str, row_key: str, field: str, space: str, at: str) -> DataFrame:
    """Non-null references of one column; a null time comes before all parents. Empty strings are references."""
    return df.where(F.col(field).isNotNull()).select(
        F.lit(space).alias("space"), F.col(field).alias("key"), F.coalesce(_micros(at), F.lit(_NEVER)).alias("t"), F.col(row_key).cast("long").alias("row_key"), F.lit(ref_table).alias("ref_table"), F.lit(field).alias("ref_field")
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probe the references of a sorted range against the parents of that range.

    Rows come sorted by (h, key, t, kind). Per batch the parents' starts form a sorted array, with the latest
    end among a key's earlier parents beside each; a binary search finds for each reference its last parent that
    started in time. Emits misses (tag 0), misses that an earlier range could still resolve, because
    their key began there (tag 1), and, at the end, the last key's latest end (tag 2) with t = that end.
    """
    part, first, last, carry, any_rows = 0, None, None, _NEVER, False
    names = [x.split()[0] for x in _OUT.split(", ")]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        part = b["part"][0].as_py()
        h = b["h"].to_numpy(zero_copy_only=False)
        keys = b["key"]
        h0 = h[0] if last is None else last[0]
        same = np.empty(n, bool)
        same[1:] = (h[1:] == h[:-1]) & pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = last is not None and h[0] == h0 and keys[0].as_py() == last[1]
        if not any_rows:
            first, any_rows = (h[0], keys[0].as_py()), True
        group = np.cumsum(~same)  # 0: still the key of the batch before
        t, end = b["t"].to_numpy(zero_copy_only=False), b["end"].to_numpy(zero_copy_only=False)
        parent = b["kind"].to_numpy(zero_copy_only=False) == 0
        at = np.flatnonzero(parent)
        # latest end so far within the key: a running maximum that starts anew with each key
        best = np.full(n, _NEVER)
        if len(at):
            pg, pe = group[at], end[at]
            order = np.argsort(pe, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at))
            run = np.maximum.accumulate(pg * len(at) + rank)
            peak = np.where(run // len(at) == pg, pe[order[run % len(at)]], pe)
            hit = np.searchsorted(at, np.arange(n), side="right") - 1
            ok = (hit >= 0) & (pg[np.maximum(hit, 0)] == group)
            best[ok] = peak[np.maximum(hit, 0)][ok]
        if last is not None:
            best[group == 0] = np.maximum(best[group == 0], carry)
        ref = ~parent
        miss = np.flatnonzero(ref & ~(best > t))
        if len(miss):
            k = pa.array(miss)
            hk, kk = h[miss], keys.take(k)
            tag = (hk == first[0]) & pc.equal(kk, first[1]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(miss), part, np.int32)), pa.array(tag.astype(np.int32)), pa.array(hk), kk, b["t"].take(k), b["row_key"].take(k), b["ref_table"].take(k), b["ref_field"].take(k)], names
            )
        tail = group == group[-1]
        carry = int(max(best[tail].max(), end[tail & parent].max() if (tail & parent).any() else _NEVER))
        last = (h[-1], keys[-1].as_py())
    if any_rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([2], pa.int32()), pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.string()), pa.array([carry], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string())], names
        )


def orphans(refs: DataFrame, alive: DataFrame, partitions: int | None = None) -> DataFrame:
    """References without a parent that started at or before their time and ended after it, compared exactly.

    refs, alive: unions of `references` and `parents`. Both are range-partitioned together on (key hash, key,
    time), so the references and the parents of a hot key are spread over as many ranges as they need; what
    a range doesn't know about its first key is the latest end that the ranges before it saw, one row per range.
    Returns ref_table, row_key, ref_field, t (microseconds; null for a null time). Empty tables give no rows or,
    without parents, all references.
    """
    spark = refs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64("space", "key")
    none = F.lit(None)
    both = alive.select(hashed.alias("h"), F.concat_ws("\x00", "space", "key").alias("key"), "t", F.lit(0).alias("kind"), "end", none.cast("long").alias("row_key"), none.cast("string").alias("ref_table"), none.cast("string").alias("ref_field")).unionByName(
        refs.select(hashed.alias("h"), F.concat_ws("\x00", "space", "key").alias("key"), "t", F.lit(1).alias("kind"), F.lit(_NEVER).alias("end"), "row_key", "ref_table", "ref_field")
    )
    by = ["h", "key", "t", "kind", "row_key"]
    sorted_ = both.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    found = checkpoint(sorted_.mapInArrow(lambda it: _probe(it), _OUT))
    # one row per range: how far the key that ends each range lived; only equal keys in later ranges ask for it
    tails = found.where("tag = 2").select(F.col("part").alias("_p"), F.col("h").alias("_h"), F.col("key").alias("_k"), F.col("t").alias("_end"))
    asked = found.where("tag = 1")
    saved = (
        asked.join(F.broadcast(tails), (F.col("h") == F.col("_h")) & (F.col("key") == F.col("_k")) & (F.col("_p") < F.col("part")) & (F.col("_end") > F.col("t")), "left_anti")
    )
    return found.where("tag = 0").unionByName(saved).select("ref_table", "row_key", "ref_field", F.when(F.col("t") != _NEVER, F.col("t")).alias("t"))
