"""Request quotas: sliding windows, daily counts and the schedule that a limiter would give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.conf import EngineConf


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


#: Time slices of this many seconds bound what one task of a sliding count gets of a hot key.
SLICE_S = 3600


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Events with n_window: events of the same key in the last `seconds`, those exactly as old and of the same moment included.

    A key is cut into time slices; the last `seconds` of a slice are also shown to the next one, so every
    count is whole and no key, however hot, goes to one task. Events without a time count only each other.
    """
    width = max(SLICE_S, seconds) * 1_000_000
    timed = events.withColumn("_t", micros(F.col(ts))).withColumn("_slice", F.floor(F.col("_t") / width).cast("long"))
    late = timed.where(F.col("_t") >= (F.col("_slice") + 1) * width - seconds * 1_000_000).withColumn("_slice", F.col("_slice") + 1)
    both = timed.withColumn("_own", F.lit(True)).unionByName(late.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumn("n_window", F.count(F.lit(1)).over(w)).where("_own").drop("_t", "_slice", "_own")


def daily_count(events: DataFrame, ts: str) -> DataFrame:
    """(day, n_requests) per calendar day; events without a time count for no day."""
    return events.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_requests"))


def over_quota(events: DataFrame, key: str, ts: str, conf: EngineConf) -> DataFrame:
    """(key, day, n_requests, n_denied): what a daily quota per key would turn away."""
    per = events.where(F.col(ts).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_requests"))
    return per.select(key, "day", "n_requests", F.greatest(F.col("n_requests") - conf.requests_per_day, F.lit(0).cast("long")).alias("n_denied"))


DAY_S = 86_400


def admit(arrivals: list[float], last: list[float], conf: EngineConf, today: list[int] | None = None) -> list[float | None]:
    """When each of the arrivals (seconds, ascending) is let through; `last` holds earlier admissions and is updated.

    A full window opens one safety second after its oldest admission has left it; two admissions are at least the gap apart.
    today: day (UTC) and number of its admissions so far, updated too; a request beyond the day's quota gets None and
    counts for nothing. A new day starts at 0.
    """
    out: list[float | None] = []
    today = today if today is not None else [-1, 0]
    for t in arrivals:
        if today[0] != t // DAY_S:
            today[:] = [int(t // DAY_S), 0]
        if today[1] >= conf.requests_per_day:
            out.append(None)
            continue
        today[1] += 1
        at = t
        if len(last) >= conf.requests_per_minute and at - last[-conf.requests_per_minute] <= conf.window_s:
            at = last[-conf.requests_per_minute] + conf.window_s + conf.safety_s
        if last:
            at = max(at, last[-1] + conf.min_gap_s)
        out.append(at)
        last.append(at)
        del last[: -conf.requests_per_minute]
    return out


def schedule(events: DataFrame, key: str, ts: str, seq: str, conf: EngineConf) -> DataFrame:
    """(key, seq, arrival, admitted) in seconds: the schedule of one limiter per key; beyond the day's quota admitted is null.

    The recurrence depends on every earlier admission of the key, so a key is folded in order; the rows arrive sorted and in
    batches, and only the last window's admissions are kept, so a hot key needs no more memory than another.
    """
    rows = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), (micros(F.col(ts)) / 1e6).alias("arrival"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, today = None, [], [-1, 0]
        for pdf in batches:
            admitted: list[float | None] = []
            for k, part in pdf.groupby("key", sort=False):
                if k != current:
                    current, last, today = k, [], [-1, 0]
                admitted += admit(part["arrival"].tolist(), last, conf, today)
            yield pdf.assign(admitted=pd.array(admitted, dtype="Float64"))

    ordered = rows.repartition("key").sortWithinPartitions("key", "arrival", "seq")
    return ordered.mapInPandas(run, "key string, seq long, arrival double, admitted double")


def status(events: DataFrame, key: str, ts: str, now: Column, conf: EngineConf) -> DataFrame:
    """(key, in_window, today, can_proceed) at the moment `now`: requests of the last window and of that day, and whether one more fits both quotas."""
    age = micros(now) - micros(F.col(ts))
    past = events.where((age >= 0) & (F.to_date(ts) >= F.date_sub(F.to_date(now), 1)))
    in_window = F.count(F.when(age <= conf.window_s * 1_000_000, 1))
    today = F.count(F.when(F.to_date(ts) == F.to_date(now), 1))
    counted = past.groupBy(key).agg(in_window.alias("in_window"), today.alias("today"))
    return counted.withColumn("can_proceed", (F.col("in_window") < conf.requests_per_minute) & (F.col("today") < conf.requests_per_day))
