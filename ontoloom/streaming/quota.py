"""Quotas over event streams: daily counts and sliding windows in Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ontoloom.conf import EngineConf
from ontoloom.operators.limiter import admit
from ontoloom.runtime import _scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The events of a folder as a stream; times become instants, which watermarks need."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    one = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(EVENTS)
    raw = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else reader.parquet(f"{folder}/{name}.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, n_requests) by tumbling days of event time."""
    days = stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
    return days.select(F.to_date("w.start").alias("day"), "n_requests")


def sliding(stream: DataFrame, key: str, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """(key, until, n_requests) by windows of `seconds` that open every second."""
    w = F.window("ts", f"{seconds} seconds", "1 second")
    return stream.withWatermark("ts", lateness).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n_requests")).select(key, F.col("w.end").alias("until"), "n_requests")


def drain(result: DataFrame, mode: str = "complete", name: str | None = None) -> DataFrame:
    """Run a streaming query over what is there and return its result as a table.

    State and progress go to the session's shared folder, the result to a table in it, so lost executors lose nothing.
    name: the name of the query, under which it goes on where an earlier run, also one that was killed, has stopped; without
    one the query starts anew. A micro-batch replaces what an interrupted run has left of it, so none counts twice.
    """
    spark = result.sparkSession
    at = f"{_scratch(spark)}/stream-{name or uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result" if mode == "complete" else f"{at}/result/batch={number}")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{at}/result").select(*result.columns)


def admissions(stream: DataFrame, key: str, seq: str, conf: EngineConf) -> DataFrame:
    """(key, seq, arrival, admitted) in seconds as a stream: the schedule of one limiter per key, kept across micro-batches.

    The state of a key is its last window's admissions and its count of the day. Within a micro-batch a key's requests are taken in order of arrival;
    size micro-batches (maxFilesPerTrigger, maxOffsetsPerTrigger) so that those of a hot key fit a task.
    """
    rows = stream.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), (F.unix_micros("ts") / 1e6).alias("arrival"))

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["arrival", "seq"], ignore_index=True)
        last, today = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [-1, 0])
        out = pdf.assign(admitted=pd.array(admit(pdf["arrival"].tolist(), last, conf, today), dtype="Float64"))
        state.update((last, today))
        yield out[["key", "seq", "arrival", "admitted"]]

    return rows.groupBy("key").applyInPandasWithState(run, "key string, seq long, arrival double, admitted double", "last array<double>, today array<bigint>", "append", GroupStateTimeout.NoTimeout)
