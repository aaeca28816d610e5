from datetime import datetime, timedelta

from ontoloom.conf import EngineConf
from ontoloom.operators import limiter
from ontoloom.sources import readers
from ontoloom.streaming import quota

T0 = datetime(2024, 1, 1)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=7 * i), i % 3, "x", 0.5, None) for i in range(200)] + [(900, None, 1, "x", None, None)]
    at = tmp_path / "events.parquet"
    df = spark.createDataFrame(rows, quota.EVENTS)
    df.write.parquet(str(at))
    conf = EngineConf(requests_per_minute=3)
    stream = quota.event_stream(spark, str(tmp_path))
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(quota.drain(quota.daily(stream))) == key(limiter.daily_count(df, "ts"))
    assert key(quota.drain(quota.admissions(quota.event_stream(spark, str(tmp_path)), "user_id", "event_id", conf), "append")) == key(limiter.schedule(df, "user_id", "ts", "event_id", conf))
    assert quota.drain(quota.sliding(quota.event_stream(spark, str(tmp_path)), "user_id")).where("n_requests > 3").count() == 0


def test_a_named_stream_goes_on(spark, tmp_path):
    """A second run takes only what is new, and a batch that is written twice counts once."""
    at = str(tmp_path / "events.parquet")
    part = lambda a, b: spark.createDataFrame([(i, T0 + timedelta(hours=i), i % 2, "x", 0.5, None) for i in range(a, b)], quota.EVENTS).coalesce(1).write.mode("append").parquet(at)
    name = f"t-{tmp_path.name}-{id(tmp_path)}"
    run = lambda: quota.drain(quota.admissions(quota.event_stream(spark, str(tmp_path)), "user_id", "event_id", EngineConf()), "append", name)
    part(0, 30)
    assert run().count() == 30
    part(30, 50)
    out = run()
    assert out.count() == 50 == out.select("seq").distinct().count()
    assert run().count() == 50


def test_answers_are_recorded_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    for payload in ("a", "b"):
        readers.record_answers(spark.createDataFrame([("p", "k", payload), ("p", payload, payload)], "prefix string, key string, payload string"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("p", "a", "a"), ("p", "b", "b"), ("p", "k", "a")]
    readers.write_state({"entities": spark.range(3)}, str(tmp_path / "s"), "run_1")
    assert spark.read.json(str(tmp_path / "s/entities")).count() == 3
