"""What changed between full snapshots: content-defined chunks of key-sorted snapshots, joined only where digests differ."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint

#: A key starts a new chunk if its hash is divisible by this: the average number of keys in a chunk.
CHUNK_KEYS = 32


def snapshot_rows(df: DataFrame, section: str, key: list[str], ignore: tuple[str, ...] = ("delivered_at",)) -> DataFrame:
    """Rows of one snapshot table in common form: section, run, run_no, item_key, payload (all other columns as text).

    The key columns are joined by `|`; a null key column counts as an empty one. Rows whose `run` has no
    number, or is null, belong to no snapshot and are left out. Extra columns of any name are part of the payload.
    """
    rest = sorted(c for c in df.columns if c not in {*key, *ignore, "run"})
    return df.select(
        F.lit(section).alias("section"), "run", F.regexp_extract("run", r"(\d+)$", 1).try_cast("long").alias("run_no"),
        F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key]).alias("item_key"),
        F.array(*[F.col(f"`{c}`").cast("string") for c in rest]).cast("array<string>").alias("payload"),
    ).where(F.col("run_no").isNotNull())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the content-defined chunks of a key-sorted partition: column chunk counts the boundaries passed."""
    passed, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        name = pc.binary_join_element_wise(b["section"], b["item_key"], "\x00")
        before = pa.concat_arrays([pa.array([last], name.type), name.slice(0, len(name) - 1)])
        starts = pc.and_(b["boundary"], pc.fill_null(pc.not_equal(name, before), True))
        chunk = pc.add(pc.cumulative_sum(pc.cast(starts, pa.int64())), passed)
        passed, last = chunk[-1].as_py(), name[-1].as_py()
        cols = [c for c in b.schema.names if c != "boundary"]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in cols], chunk], [*cols, "chunk"])


def snapshot_changes(rows: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """Records added, removed or changed in each snapshot since the nearest lower one delivered, by section.

    rows: as of `snapshot_rows`. All snapshots are sorted by key within shared key ranges and cut into
    chunks at keys chosen by their hash, so that an insertion moves no other boundary. A chunk whose digest
    (number, xor and sum of row hashes) equals that of the preceding snapshot is discarded; rows of the others
    are compared in full. Repeated rows within a snapshot count once; a key with several different rows
    counts as changed if the set of its rows changed. The first snapshot of a section has no changes.

    Returns section, run, item_key, change, before, after (arrays of the distinct payloads).
    """
    spark = rows.sparkSession
    schema = "section string, run_no bigint, item_key string, payload array<string>, h bigint, chunk bigint, part int"
    distinct = rows.groupBy("section", "run_no", "item_key", "payload").agg(F.min("run").alias("run"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        distinct.withColumn("h", F.xxhash64("item_key", "payload"))
        .withColumn("boundary", F.pmod(F.xxhash64(F.lit(7), F.col("item_key")), F.lit(chunk_keys)) == 0)
        .repartitionByRange(n, "section", "item_key")
        .sortWithinPartitions("section", "item_key", "run_no")
        .select("section", "run_no", "item_key", "payload", "h", F.spark_partition_id().alias("part"), "boundary")
    )
    chunked = checkpoint(ranged.mapInArrow(lambda it: _chunks(it), schema.replace(", chunk bigint, part int", ", part int, chunk bigint")))

    w = Window.partitionBy("section").orderBy("run_no")
    runs = rows.groupBy("section", "run_no").agg(F.min("run").alias("run")).withColumn("prev_no", F.lag("run_no").over(w))
    runs = runs.withColumn("next_no", F.lead("run_no").over(w))
    digest = chunked.groupBy("section", "part", "chunk", "run_no").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")
    )
    # each digest is held against the next snapshot's: one row as what is, one as what was
    digest = digest.join(runs.select("section", "run_no", "prev_no", "next_no"), ["section", "run_no"])
    sides = digest.where(F.col("prev_no").isNotNull()).select("section", "part", "chunk", "run_no", F.lit(1).alias("side"), "n", "x", "s").unionByName(
        digest.where(F.col("next_no").isNotNull()).select("section", "part", "chunk", F.col("next_no").alias("run_no"), F.lit(0).alias("side"), "n", "x", "s")
    )
    differ = (
        sides.groupBy("section", "part", "chunk", "run_no")
        .agg(F.count(F.lit(1)).alias("both"), F.min(F.struct("n", "x", "s")).alias("lo"), F.max(F.struct("n", "x", "s")).alias("hi"))
        .where((F.col("both") < 2) | (F.col("lo") != F.col("hi")))
        .select("section", "part", "chunk", "run_no")
    )
    differ = differ.join(runs.select("section", "run_no", "prev_no", "run"), ["section", "run_no"])
    at = ["section", "part", "chunk"]
    now = chunked.join(differ.select(*at, "run_no", "run"), [*at, "run_no"]).select("section", "run", "item_key", F.lit(1).alias("side"), "payload")
    was = chunked.join(differ.select(*at, F.col("prev_no").alias("run_no"), "run"), [*at, "run_no"]).select("section", "run", "item_key", F.lit(0).alias("side"), "payload")
    pick = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("payload"))))
    return (
        was.unionByName(now)
        .groupBy("section", "run", "item_key")
        .agg(pick(0).alias("before"), pick(1).alias("after"))
        .where(~F.col("before").eqNullSafe(F.col("after")))
        .select(
            "section", "run", "item_key",
            F.when(F.size("before") == 0, "added").when(F.size("after") == 0, "removed").otherwise("changed").alias("change"), "before", "after",
        )
    )
