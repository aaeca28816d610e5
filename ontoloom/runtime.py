"""Session helpers shared by all operators: table access, lineage cuts, hot-key-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of the rows; so there are at most HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """The folder for tables that cut lineages: spark.checkpoint.dir, which all executors share.

    Where it is unset, a temporary folder of this machine will do in local mode; on a cluster, whose executors would each
    write to a disk of their own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ontoloom-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get()
    return f"{named.rstrip('/')}/ontoloom"


def checkpoint(df: DataFrame, replaces: DataFrame | None = None, release: bool = False) -> DataFrame:
    """Cut the lineage of `df` by writing it as a table into the shared folder of spark.checkpoint.dir.

    A table, unlike a checkpointed RDD, carries no constraints of the plan it came from (which multiply from round to
    round of an iteration) and is read in as few partitions as its size needs. replaces: an earlier result of this
    function that nothing will read again; its files are deleted. release: spare the disk: delete the shuffle files of `df` as soon as it is
    written, instead of when the driver happens to collect its garbage, and compress the table more.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.option("compression", "zstd") if release else df.write).parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ontoloom_path = path
    if replaces is not None:
        drop(replaces)
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a result of `checkpoint` that nothing will read again."""
    path = getattr(df, "_ontoloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def spread(df: DataFrame, key: str, like: DataFrame | None = None) -> DataFrame:
    """`df` over as many partitions as there are cores, if its files give fewer (a single row group, say).

    For the inputs of costly per-row work. Large inputs have more partitions than that and stay as they are, as do
    plans with a shuffle of their own. like: the scan to count partitions of, where df is more than a scan.
    """
    plan = (df if like is None else like)._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of `key` that hold at least 1/HOT_SHARE of the rows of `df` (and 1000 rows): at most HOT_SHARE rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where((F.col("_n") * HOT_SHARE >= total) & (F.col("_n") >= 1000)).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join rows of `left` with the one row that `right` has for `key`, whatever share of `left` one key holds.

    `right` must be unique in `key`. Rows of hot keys meet a broadcast of at most HOT_SHARE rows of
    `right`; the others are shuffled. A hot row keeps its place: it goes through the shuffle under a
    salted null key, so no task gets more than its part. how: "left" or "inner". hot: the hot keys, where they are
    known already (as rows of `key`, no more than HOT_SHARE); otherwise they are counted.
    Null keys find nothing.
    """
    cols = [c for c in right.columns if c != key]
    frequent = right.join(F.broadcast(hot_keys(left, key) if hot is None else hot), key, "left_semi")
    h = frequent.select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hot") if cols else F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(h), F.col(key).eqNullSafe(F.col("_hk")) & F.col(key).isNotNull(), "left")
    settled = F.col("_hk").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_jk", F.when(~settled, F.col(key))).withColumn(
        "_salt", F.when(settled, F.monotonically_increasing_id() % 65536).otherwise(F.lit(-1).cast("long"))
    )
    c = right.select(F.col(key).alias("_ck"), F.lit(-1).cast("long").alias("_cs"), F.struct(*cols).alias("_cold") if cols else F.lit(True).alias("_cold"))
    both = marked.join(c, (F.col("_jk").eqNullSafe(F.col("_ck"))) & (F.col("_salt") == F.col("_cs")), "left")
    found: Column = F.coalesce(F.col("_hot"), F.col("_cold"))
    out = both.withColumn("_found", found)
    if how == "inner":
        out = out.where(F.col("_found").isNotNull())
    return out.select(*left.columns, *[F.col(f"_found.{x}").alias(x) for x in cols])
