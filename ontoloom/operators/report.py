"""Run-to-run stability: set similarities between consecutive runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STABLE = 0.7


def run_number(run):
    """The number in a run's name; 0 if it has none."""
    return F.coalesce(F.split_part(run, F.lit("_"), F.lit(2)).try_cast("int"), F.lit(0))


def consecutive_runs(runs: DataFrame) -> DataFrame:
    """(prev_run, run) of runs in numeric order; nothing for fewer than two. Runs are few: one row each goes through the window."""
    w = Window.orderBy("no", "run")
    one = runs.select("run").where(F.col("run").isNotNull()).distinct().withColumn("no", run_number(F.col("run")))
    return one.select(F.lag("run").over(w).alias("prev_run"), "run").where(F.col("prev_run").isNotNull())


def set_similarity(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prev_run, run, similarity): Jaccard of the members (run, member) of both runs; 1 if both are empty."""
    distinct = members.select("run", "member").distinct()
    sizes = distinct.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # each member meets itself in the other run: one group per pair and member, never all pairs
    sides = distinct.join(pairs.select("prev_run", "run"), "run").select("prev_run", "run", "member").unionByName(
        distinct.withColumnRenamed("run", "prev_run").join(pairs.select("prev_run", "run"), "prev_run").select("prev_run", "run", "member")
    )
    shared = sides.groupBy("prev_run", "run", "member").agg(F.count(F.lit(1)).alias("c")).groupBy("prev_run", "run").agg(F.count(F.when(F.col("c") == 2, 1)).alias("both"))
    out = pairs.join(shared, ["prev_run", "run"], "left")
    for side in ("prev_run", "run"):
        out = out.join(sizes.select(F.col("run").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
    both, a, b = F.coalesce("both", F.lit(0)), F.coalesce("n_prev_run", F.lit(0)), F.coalesce("n_run", F.lit(0))
    return out.select("prev_run", "run", F.coalesce(F.try_divide(both.cast("double"), (a + b - both).cast("double")), F.lit(1.0)).alias("similarity"))


def stability(classes: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """Similarities of classes, properties and triples of consecutive runs and the verdict, which leaves the properties out.

    Each table has a column run; the key columns are uri or source, property and target. Evidence doesn't count.
    """
    runs = classes.select("run").unionByName(properties.select("run")).unionByName(relations.select("run"))
    pairs = consecutive_runs(runs)
    out = pairs
    sets = {
        "classes": classes.select("run", F.col("uri").alias("member")),
        "properties": properties.select("run", F.col("uri").alias("member")),
        "triples": relations.select("run", F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x00")) for c in ("source_id", "property_uri", "target_id")]).alias("member")),
    }
    for name, members in sets.items():
        out = out.join(set_similarity(members, pairs).withColumnRenamed("similarity", f"{name}_similarity"), ["prev_run", "run"])
    stable = (F.col("triples_similarity") >= STABLE) & (F.col("classes_similarity") >= STABLE)
    return out.withColumn("verdict", F.when(stable, "STABLE").otherwise("DIVERGENT"))


def graph_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, class_uri, out_degree, in_degree) of entities and relation ends; the class is null for mere ends."""
    typed = entities.where("id is not null").groupBy("id").agg(F.min("class_uri").alias("class_uri"), F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("n"))
    out = relations.where("source_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.lit(None).cast("string").alias("class_uri"), F.count(F.lit(1)).alias("o"), F.lit(0).cast("long").alias("n"))
    in_ = relations.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.lit(None).cast("string").alias("class_uri"), F.lit(0).cast("long").alias("o"), F.count(F.lit(1)).alias("n"))
    every = typed.unionByName(out).unionByName(in_)
    return every.groupBy("id").agg(F.max("class_uri").alias("class_uri"), F.sum("o").alias("out_degree"), F.sum("n").alias("in_degree"))


def graph_edges(relations: DataFrame, seq: str) -> DataFrame:
    """(source_id, target_id, label): one edge per pair of nodes, labelled by its last relation with what follows the last colon."""
    last = relations.where("source_id is not null and target_id is not null").groupBy("source_id", "target_id").agg(F.max(F.struct(seq, "property_uri")).alias("e"))
    return last.select("source_id", "target_id", F.element_at(F.split("e.property_uri", ":"), -1).alias("label"))
