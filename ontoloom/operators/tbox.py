"""T-Box: first definitions win, properties only with known ends, category repair and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.conf import SPECIAL_CLASSES, XSD_INGEST
from ontoloom.functions.text import repair_key


def first_wins(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per non-null key, that with the smallest `order`. Combines on the map side, so a hot key needs no sort."""
    best = F.min(F.struct(*order, F.struct(*keep).alias("kept"))).alias("b")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"b.kept.{k}").alias(k) for k in keep])


def approved_classes(rows: DataFrame) -> DataFrame:
    """The first definition of every class: uri, bfo_parent, subclass_of, aristotelian_definition, comment, first_batch, seq."""
    named = rows.select("uri", "bfo_parent", "subclass_of", "aristotelian_definition", "comment", F.col("batch_ix").alias("first_batch"), "pos", F.col("class_row_id").alias("seq"))
    return first_wins(named, "uri", ["first_batch", "pos", "seq"], ["bfo_parent", "subclass_of", "aristotelian_definition", "comment", "first_batch", "seq"])


def approved_terms(rows: DataFrame) -> DataFrame:
    """The first uri of every canonical term, null uris included: term, uri."""
    return first_wins(rows.select("term", "uri", "batch_ix", "term_id"), "term", ["batch_ix", "term_id"], ["uri"])


def approved_properties(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The first acceptable occurrence of every property: uri, domain, range, comment, first_batch, seq.

    Domain and range must be a class known in the same batch or before, or a special class; the range may be a datatype.
    Validity comes before the choice, so a later valid occurrence stands in for an earlier invalid one.
    """
    known = classes.select(F.col("uri").alias("_c"), F.col("first_batch").alias("_b"))
    ok = rows
    for end, extra in (("domain", ()), ("range", XSD_INGEST)):
        ok = ok.join(known, F.col(end) == F.col("_c"), "left").where(F.col(end).isin(*SPECIAL_CLASSES, *extra) | (F.col("_b") <= F.col("batch_ix"))).drop("_c", "_b")
    named = ok.select("uri", "domain", "range", "comment", F.col("batch_ix").alias("first_batch"), "pos", F.col("prop_row_id").alias("seq"))
    return first_wins(named, "uri", ["first_batch", "pos", "seq"], ["domain", "range", "comment", "first_batch", "seq"])


def with_seeds(classes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Classes and the seeds (uri, comment) that they lack: filed under the root, with a definition made of the name, before all batches.

    Seeds are taken as they are, the first comment of a uri by order of text; null uris are no seeds.
    """
    new = seeds.where("uri is not null").groupBy("uri").agg(F.min("comment").alias("comment")).join(classes.select("uri"), "uri", "left_anti")
    named = F.format_string("A %s is an Entity.", F.regexp_replace("uri", "^.*:", ""))
    made = {"uri": F.col("uri"), "bfo_parent": F.lit("bfo:Entity"), "aristotelian_definition": named, "comment": F.coalesce("comment", F.lit("")), "first_batch": F.lit(-1), "seq": F.lit(-1)}
    kinds = dict(classes.dtypes)
    return classes.unionByName(new.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in classes.columns]))


def remove_subclass(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes without the parents named in edges (child, parent); a class whose parent is another one keeps it."""
    gone = edges.where("child is not null and parent is not null").select(F.col("child").alias("uri"), F.col("parent").alias("subclass_of"), F.lit(True).alias("_gone")).distinct()
    return classes.join(gone, ["uri", "subclass_of"], "left").withColumn("subclass_of", F.when(F.col("_gone").isNull(), F.col("subclass_of"))).select(*classes.columns)


def subclass_edges(classes: DataFrame) -> DataFrame:
    """(child, parent) of the classes that have a parent."""
    return classes.where(F.col("subclass_of").isNotNull()).select(F.col("uri").alias("child"), F.col("subclass_of").alias("parent"))


def repair_categories(rows: DataFrame, column: str, categories: DataFrame, target: str = "repaired") -> DataFrame:
    """Rows with the category meant by `column`: itself if it is one, the leaf of the same letters, else the root `bfo:Entity`."""
    every = categories.select(F.col("cat").alias("_cat"))
    leaf = categories.where("is_leaf").select(repair_key(F.col("cat")).alias("_key"), F.col("cat").alias("_leaf"))
    found = rows.join(every, F.col(column) == F.col("_cat"), "left").join(leaf, repair_key(F.col(column)) == F.col("_key"), "left")
    return found.withColumn(target, F.coalesce("_cat", "_leaf", F.lit("bfo:Entity"))).drop("_cat", "_key", "_leaf")


def lineage(categories: DataFrame) -> DataFrame:
    """(cat, lineage, depth) from the root to every category, by a recursive query over the category tree."""
    spark = categories.sparkSession
    return spark.sql(
        """WITH RECURSIVE up(cat, lineage, depth) AS (
          SELECT cat, cat, 0 FROM {c} WHERE parent IS NULL
          UNION ALL SELECT c.cat, concat(u.lineage, ' > ', c.cat), u.depth + 1 FROM {c} c JOIN up u ON c.parent = u.cat)
        SELECT * FROM up""",
        c=categories.select("cat", "parent"),
    )


def is_category(column: Column, categories: list[str]) -> Column:
    """Whether a value is one of the categories, inner ones included."""
    return column.isin(*categories)
