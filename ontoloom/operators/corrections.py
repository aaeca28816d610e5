"""Correction actions on a T-Box, with the effect of applying them one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.operators.validation import validate
from ontoloom.runtime import checkpoint


class BackendError(RuntimeError):
    """A backend that could not answer."""


def apply_corrections(classes: DataFrame, properties: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and properties after the corrections (seq, action, target_uri, new_value).

    Actions: remove_class (with the properties whose domain or range it is at that moment, and the edges to it),
    remove_property, update_domain, update_range (neither with a null or empty value), remove_subclass (of new_value,
    else of the target, whatever its parent); unknown actions do nothing. A property's domain at a moment is the last update
    before it, so the sequence becomes intervals of values, and a removal of a class hits a property whose interval
    holds its seq: joins instead of a loop over the corrections.
    """
    named = corrections.select("seq", "action", F.col("target_uri").alias("t"), F.col("new_value").alias("v"))
    gone = named.where("action = 'remove_class'").select("seq", "t")
    states = {}
    for end in ("domain", "range"):
        later = named.where(F.col("action") == f"update_{end}").where("v is not null and v <> ''").select(F.col("t").alias("uri"), "seq", F.col("v").alias("value"))
        start = properties.select("uri", F.lit(-1).cast("long").alias("seq"), F.col(end).alias("value"))
        moments = start.unionByName(later.join(properties.select("uri"), "uri", "left_semi").select("uri", F.col("seq").cast("long").alias("seq"), "value"))
        # an interval ends with the next update of the same property
        states[end] = moments.withColumn("until", F.coalesce(F.lead("seq").over(Window.partitionBy("uri").orderBy("seq")), F.lit(2**62)))
    hit = None
    for s in states.values():
        one = s.join(gone.withColumnRenamed("seq", "at"), (F.col("value") == F.col("t")) & (F.col("at") > F.col("seq")) & (F.col("at") < F.col("until"))).select("uri")
        hit = one if hit is None else hit.unionByName(one)
    hit = hit.unionByName(named.where("action = 'remove_property'").select(F.col("t").alias("uri"))).distinct()
    kept = properties.join(hit, "uri", "left_anti")
    for end, s in states.items():
        now = s.where(F.col("until") == 2**62).select("uri", F.col("value").alias(f"_{end}"))
        kept = kept.join(now, "uri", "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    removed = gone.select(F.col("t").alias("uri")).distinct()
    freed = named.where("action = 'remove_subclass'").select(F.coalesce(F.nullif("v", F.lit("")), "t").alias("uri"), F.lit(True).alias("_free")).distinct()
    left = classes.join(removed, "uri", "left_anti").join(freed, "uri", "left")
    orphaned = removed.select(F.col("uri").alias("subclass_of"), F.lit(True).alias("_orphan"))
    left = left.join(orphaned, "subclass_of", "left")
    parent = F.when(F.col("_free").isNull() & F.col("_orphan").isNull(), F.col("subclass_of"))
    return left.withColumn("subclass_of", parent).select(*classes.columns), kept.select(*properties.columns)


def correction_rounds(classes: DataFrame, properties: DataFrame, correct: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """Validate and correct until consistent: at most `rounds` validations and one correction fewer.

    correct: from error findings to corrections; none, or a BackendError, ends the loop. Returns classes, properties and
    the number of validations.
    """
    for i in range(1, rounds + 1):
        errors = checkpoint(validate(classes, properties).where("severity = 'ERROR'"))
        if errors.isEmpty() or i == rounds:
            return classes, properties, i
        try:
            fixes = checkpoint(correct(errors))
        except BackendError:  # leaves the T-Box as it is
            return classes, properties, i
        if fixes.isEmpty():
            return classes, properties, i
        classes, properties = (checkpoint(x) for x in apply_corrections(classes, properties, fixes))
    return classes, properties, rounds
