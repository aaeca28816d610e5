"""Layered consistency checks of a T-Box; every check gives findings (layer, severity, code, subject, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.conf import SPECIAL_CLASSES, XSD_VALID
from ontoloom.functions.text import local_name
from ontoloom.operators.cycles import find_cycles
from ontoloom.operators.tbox import subclass_edges

#: Properties may share domain and range up to this number; so many of them are named in the message.
SHARED, NAMED = 3, 4


def _finding(rows: DataFrame, layer: int, severity: str, code: str, subject: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"), message.alias("message"))


def _text(pattern: str, *cols: str) -> Column:
    return F.format_string(pattern, *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def naming(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Class names begin with an upper-case letter and have no space or hyphen, property names begin otherwise; empty names are errors."""
    local = local_name(F.col("uri"))
    first = F.substring(local, 1, 1)
    upper = first.rlike(r"^\p{Lu}")
    return reduce(
        DataFrame.unionByName,
        [
            _finding(classes.where((local != "") & ~upper), 1, "WARNING", "class_case", F.col("uri"), _text("class %s: the name begins in lower case", "uri")),
            _finding(classes.where(local.rlike("[ -]")), 1, "ERROR", "class_name", F.col("uri"), _text("class %s: a space or hyphen stands in the name", "uri")),
            _finding(properties.where(upper), 1, "WARNING", "property_case", F.col("uri"), _text("property %s: the name begins in upper case", "uri")),
            _finding(classes.where(local == ""), 1, "ERROR", "empty_name", F.col("uri"), _text("class %s: nothing is left of the name without its prefix", "uri")),
            _finding(properties.where(local == ""), 1, "ERROR", "empty_name", F.col("uri"), _text("property %s: nothing is left of the name without its prefix", "uri")),
        ],
    )


def domain_range(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Domains and ranges that are neither a class nor special nor, for ranges, a datatype; null counts as unknown."""
    known = classes.select(F.col("uri").alias("_c"))
    bad_domain = properties.where(~F.coalesce(F.col("domain").isin(*SPECIAL_CLASSES), F.lit(False))).join(known, F.col("domain") == F.col("_c"), "left_anti")
    bad_range = properties.where(~F.coalesce(F.col("range").isin(*SPECIAL_CLASSES, *XSD_VALID), F.lit(False))).join(known, F.col("range") == F.col("_c"), "left_anti")
    return _finding(bad_domain, 1, "ERROR", "domain", F.col("uri"), _text("property %s: no class is called %s, its domain", "uri", "domain")).unionByName(
        _finding(bad_range, 1, "ERROR", "range", F.col("uri"), _text("property %s: neither a class nor a datatype is called %s, its range", "uri", "range"))
    )


def cycle_findings(classes: DataFrame) -> DataFrame:
    """One error per cycle of the subclass hierarchy."""
    found = find_cycles(classes.select(F.col("uri").alias("node"), F.col("subclass_of").alias("parent")))
    return _finding(found, 1, "ERROR", "cycle", F.col("cycle_uri"), F.concat(F.lit("parents lead back to the start: "), F.array_join("path", " -> ")))


def conflicts(properties: DataFrame) -> DataFrame:
    """Domain and range shared by more than SHARED properties, with the first NAMED of them by seq.

    Only the first few of a group leave a task (a limit per group before and after the shuffle), whatever share of the
    properties the group has; nulls count as empty.
    """
    pair = ["domain", "range"]
    grouped = properties.select(F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("range", F.lit("")).alias("range"), "seq", "uri")
    counts = grouped.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARED)
    place = F.row_number().over(Window.partitionBy(*pair).orderBy("seq", "uri"))
    first = grouped.withColumn("place", place).where(F.col("place") <= NAMED).groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("place", "uri"))).alias("named"))
    names = F.array_join(F.transform("named", lambda x: x["uri"]), ", ")
    message = F.format_string("%d properties lead from %s to %s, among them %s", F.col("n"), F.col("domain"), F.col("range"), names)
    return _finding(counts.join(first, pair), 1, "WARNING", "conflict", F.concat_ws(" -> ", *pair), message)


def iri_syntax(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Names that no Turtle reader takes."""
    names = classes.select("uri").unionByName(properties.select("uri")).distinct()
    bad = names.where(~local_name(F.col("uri")).rlike(r"^[\p{L}_][\p{L}\p{N}_.\-]*$"))
    return _finding(bad, 2, "ERROR", "iri", F.col("uri"), _text("%s: not a name that Turtle can hold", "uri"))


def inversions(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Object properties whose domain is a direct subclass of their range."""
    edges = subclass_edges(classes)
    found = properties.where(~F.col("range").startswith("xsd:")).join(edges, (F.col("domain") == F.col("child")) & (F.col("range") == F.col("parent")), "left_semi")
    return _finding(found, 2, "WARNING", "inversion", F.col("uri"), _text("property %s: leads from a class to the parent of that class", "uri"))


def dangling(classes: DataFrame) -> DataFrame:
    """Subclass edges to a parent without a definition."""
    known = classes.select(F.col("uri").alias("_c"))
    bad = classes.where(F.col("subclass_of").isNotNull()).join(known, F.col("subclass_of") == F.col("_c"), "left_anti")
    return _finding(bad, 1, "WARNING", "dangling", F.col("uri"), _text("class %s: its parent %s has no definition", "uri", "subclass_of"))


def genus(classes: DataFrame) -> DataFrame:
    """Definitions whose genus (the word after `is a`) isn't the category of the class."""
    named = F.regexp_extract("aristotelian_definition", r"^(?i:an?) \S+ (?i:is an?) (\w+)", 1)
    bad = classes.where(F.col("bfo_parent").isNotNull() & (named != "") & (F.lower(named) != F.lower(F.regexp_replace("bfo_parent", "^bfo:", ""))))
    return _finding(bad, 1, "WARNING", "genus", F.col("uri"), F.format_string("class %s: defined as %s, filed under %s", F.col("uri"), named, F.col("bfo_parent")))


def inferred_types(entities: DataFrame, relations: DataFrame, properties: DataFrame) -> DataFrame:
    """RDFS types: stated ones and those that a property's domain and range give its ends. (id, class_uri), distinct."""
    ends = relations.join(properties.select(F.col("uri").alias("property_uri"), "domain", "range"), "property_uri")
    stated = entities.where("id is not null and class_uri is not null").select("id", "class_uri")
    subjects = ends.where("source_id is not null and domain is not null").select(F.col("source_id").alias("id"), F.col("domain").alias("class_uri"))
    objects = ends.where("target_id is not null and not startswith(range, 'xsd:')").select(F.col("target_id").alias("id"), F.col("range").alias("class_uri"))
    return stated.unionByName(subjects).unionByName(objects).distinct()


def validate(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """All findings. A T-Box is consistent if none is an ERROR."""
    layers = [naming(classes, properties), domain_range(classes, properties), cycle_findings(classes), conflicts(properties), dangling(classes), iri_syntax(classes, properties), inversions(classes, properties)]
    return reduce(DataFrame.unionByName, layers)


def is_consistent(findings: DataFrame) -> bool:
    return findings.where("severity = 'ERROR'").isEmpty()
