"""Turtle export as ordered lines, and a reader of such exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.conf import TURTLE_PREFIXES
from ontoloom.functions.text import ensure_prefix, escape_literal, safe_id


def _lines(rows: DataFrame, section: int, seq: str, *lines: Column) -> DataFrame:
    kept = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return rows.select(F.lit(section).alias("section"), F.col(seq).cast("long").alias("seq"), F.posexplode(kept).alias("part", "line"))


def class_lines(classes: DataFrame) -> DataFrame:
    """Lines of the classes: type, category, parent and definition where not empty, comment."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return _lines(
        classes, 1, "seq",
        F.concat(ensure_prefix(F.col("uri")), F.lit(" rdf:type owl:Class ;")),
        F.concat(F.lit("    rdfs:subClassOf "), some(F.col("bfo_parent")), F.lit(" ;")),
        F.concat(F.lit("    rdfs:subClassOf "), ensure_prefix(some(F.col("subclass_of"))), F.lit(" ;")),
        F.concat(F.lit('    skos:definition "'), escape_literal(some(F.col("aristotelian_definition"))), F.lit('" ;')),
        F.concat(F.lit('    rdfs:comment "'), escape_literal(F.coalesce("comment", F.lit(""))), F.lit('" .')),
    )


def property_lines(properties: DataFrame) -> DataFrame:
    """Lines of the properties; one with a datatype range is a datatype property."""
    kind = F.when(F.coalesce(F.col("range").startswith("xsd:"), F.lit(False)), "owl:DatatypeProperty").otherwise("owl:ObjectProperty")
    return _lines(
        properties, 2, "seq",
        F.concat(ensure_prefix(F.col("uri")), F.lit(" rdf:type "), kind, F.lit(" ;")),
        F.concat(F.lit("    rdfs:domain "), ensure_prefix(F.col("domain")), F.lit(" ;")),
        F.concat(F.lit("    rdfs:range "), ensure_prefix(F.col("range")), F.lit(" ;")),
        F.concat(F.lit('    rdfs:comment "'), escape_literal(F.coalesce("comment", F.lit(""))), F.lit('" .')),
    )


def instance_lines(entities: DataFrame, seq: str) -> DataFrame:
    """Lines of the instances: type where there is one, label."""
    return _lines(
        entities.where("id is not null"), 3, seq,
        F.concat(F.lit("ex:"), safe_id(F.col("id")), F.lit(" rdf:type "), ensure_prefix(F.coalesce("class_uri", F.lit("owl:Thing"))), F.lit(" ;")),
        F.concat(F.lit('    rdfs:label "'), escape_literal(F.col("id")), F.lit('" .')),
    )


def relation_lines(relations: DataFrame, seq: str, literals: DataFrame | None = None) -> DataFrame:
    """One line per complete relation. literals: property uris whose targets are written as literals instead of names."""
    whole = relations.where("source_id is not null and property_uri is not null and target_id is not null")
    target: Column = F.concat(F.lit("ex:"), safe_id(F.col("target_id")))
    if literals is not None:
        whole = whole.join(literals.select(F.col("uri").alias("property_uri"), F.lit(True).alias("_lit")).distinct(), "property_uri", "left")
        target = F.when(F.col("_lit"), F.concat(F.lit('"'), escape_literal(F.col("target_id")), F.lit('"'))).otherwise(target)
    return _lines(whole, 4, seq, F.concat(F.lit("ex:"), safe_id(F.col("source_id")), F.lit(" "), ensure_prefix(F.col("property_uri")), F.lit(" "), target, F.lit(" .")))


def export(*sections: DataFrame) -> DataFrame:
    """(section, seq, part, line) of a whole export, prefixes included; sort by the first three and write the lines."""
    spark = sections[0].sparkSession
    head = spark.createDataFrame([(0, i, 0, f"@prefix {p}: <{u}> .") for i, (p, u) in enumerate(TURTLE_PREFIXES.items())], "section int, seq long, part int, line string")
    return reduce(DataFrame.unionByName, sections, head)


def write_turtle(lines: DataFrame, path: str) -> None:
    """Write an export as text files whose names and lines keep the order; no single task gets all of it."""
    lines.repartitionByRange("section", "seq", "part").sortWithinPartitions("section", "seq", "part").select("line").write.mode("overwrite").text(path)


def read_turtle(lines: DataFrame) -> DataFrame:
    """(subject, predicate, object) of an export of this form; lines: file, no (order within the file), value.

    A statement's later lines begin with white space; its subject is the last one before them in the file. Files are read side
    by side; the window spans one file.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.where(~F.col("value").rlike(r"^\s*(?:#|@prefix|$)"))
    starts = ~F.col("value").rlike(r"^\s")
    subject = F.last(F.when(starts, F.regexp_extract("value", r"^(\S+)", 1)), ignorenulls=True).over(w)
    rest = F.regexp_replace(F.when(starts, F.regexp_replace("value", r"^\S+\s+", "")).otherwise(F.trim("value")), r"\s*[;.]\s*$", "")
    return body.select(subject.alias("subject"), F.regexp_extract(rest, r"^(\S+)", 1).alias("predicate"), F.regexp_extract(rest, r"^\S+\s+(.*)$", 1).alias("object")).where("predicate <> '' and object <> ''")
