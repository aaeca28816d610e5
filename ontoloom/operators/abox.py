"""A-Box: closed-world filters, id remapping and relation deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import normalize_id
from ontoloom.operators.tbox import first_wins
from ontoloom.runtime import lookup


def known_entities(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Entities of an approved class. Null classes are not approved."""
    return entities.join(classes.select(F.col("uri").alias("class_uri")), "class_uri", "left_semi").select(*entities.columns)


def unknown_entities(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Entities of no approved class."""
    return entities.join(classes.select(F.col("uri").alias("class_uri")), "class_uri", "left_anti").select(*entities.columns)


def known_relations(relations: DataFrame, properties: DataFrame) -> DataFrame:
    """Relations of an approved property; ends are not looked at."""
    return relations.join(properties.select(F.col("uri").alias("property_uri")), "property_uri", "left_semi").select(*relations.columns)


def unknown_relations(relations: DataFrame, properties: DataFrame) -> DataFrame:
    return relations.join(properties.select(F.col("uri").alias("property_uri")), "property_uri", "left_anti").select(*relations.columns)


def skipped(entities: DataFrame, relations: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: rejected entities, rejected relations and their sum."""
    e = unknown_entities(entities, classes).agg(F.count(F.lit(1)).alias("entities"))
    r = unknown_relations(relations, properties).agg(F.count(F.lit(1)).alias("relations"))
    return e.select("entities", r.select("relations").scalar().alias("relations")).withColumn("skipped", F.col("entities") + F.col("relations"))


def exact_leaders(entities: DataFrame, id_col: str = "id", order: str = "entity_key") -> DataFrame:
    """(norm, leader): the first id of every normalised id, without similarity."""
    return first_wins(entities.select(normalize_id(F.col(id_col)).alias("norm"), F.col(id_col).alias("leader"), order), "norm", [order], ["leader"])


def remap_relations(relations: DataFrame, entities: DataFrame, leaders: DataFrame) -> DataFrame:
    """Relations with each end replaced by its leader where that id was accepted in the same chunk; other ends stay.

    entities: accepted mentions with doc_id, chunk_ix, id; leaders: norm, leader, unique in norm.
    """
    mapped = entities.where("id is not null").select("doc_id", "chunk_ix", "id", normalize_id(F.col("id")).alias("norm")).distinct()
    mapped = lookup(mapped, leaders, "norm", "inner")
    out = relations
    for end in ("source_id", "target_id"):
        m = mapped.select("doc_id", "chunk_ix", F.col("id").alias(end), F.col("leader").alias("_to"))
        out = out.join(m, ["doc_id", "chunk_ix", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.select(*relations.columns)


def distinct_relations(relations: DataFrame, seq: str) -> DataFrame:
    """The first of relations equal in all four parts, null equal to null."""
    parts = ["source_id", "property_uri", "target_id", "evidence_span"]
    return relations.groupBy(*parts).agg(F.min(seq).alias(seq))


def triples(relations: DataFrame) -> DataFrame:
    """Distinct (source_id, property_uri, target_id)."""
    return relations.select("source_id", "property_uri", "target_id").distinct()


def type_violations(relations: DataFrame, entities: DataFrame, properties: DataFrame) -> DataFrame:
    """Relations whose source has stated classes, none of them the domain of the property: rel_id, source_id, domain."""
    typed = entities.where("id is not null and class_uri is not null").select(F.col("id").alias("source_id"), F.col("class_uri").alias("domain")).distinct()
    stated = typed.select("source_id").distinct()
    checked = relations.join(properties.select(F.col("uri").alias("property_uri"), "domain").where(~F.col("domain").isin("owl:Thing", "ex:Thing", "rdfs:Literal")), "property_uri")
    return checked.join(stated, "source_id", "left_semi").join(typed, ["source_id", "domain"], "left_anti").select("rel_id", "source_id", "domain")
