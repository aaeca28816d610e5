"""From documents to a knowledge graph: chunk, extract, filter by the closed world, deduplicate, remap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import normalize_id
from ontoloom.operators import abox
from ontoloom.operators.leader import deduplicate
from ontoloom.plans.backends import ExtractorBackend, both
from ontoloom.runtime import checkpoint
from ontoloom.sources.readers import prepare


def populate(docs: DataFrame, classes: DataFrame, properties: DataFrame, backend: ExtractorBackend, fuzzy: bool = True) -> dict[str, DataFrame]:
    """The A-Box of documents (doc_id, text) under a frozen T-Box: entities, relations, skipped, and typed, the entities without evidence.

    All chunks are extracted side by side (snapshot mode); the order doc_id, chunk_ix, pos stands for that in which a
    sequential run would have met the mentions. fuzzy: merge similar ids, not only those that are equal when normalised.
    """
    mentions, stated = both(backend, prepare(docs))
    order = F.struct("doc_id", "chunk_ix", "pos")
    kept = abox.known_entities(mentions, classes)
    # the order as one number, wide enough for any document id
    seq = F.col("doc_id").cast("decimal(20,0)") * 10**17 + F.col("chunk_ix").cast("decimal(10,0)") * 10**8 + F.col("pos")
    by_class = kept.groupBy("id", "class_uri").agg(F.min(seq.cast("decimal(38,0)")).alias("seq"))
    firsts = by_class.groupBy("id").agg(F.min(F.struct("seq", "class_uri")).alias("f"))
    ranked = checkpoint(firsts.select("id", normalize_id(F.col("id")).alias("norm"), "f.seq", "f.class_uri"), release=True)
    if fuzzy:
        led = deduplicate(ranked.select("id", "norm", "seq"))
    else:
        first = ranked.groupBy("norm").agg(F.min(F.struct("seq", "id")).alias("f")).select("norm", F.col("f.id").alias("leader_id"))
        led = ranked.select("id", "norm").join(first, "norm")
    led = checkpoint(led, release=True)
    typed = led.where("id = leader_id").select("id").join(ranked.select("id", "class_uri"), "id")
    first_evidence = kept.groupBy("id").agg(F.min(F.struct(order.alias("o"), "class_uri", "evidence_span")).alias("m"))
    entities = typed.join(first_evidence, "id").select("id", "class_uri", "m.evidence_span")
    # by chunk, the ids that have another leader: one join settles both ends of a relation
    to = kept.select("doc_id", "chunk_ix", "id").join(led.where("id <> leader_id").select("id", "leader_id"), "id")
    to = to.groupBy("doc_id", "chunk_ix").agg(F.map_from_entries(F.collect_set(F.struct("id", "leader_id"))).alias("to"))
    relations = abox.known_relations(stated, properties).join(to, ["doc_id", "chunk_ix"], "left")
    for end in ("source_id", "target_id"):
        relations = relations.withColumn(end, F.coalesce(F.try_element_at("to", F.col(end)), end))
    relations = checkpoint(relations.drop("to"), release=True)
    parts = ["source_id", "property_uri", "target_id", "evidence_span"]
    distinct = relations.groupBy(*parts).agg(F.min(order).alias("first"))
    return {"entities": entities, "typed": typed, "relations": distinct, "skipped": abox.skipped(mentions, stated, classes, properties)}
