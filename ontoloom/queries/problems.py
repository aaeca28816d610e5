"""Queries of the general training-data problems (3, 5 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.operators.hierarchy import descendants, parent_links, resolve
from ontoloom.operators.references import orphans, parents, references
from ontoloom.operators.snapshots import snapshot_changes, snapshot_rows
from ontoloom.runtime import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return parent_links(table(spark, d, "ontology_classes"), "uri", "subclass_of", "class_row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every uri; -1 and the smallest uri of the cycle where the way up never ends."""
    return resolve(_links(spark, d)).select(F.col("node").alias("uri"), F.col("root").alias("root_uri"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path from the root of every uri whose way up ends, and its number of descendants."""
    solved = resolve(_links(spark, d), with_paths=True)
    below = descendants(solved).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_descendants"))
    return solved.join(below, solved["node"] == below["ancestor"], "left").select(
        F.col("node").alias("uri"), F.array_join("path", " > ").alias("path"), "depth", F.col("root").alias("root_uri"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants")
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every uri with the steps between them."""
    below = descendants(resolve(_links(spark, d), with_paths=True))
    return below.select(F.col("ancestor").alias("uri"), F.col("node").alias("descendant"), F.col("steps").cast("int").alias("steps"))


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Number of uris whose way up runs into each cycle."""
    bad = resolve(_links(spark, d)).where("depth = -1")
    return bad.groupBy(F.col("root").alias("cycle_uri")).agg(F.count(F.lit(1)).alias("n_uris"))


SECTIONS = {"approved_classes": ("state_classes", ["uri"]), "approved_properties": ("state_properties", ["uri"]), "relations": ("state_relations", ["source_id", "property_uri", "target_id"])}


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for section, (name, key) in SECTIONS.items():
        one = snapshot_rows(table(spark, d, name), section, key)
        rows = one if rows is None else rows.unionByName(one)
    return snapshot_changes(rows)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records added, removed or changed in each run."""
    return _changes(spark, d).select("section", "run", "item_key", "change")


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes of each kind per section and run."""
    return _changes(spark, d).groupBy("section", "run", "change").agg(F.count(F.lit(1)).alias("n_records"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    props, rels, seeds = table(spark, d, "ontology_properties"), table(spark, d, "relation_mentions"), table(spark, d, "seed_terms")
    alive = parents(table(spark, d, "ontology_classes"), "class", "uri", "ingested_at", "removed_at").unionByName(
        parents(table(spark, d, "entities"), "entity", "id", "ingested_at", "removed_at")
    )
    declared = props.select(F.col("uri").alias("property_uri"), "range").unionByName(seeds.where("kind = 'property'").select(F.col("uri").alias("property_uri"), "range"))
    literal = declared.where(F.col("range").startswith("xsd:") | (F.col("range") == "rdfs:Literal")).select("property_uri").distinct()
    refs = [
        references(props, "ontology_properties", "prop_row_id", "domain", "class", "ingested_at"),
        references(props, "ontology_properties", "prop_row_id", "range", "class", "ingested_at"),
        references(rels, "relation_mentions", "rel_id", "source_id", "entity", "ingested_at"),
        references(rels.join(literal, "property_uri", "left_anti"), "relation_mentions", "rel_id", "target_id", "entity", "ingested_at"),
    ]
    seeded = seeds.where("kind in ('class', 'builtin', 'entity')").select(F.when(F.col("kind") == "entity", "entity").otherwise("class").alias("space"), F.col("uri").alias("key")).distinct()
    every = refs[0].unionByName(refs[1]).unionByName(refs[2]).unionByName(refs[3])
    return orphans(every.join(seeded, ["space", "key"], "left_anti"), alive)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """References to classes and entities that do not hold at the time of the referring row."""
    return _orphans(spark, d).select("ref_table", "row_key", "ref_field")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """References that do not hold, per table, field and month of ingested_at (null months together)."""
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    return _orphans(spark, d).groupBy("ref_table", "ref_field", month.alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_cycles, p5_found, p5_summary, p7_found, p7_report)}

_WALK = """WITH RECURSIVE l AS (
  SELECT uri, min(struct_pack(k := class_row_id, p := subclass_of)).p AS parent FROM ontology_classes WHERE uri IS NOT NULL GROUP BY uri),
w AS (SELECT uri, uri AS cur, 0 AS depth, [uri] AS seen FROM l
  UNION ALL SELECT w.uri, l.parent, w.depth + 1, list_append(w.seen, l.parent) FROM w JOIN l ON l.uri = w.cur
  WHERE l.parent IS NOT NULL AND (len(w.seen) < 2 OR NOT list_contains(w.seen[:-2], w.cur))),
e AS (SELECT uri, cur, depth, seen, list_contains(seen[:-2], cur) AS looped FROM w
  QUALIFY row_number() OVER (PARTITION BY uri ORDER BY depth DESC) = 1),
r AS (SELECT uri, seen, depth AS steps, looped, CASE WHEN looped THEN list_min(seen[list_position(seen, cur):]) ELSE cur END AS root_uri,
  CASE WHEN looped THEN -1 ELSE depth END AS depth FROM e)
"""

_DIFF = """WITH s AS (
  SELECT DISTINCT 'approved_classes' AS section, run, uri AS k, concat_ws('|', coalesce(bfo_parent, '~'), coalesce(subclass_of, '~'), coalesce(aristotelian_definition, '~'), coalesce(comment, '~')) AS v FROM state_classes
  UNION ALL SELECT DISTINCT 'approved_properties', run, uri, concat_ws('|', coalesce(domain, '~'), coalesce(range, '~'), coalesce(comment, '~')) FROM state_properties
  UNION ALL SELECT DISTINCT 'relations', run, coalesce(source_id, '') || '|' || coalesce(property_uri, '') || '|' || coalesce(target_id, ''), coalesce(evidence_span, '~') FROM state_relations),
r AS (SELECT section, run, lag(run) OVER (PARTITION BY section ORDER BY CAST(split_part(run, '_', 2) AS INT)) AS prev FROM (SELECT DISTINCT section, run FROM s)),
a AS (SELECT r.section, r.run, k, v FROM s JOIN r USING (section, run) WHERE prev IS NOT NULL),
b AS (SELECT r.section, r.run, k, v FROM s JOIN r ON r.section = s.section AND r.prev = s.run),
f AS (SELECT coalesce(a.section, b.section) AS section, coalesce(a.run, b.run) AS run, coalesce(a.k, b.k) AS item_key,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change
  FROM a FULL JOIN b ON a.section = b.section AND a.run = b.run AND a.k = b.k)
"""

_MISS = """WITH lit AS (SELECT uri FROM (SELECT uri, range FROM ontology_properties UNION ALL SELECT uri, range FROM seed_terms WHERE kind = 'property') WHERE range LIKE 'xsd:%' OR range = 'rdfs:Literal'),
refs AS (
  SELECT 'ontology_properties' AS ref_table, prop_row_id AS row_key, 'domain' AS ref_field, domain AS k, ingested_at AS t FROM ontology_properties
  UNION ALL SELECT 'ontology_properties', prop_row_id, 'range', range, ingested_at FROM ontology_properties
  UNION ALL SELECT 'relation_mentions', rel_id, 'source_id', source_id, ingested_at FROM relation_mentions
  UNION ALL SELECT 'relation_mentions', rel_id, 'target_id', target_id, ingested_at FROM relation_mentions WHERE property_uri IS NULL OR property_uri NOT IN (SELECT uri FROM lit WHERE uri IS NOT NULL)),
m AS (SELECT * FROM refs f WHERE k IS NOT NULL AND CASE WHEN ref_table = 'ontology_properties' THEN
    k NOT IN (SELECT uri FROM seed_terms WHERE kind IN ('class', 'builtin')) AND NOT EXISTS (SELECT 1 FROM ontology_classes c WHERE c.uri = f.k AND c.ingested_at <= f.t AND (c.removed_at IS NULL OR c.removed_at > f.t))
  ELSE k NOT IN (SELECT uri FROM seed_terms WHERE kind = 'entity') AND NOT EXISTS (SELECT 1 FROM entities c WHERE c.id = f.k AND c.ingested_at <= f.t AND (c.removed_at IS NULL OR c.removed_at > f.t)) END)
"""

SQL = {
    "p3_found": _WALK + "SELECT uri, root_uri, CAST(depth AS INT) AS depth FROM r",
    "p3_paths": _WALK
    + """SELECT uri, CASE WHEN depth >= 0 THEN array_to_string(list_reverse(seen), ' > ') END AS path, CAST(depth AS INT) AS depth, root_uri,
  (SELECT count(*) FROM r x WHERE x.depth >= 0 AND x.uri <> r.uri AND list_contains(x.seen, r.uri)) AS n_descendants FROM r""",
    "p3_descendants": _WALK + "SELECT u.a AS uri, r.uri AS descendant, CAST(list_position(r.seen, u.a) - 1 AS INT) AS steps FROM r, unnest(r.seen[2:]) AS u(a) WHERE r.depth >= 0",
    "p3_cycles": _WALK + "SELECT root_uri AS cycle_uri, count(*) AS n_uris FROM r WHERE depth = -1 GROUP BY 1",
    "p5_found": _DIFF + "SELECT section, run, item_key, change FROM f WHERE change IS NOT NULL",
    "p5_summary": _DIFF + "SELECT section, run, change, count(*) AS n_records FROM f WHERE change IS NOT NULL GROUP BY ALL",
    "p7_found": _MISS + "SELECT ref_table, row_key, ref_field FROM m",
    "p7_report": _MISS + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n_orphans FROM m GROUP BY ALL",
}
