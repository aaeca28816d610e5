"""Queries of the ontology and knowledge-graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.conf import SPECIAL_CLASSES, TURTLE_PREFIXES, XSD_INGEST, XSD_VALID, EngineConf
from ontoloom.functions import text as X
from ontoloom.functions.json_repair import extract, normalize
from ontoloom.functions.splitter import chunk
from ontoloom.operators import abox, cycles, limiter, report, tbox, turtle, validation
from ontoloom.operators.corrections import apply_corrections
from ontoloom.operators.leader import deduplicate, similar_pairs
from ontoloom.plans import prompts
from ontoloom.plans.backends import ReplayBackend, RuleBackend, batches_of
from ontoloom.plans.pipeline import populate
from ontoloom.runtime import spread, table
from ontoloom.sources.readers import prepare
from ontoloom.streaming import quota

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_S = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CUT = "split_part(split_part(text, 'REFERENCES', 1), 'Acknowledgments', 1)"


def _clean(t: str) -> str:
    for p in X.FURNITURE:
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    return f"regexp_replace(regexp_replace({t}, '{_S}+', ' ', 'g'), '^ | $', '', 'g')"


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '(?:[_\\-]|{_S})+', '', 'g'), 's$', '')"


def _classes(s: SparkSession, d: str) -> DataFrame:
    return tbox.approved_classes(table(s, d, "ontology_classes"))


def _properties(s: SparkSession, d: str) -> DataFrame:
    return tbox.approved_properties(table(s, d, "ontology_properties"), _classes(s, d))


_CLASSES = """cls AS (SELECT uri, bfo_parent, subclass_of, aristotelian_definition, comment, batch_ix AS first_batch, class_row_id AS seq FROM ontology_classes WHERE uri IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY uri ORDER BY batch_ix, pos, class_row_id) = 1)"""
_PROPERTIES = f"""prp AS (SELECT p.uri, domain, range, p.comment, batch_ix AS first_batch, prop_row_id AS seq FROM ontology_properties p
  LEFT JOIN cls a ON a.uri = p.domain LEFT JOIN cls b ON b.uri = p.range
  WHERE p.uri IS NOT NULL AND (domain IN ({_in(SPECIAL_CLASSES)}) OR a.first_batch <= batch_ix) AND (range IN ({_in((*SPECIAL_CLASSES, *XSD_INGEST))}) OR b.first_batch <= batch_ix)
  QUALIFY row_number() OVER (PARTITION BY p.uri ORDER BY batch_ix, pos, prop_row_id) = 1)"""
_T = f"WITH {_CLASSES}, {_PROPERTIES} "


# text


@_query(f"SELECT doc_id, md5({_CUT}) AS cut_md5, length({_CUT}) AS n_chars FROM documents")
def section_cut(s, d):
    c = X.section_cut(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.md5(c).alias("cut_md5"), F.char_length(c).cast("bigint").alias("n_chars"))


@_query(f"SELECT doc_id, {_clean(_CUT)} AS cleaned FROM documents")
def clean_text(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", X.clean(X.section_cut(F.col("text"))).alias("cleaned"))


@_query()
def chunk_docs(s, d):
    return prepare(table(s, d, "documents"))


@_query("SELECT doc_id, TRUE AS whole, TRUE AS fits FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def chunk_invariants(s, d):
    """Whether the chunks of each document, without overlap, keep every character that isn't white space, and keep the size."""
    docs = table(s, d, "documents")
    chunks = chunk(docs, 2500, 0).groupBy("doc_id").agg(F.sum(F.char_length(F.regexp_replace("text", f"{_S}+", ""))).alias("n"), F.max(F.char_length("text")).alias("most"))
    want = docs.select("doc_id", F.char_length(F.regexp_replace("text", f"{_S}+", "")).alias("want"))
    return chunks.join(want, "doc_id").select("doc_id", (F.col("n") == F.col("want")).alias("whole"), (F.col("most") <= 2500).alias("fits"))


@_query(
    """SELECT doc_id, CAST(chunk_ix // 3 AS INT) AS batch_ix, string_agg(t, chr(10) || chr(10) ORDER BY chunk_ix) AS text FROM (
  SELECT doc_id, chunk_ix, min(evidence_span) AS t FROM relation_mentions WHERE evidence_span IS NOT NULL AND doc_id IS NOT NULL AND chunk_ix IS NOT NULL GROUP BY ALL) GROUP BY 1, 2"""
)
def chunk_batches(s, d):
    rows = table(s, d, "relation_mentions").where("evidence_span is not null and doc_id is not null and chunk_ix is not null")
    return batches_of(rows.groupBy("doc_id", "chunk_ix").agg(F.min("evidence_span").alias("text")))


@_query(f"SELECT entity_key, id, {_norm('id')} AS norm FROM entities")
def normalize_ids(s, d):
    return table(s, d, "entities").select("entity_key", "id", X.normalize_id(F.col("id")).alias("norm"))


_G = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, CAST(i AS INT), 2))) END"


@_query(
    f"""SELECT a.label AS a, b.label AS b, round(len(list_intersect({_G.format("lower(a.label)")}, {_G.format("lower(b.label)")})) * 1.0 /
  len(list_distinct(list_concat({_G.format("lower(a.label)")}, {_G.format("lower(b.label)")}))), 6) AS similarity
  FROM term_reference a JOIN term_reference b ON a.ref_id < b.ref_id AND split_part(a.label, ' ', 1) = split_part(b.label, ' ', 1)"""
)
def bigram_jaccard(s, d):
    t = table(s, d, "term_reference").select("ref_id", "label", F.split_part("label", F.lit(" "), F.lit(1)).alias("w"), X.bigrams(F.lower("label")).alias("g"))
    b = t.select(F.col("ref_id").alias("r2"), F.col("label").alias("b"), "w", F.col("g").alias("h"))
    return t.join(b, "w").where("ref_id < r2").select(F.col("label").alias("a"), "b", F.round(X.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


_SIM = f"""a.n <> '' AND b.n <> '' AND (contains(a.n, b.n) OR contains(b.n, a.n) OR
  len(list_intersect({_G.format("a.n")}, {_G.format("b.n")})) * 1.0 / nullif(len(list_distinct(list_concat({_G.format("a.n")}, {_G.format("b.n")}))), 0) >= 0.85)"""
_PARTS = f"m AS (SELECT {_norm('p_name')} AS n, min(p_partkey) AS i FROM part WHERE p_name IS NOT NULL GROUP BY 1)"


@_query(f"WITH {_PARTS} SELECT a.n AS a, b.n AS b FROM m a JOIN m b ON a.i < b.i AND {_SIM}")
def fuzzy_pairs(s, d):
    norms = table(s, d, "part").where("p_name is not null").groupBy(X.normalize_id(F.col("p_name")).alias("norm")).agg(F.min("p_partkey").alias("i"))
    pairs = similar_pairs(norms)
    return pairs.join(norms.select("i", F.col("norm").alias("a")), "i").join(norms.select(F.col("i").alias("j"), F.col("norm").alias("b")), "j").select("a", "b")


@_query(
    f"""WITH RECURSIVE {_PARTS}, o AS (SELECT n, i, row_number() OVER (ORDER BY i) AS k FROM m),
sim AS (SELECT a.k AS ak, b.k AS bk FROM o a JOIN o b ON b.k < a.k AND {_SIM}),
adj AS (SELECT o.k, coalesce(list(bk ORDER BY bk) FILTER (bk IS NOT NULL), []) AS nb FROM o LEFT JOIN sim ON ak = o.k GROUP BY 1),
w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS led, 0::BIGINT AS asg
  UNION ALL SELECT a.k, CASE WHEN len(list_intersect(a.nb, w.led)) = 0 THEN list_append(w.led, a.k) ELSE w.led END,
    CASE WHEN len(list_intersect(a.nb, w.led)) = 0 THEN a.k ELSE list_min(list_intersect(a.nb, w.led)) END FROM w JOIN adj a ON a.k = w.k + 1),
f AS (SELECT {_norm('p_name')} AS n, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY 1)
SELECT DISTINCT p.p_name AS id, o.n AS norm, f.first_name AS leader_id FROM part p JOIN o ON o.n = {_norm('p.p_name')} JOIN w ON w.k = o.k JOIN o l ON l.k = w.asg JOIN f ON f.n = l.n"""
)
def leader_dedup(s, d):
    return deduplicate(table(s, d, "part").where("p_name is not null").select(F.col("p_name").alias("id"), X.normalize_id(F.col("p_name")).alias("norm"), F.col("p_partkey").alias("seq")))


@_query()
def entity_leaders(s, d):
    """Leaders over all entity ids."""
    e = table(s, d, "entities").where("id is not null")
    return deduplicate(e.select("id", X.normalize_id(F.col("id")).alias("norm"), F.col("entity_key").alias("seq")))


@_query("SELECT term_id, CASE WHEN regexp_matches(uri, '^(ex|xsd|rdfs|owl|bfo):') THEN uri ELSE 'ex:' || uri END AS prefixed, 'ex:' || term AS typed FROM canonical_terms")
def ensure_prefix(s, d):
    t = table(s, d, "canonical_terms")
    typed = F.concat(F.lit("ex:"), "term")
    return t.select("term_id", X.ensure_prefix(F.col("uri")).alias("prefixed"), typed.alias("typed"))


@_query("SELECT rel_id, replace(replace(replace(evidence_span, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' ') AS escaped FROM relation_mentions")
def escape_literal(s, d):
    return table(s, d, "relation_mentions").select("rel_id", X.escape_literal(F.col("evidence_span")).alias("escaped"))


@_query("SELECT entity_key, regexp_replace(regexp_replace(id, '[^a-zA-Z0-9_]', '_', 'g'), '^ex_', '') AS local FROM entities")
def safe_ids(s, d):
    return table(s, d, "entities").select("entity_key", X.safe_id(F.col("id")).alias("local"))


@_query("""SELECT doc_id, md5('{"kwargs": {}, "prompt": ' || CAST(to_json(text) AS VARCHAR) || '}') AS key FROM documents""")
def cache_key(s, d):
    """The key of each text as a request, by the operator."""
    return ReplayBackend(s.createDataFrame([], "prefix string, key string, payload string")).requests(table(s, d, "documents").withColumn("chunk_ix", F.lit(0))).select("doc_id", "key")


@_query(
    """SELECT class_row_id AS doc_id, 0 AS pos, uri AS id, bfo_parent AS class_uri, comment AS evidence_span FROM ontology_classes"""
)
def replayed_entities(s, d):
    """Entities of recorded answers: each class row is a chunk whose answer was recorded under the key of its request."""
    rows = table(s, d, "ontology_classes")
    chunks = rows.select(F.col("class_row_id").alias("doc_id"), F.lit(0).alias("chunk_ix"), F.concat_ws(" ", F.lit("row"), "class_row_id").alias("text"))
    answer = F.to_json(F.struct(F.array(F.struct(F.col("uri").alias("id"), F.col("bfo_parent").alias("class_uri"), F.col("comment").alias("evidence_span"))).alias("entities")), {"ignoreNullFields": "false"})
    keys = ReplayBackend(rows.limit(0)).requests(chunks).join(rows.select(F.col("class_row_id").alias("doc_id"), answer.alias("payload")), "doc_id")
    return ReplayBackend(keys.select("prefix", "key", "payload")).entities(chunks).select("doc_id", "pos", "id", "class_uri", "evidence_span")


@_query(f"""WITH {_CLASSES} SELECT uri, CASE WHEN uri < subclass_of THEN NULL ELSE subclass_of END AS subclass_of FROM cls""")
def removed_edges(s, d):
    """Edges to a parent behind the child in order are removed; requests that name another parent than the class has do nothing."""
    c = _classes(s, d)
    edges = tbox.subclass_edges(c)
    wrong = edges.select("child", F.concat("parent", F.lit("x")).alias("parent"))
    return tbox.remove_subclass(c, edges.where("child < parent").unionByName(wrong)).select("uri", "subclass_of")


@_query(
    f"""WITH {_CLASSES} SELECT uri, bfo_parent, aristotelian_definition FROM cls UNION ALL
  SELECT uri, 'bfo:Entity', 'A ' || regexp_replace(uri, '^.*:', '') || ' is an Entity.' FROM (SELECT DISTINCT uri FROM seed_terms WHERE uri IS NOT NULL) WHERE uri NOT IN (SELECT uri FROM cls)"""
)
def seeded_classes(s, d):
    return tbox.with_seeds(_classes(s, d), table(s, d, "seed_terms").select("uri", F.lit(None).cast("string").alias("comment"))).select("uri", "bfo_parent", "aristotelian_definition")


@_query()
def repaired_records(s, d):
    """Fields that can be read from each payload, repaired where it is cut off or fenced."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            found = [extract(p) if p else None for p in b["payload"].to_pylist()]
            n = [len(x) if isinstance(x, dict) else None for x in found]
            yield pa.RecordBatch.from_arrays([b["record_id"], pa.array(n, pa.int32())], ["record_id", "n_fields"])

    return table(s, d, "raw_records").select("record_id", "payload").mapInArrow(read, "record_id bigint, n_fields int")


@_query()
def normalized_records(s, d):
    """Class payloads in the form of a class result."""

    def read(batches):
        import json

        import pyarrow as pa

        for b in batches:
            found = [normalize([x], "classes")["classes"] if isinstance(x := extract(p or ""), dict) else [] for p in b["payload"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["record_id"], pa.array([json.dumps(f, ensure_ascii=False, sort_keys=True) for f in found], pa.string())], ["record_id", "classes"])

    return table(s, d, "raw_records").where("kind = 'class'").select("record_id", "payload").mapInArrow(read, "record_id bigint, classes string")


# T-Box


@_query(f"WITH {_CLASSES} SELECT uri, bfo_parent, subclass_of, first_batch, seq FROM cls")
def first_wins_classes(s, d):
    return _classes(s, d).select("uri", "bfo_parent", "subclass_of", "first_batch", "seq")


@_query("SELECT term, uri FROM canonical_terms WHERE term IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term ORDER BY batch_ix, term_id) = 1")
def first_wins_terms(s, d):
    return tbox.approved_terms(table(s, d, "canonical_terms"))


@_query(_T + "SELECT uri, domain, range, comment, first_batch, seq FROM prp")
def constrained_properties(s, d):
    return _properties(s, d)


@_query(_T + "SELECT (SELECT count(*) FROM cls) AS n_classes, (SELECT count(*) FROM prp) AS n_properties")
def ontology_size(s, d):
    n = _properties(s, d).agg(F.count(F.lit(1)).alias("n")).scalar()
    return _classes(s, d).agg(F.count(F.lit(1)).alias("n_classes")).select("n_classes", n.alias("n_properties"))


@_query(f"WITH {_CLASSES} SELECT uri AS child, subclass_of AS parent FROM cls WHERE subclass_of IS NOT NULL")
def subclass_edges(s, d):
    return tbox.subclass_edges(_classes(s, d))


@_query(
    """SELECT class_row_id, bfo_parent, coalesce(c.cat, l.cat, 'bfo:Entity') AS repaired FROM ontology_classes o LEFT JOIN bfo_categories c ON c.cat = o.bfo_parent
  LEFT JOIN bfo_categories l ON l.is_leaf AND lower(replace(replace(l.cat, ' ', ''), '_', '')) = replace(replace(lower(o.bfo_parent), ' ', ''), '_', '')"""
)
def bfo_repair(s, d):
    return tbox.repair_categories(table(s, d, "ontology_classes"), "bfo_parent", table(s, d, "bfo_categories")).select("class_row_id", "bfo_parent", "repaired")


@_query("SELECT class_row_id FROM ontology_classes WHERE bfo_parent IN (SELECT cat FROM bfo_categories)")
def bfo_valid(s, d):
    cats = table(s, d, "bfo_categories").select(F.col("cat").alias("bfo_parent"))
    return table(s, d, "ontology_classes").join(cats, "bfo_parent", "left_semi").select("class_row_id")


@_query(
    """WITH RECURSIVE up AS (SELECT cat, cat AS lineage, 0 AS depth FROM bfo_categories WHERE parent IS NULL
  UNION ALL SELECT c.cat, u.lineage || ' > ' || c.cat, u.depth + 1 FROM bfo_categories c JOIN up u ON c.parent = u.cat) SELECT * FROM up"""
)
def bfo_lineage(s, d):
    return tbox.lineage(table(s, d, "bfo_categories"))


@_query("SELECT string_agg('- ' || cat || ' < ' || coalesce(parent, ''), chr(10) ORDER BY cat) AS prompt FROM bfo_categories WHERE is_leaf")
def bfo_prompt(s, d):
    return prompts.bfo_prompt(table(s, d, "bfo_categories"))


# hierarchy

_LOOP = f"""WITH RECURSIVE {_CLASSES}, w AS (SELECT uri AS start, uri AS cur, [uri] AS path, FALSE AS done FROM cls
  UNION ALL SELECT w.start, c.subclass_of, list_append(w.path, c.subclass_of), c.subclass_of = w.start FROM w JOIN cls c ON c.uri = w.cur
  WHERE NOT w.done AND c.subclass_of IS NOT NULL AND (c.subclass_of = w.start OR NOT list_contains(w.path, c.subclass_of))),
cyc AS (SELECT start AS cycle_uri, path FROM w WHERE done AND start = list_min(path)) """


def _links(s, d):
    return _classes(s, d).select(F.col("uri").alias("node"), F.col("subclass_of").alias("parent"))


@_query(_LOOP + "SELECT cycle_uri, array_to_string(path, ' -> ') AS path, CAST(len(path) - 1 AS INT) AS n_nodes FROM cyc")
def hierarchy_cycles(s, d):
    return cycles.find_cycles(_links(s, d)).select("cycle_uri", F.array_join("path", " -> ").alias("path"), "n_nodes")


@_query(_LOOP + "SELECT uri AS node, CASE WHEN subclass_of = (SELECT cycle_uri FROM cyc WHERE path[len(path) - 1] = uri) THEN NULL ELSE subclass_of END AS parent FROM cls")
def break_cycles(s, d):
    return cycles.break_cycles(_links(s, d))


@_query(f"WITH {_CLASSES} SELECT uri AS child, subclass_of AS parent FROM cls WHERE subclass_of IS NOT NULL AND NOT (coalesce(length(uri) % 7 = 0, FALSE) OR length(subclass_of) % 5 = 0)")
def two_way_filter(s, d):
    """Edges after verdicts that stand for a judge: false forward for every seventh length of the child, true backward for every fifth of the parent."""
    edges = tbox.subclass_edges(_classes(s, d))
    verdicts = edges.select(F.col("child").alias("child_uri"), F.col("parent").alias("parent_uri"), (F.char_length("child") % 7 != 0).alias("forward_valid"), (F.char_length("parent") % 5 == 0).alias("reverse_valid"))
    return cycles.two_way_filter(edges, verdicts)


# validation

_LOCAL = "replace(uri, 'ex:', '')"


@_query(
    _T
    + f"""SELECT 'class_case' AS code, uri AS subject FROM cls WHERE {_LOCAL} <> '' AND NOT regexp_matches({_LOCAL}, '^\\p{{Lu}}')
  UNION ALL SELECT 'class_name', uri FROM cls WHERE regexp_matches({_LOCAL}, '[ -]') UNION ALL SELECT 'property_case', uri FROM prp WHERE regexp_matches({_LOCAL}, '^\\p{{Lu}}')
  UNION ALL SELECT 'empty_name', uri FROM cls WHERE {_LOCAL} = '' UNION ALL SELECT 'empty_name', uri FROM prp WHERE {_LOCAL} = ''"""
)
def validate_naming(s, d):
    return validation.naming(_classes(s, d), _properties(s, d)).select("code", "subject")


@_query(
    f"""WITH {_CLASSES}, p AS (SELECT uri, domain, range FROM ontology_properties WHERE uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uri ORDER BY batch_ix, pos, prop_row_id) = 1)
  SELECT 'domain' AS code, uri AS subject, 'property ' || uri || ': no class is called ' || coalesce(domain, '') || ', its domain' AS message FROM p
    WHERE NOT coalesce(domain IN ({_in(SPECIAL_CLASSES)}) OR domain IN (SELECT uri FROM cls), FALSE)
  UNION ALL SELECT 'range', uri, 'property ' || uri || ': neither a class nor a datatype is called ' || coalesce(range, '') || ', its range' FROM p
    WHERE NOT coalesce(range IN ({_in((*SPECIAL_CLASSES, *XSD_VALID))}) OR range IN (SELECT uri FROM cls), FALSE)"""
)
def validate_domain_range(s, d):
    """Over the first row of every property, accepted or not."""
    props = tbox.first_wins(table(s, d, "ontology_properties"), "uri", ["batch_ix", "pos", "prop_row_id"], ["domain", "range"])
    return validation.domain_range(_classes(s, d), props).select("code", "subject", "message")


@_query(
    f"""WITH p AS (SELECT uri, coalesce(domain, '') AS domain, coalesce(range, '') AS range, prop_row_id AS seq FROM ontology_properties WHERE uri IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY uri ORDER BY batch_ix, pos, prop_row_id) = 1)
  SELECT domain || ' -> ' || range AS subject, count(*) || ' properties lead from ' || domain || ' to ' || range || ', among them ' ||
    array_to_string(list(uri ORDER BY seq)[:4], ', ') AS message FROM p GROUP BY domain, range HAVING count(*) > 3"""
)
def validate_conflicts(s, d):
    props = tbox.first_wins(table(s, d, "ontology_properties").withColumn("seq", F.col("prop_row_id")), "uri", ["batch_ix", "pos", "prop_row_id"], ["domain", "range", "seq"])
    return validation.conflicts(props).select("subject", "message")


@_query(
    _T
    + """, every AS (SELECT uri, domain, range FROM prp UNION ALL SELECT 'ex:up_' || uri, uri, subclass_of FROM cls WHERE subclass_of IS NOT NULL UNION ALL SELECT 'ex:down_' || uri, subclass_of, uri FROM cls WHERE subclass_of IS NOT NULL)
  SELECT p.uri AS subject FROM every p JOIN cls c ON c.uri = p.domain AND c.subclass_of = p.range WHERE p.range NOT LIKE 'xsd:%'"""
)
def validate_inversions(s, d):
    """Over the properties and, as they have no such case, over two more for every edge, from child to parent and back."""
    c, edges = _classes(s, d), tbox.subclass_edges(_classes(s, d))
    up = edges.select(F.concat(F.lit("ex:up_"), "child").alias("uri"), F.col("child").alias("domain"), F.col("parent").alias("range"))
    down = edges.select(F.concat(F.lit("ex:down_"), "child").alias("uri"), F.col("parent").alias("domain"), F.col("child").alias("range"))
    return validation.inversions(c, _properties(s, d).select("uri", "domain", "range").unionByName(up).unionByName(down)).select("subject")


@_query(f"WITH {_CLASSES} SELECT uri AS subject, subclass_of AS parent FROM cls WHERE subclass_of IS NOT NULL AND subclass_of NOT IN (SELECT uri FROM cls)")
def validate_dangling(s, d):
    c = _classes(s, d)
    return validation.dangling(c).select("subject").join(c.select(F.col("uri").alias("subject"), F.col("subclass_of").alias("parent")), "subject")


@_query(_T + f"SELECT DISTINCT uri AS subject FROM (SELECT uri FROM cls UNION ALL SELECT uri FROM prp) WHERE NOT regexp_matches({_LOCAL}, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_.\\-]*$')")
def validate_iris(s, d):
    return validation.iri_syntax(_classes(s, d), _properties(s, d)).select("subject")


@_query(
    f"""WITH {_CLASSES}, g AS (SELECT uri, bfo_parent, regexp_extract(aristotelian_definition, '^(?i:an?) \\S+ (?i:is an?) (\\w+)', 1) AS genus FROM cls)
  SELECT uri AS subject FROM g WHERE bfo_parent IS NOT NULL AND genus <> '' AND lower(genus) <> lower(regexp_replace(bfo_parent, '^bfo:', ''))"""
)
def validate_genus(s, d):
    return validation.genus(_classes(s, d)).select("subject")


@_query(
    _LOOP.replace("cyc AS", f"{_PROPERTIES}, cyc AS")
    + f"""SELECT severity, code, count(*) AS n_findings FROM (
  SELECT 'WARNING' AS severity, 'class_case' AS code FROM cls WHERE {_LOCAL} <> '' AND NOT regexp_matches({_LOCAL}, '^\\p{{Lu}}')
  UNION ALL SELECT 'ERROR', 'class_name' FROM cls WHERE regexp_matches({_LOCAL}, '[ -]') UNION ALL SELECT 'WARNING', 'property_case' FROM prp WHERE regexp_matches({_LOCAL}, '^\\p{{Lu}}')
  UNION ALL SELECT 'ERROR', 'empty_name' FROM cls WHERE {_LOCAL} = '' UNION ALL SELECT 'ERROR', 'empty_name' FROM prp WHERE {_LOCAL} = ''
  UNION ALL SELECT 'ERROR', 'cycle' FROM cyc
  UNION ALL SELECT 'WARNING', 'conflict' FROM (SELECT 1 FROM prp GROUP BY domain, range HAVING count(*) > 3)
  UNION ALL SELECT 'WARNING', 'dangling' FROM cls WHERE subclass_of IS NOT NULL AND subclass_of NOT IN (SELECT uri FROM cls)
  UNION ALL SELECT 'ERROR', 'iri' FROM (SELECT DISTINCT uri FROM (SELECT uri FROM cls UNION ALL SELECT uri FROM prp)) WHERE NOT regexp_matches({_LOCAL}, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_.\\-]*$')
  UNION ALL SELECT 'WARNING', 'inversion' FROM prp p JOIN cls c ON c.uri = p.domain AND c.subclass_of = p.range WHERE p.range NOT LIKE 'xsd:%') GROUP BY ALL"""
)
def validation_report(s, d):
    return validation.validate(_classes(s, d), _properties(s, d)).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n_findings"))


_FIXES = """fix AS (SELECT seq, CASE k WHEN 0 THEN 'remove_class' WHEN 1 THEN 'remove_subclass' ELSE 'unknown' END AS action, uri AS t FROM (SELECT seq, uri, seq % 11 AS k FROM cls) WHERE k < 3),
  pfix AS (SELECT seq, uri AS t, CASE seq % 9 WHEN 0 THEN 'remove_property' WHEN 1 THEN 'update_domain' ELSE 'update_range' END AS action FROM prp WHERE seq % 9 < 3)"""


def _corrected(s, d):
    classes, properties = _classes(s, d), _properties(s, d)
    k = F.col("seq") % 11
    fix = classes.where(k < 3).select(F.col("seq").cast("long").alias("seq"), F.when(k == 0, "remove_class").when(k == 1, "remove_subclass").otherwise("unknown").alias("action"), F.col("uri").alias("target_uri"), F.lit(None).cast("string").alias("new_value"))
    p = F.col("seq") % 9
    pfix = properties.where(p < 3).select((F.col("seq") + 10**12).cast("long").alias("seq"), F.when(p == 0, "remove_property").when(p == 1, "update_domain").otherwise("update_range").alias("action"), F.col("uri").alias("target_uri"), F.when(p > 0, "ex:Thing").alias("new_value"))
    return apply_corrections(classes, properties, fix.unionByName(pfix))


@_query(
    _T.rstrip()
    + f""", {_FIXES} SELECT uri, CASE WHEN uri IN (SELECT t FROM fix WHERE action = 'remove_subclass') OR subclass_of IN (SELECT t FROM fix WHERE action = 'remove_class') THEN NULL ELSE subclass_of END AS subclass_of
  FROM cls WHERE uri NOT IN (SELECT t FROM fix WHERE action = 'remove_class')"""
)
def corrected_classes(s, d):
    return _corrected(s, d)[0].select("uri", "subclass_of")


@_query(
    _T.rstrip()
    + f""", {_FIXES} SELECT uri, CASE WHEN uri IN (SELECT t FROM pfix WHERE action = 'update_domain') THEN 'ex:Thing' ELSE domain END AS domain,
  CASE WHEN uri IN (SELECT t FROM pfix WHERE action = 'update_range') THEN 'ex:Thing' ELSE range END AS range FROM prp
  WHERE uri NOT IN (SELECT t FROM pfix WHERE action = 'remove_property') AND domain NOT IN (SELECT t FROM fix WHERE action = 'remove_class') AND range NOT IN (SELECT t FROM fix WHERE action = 'remove_class')"""
)
def corrected_properties(s, d):
    return _corrected(s, d)[1].select("uri", "domain", "range")


# A-Box


@_query(f"WITH {_CLASSES} SELECT entity_key, id, class_uri FROM entities WHERE class_uri IN (SELECT uri FROM cls)")
def closed_world_entities(s, d):
    return abox.known_entities(table(s, d, "entities"), _classes(s, d)).select("entity_key", "id", "class_uri")


@_query(f"WITH {_CLASSES} SELECT entity_key, class_uri FROM entities WHERE NOT coalesce(class_uri IN (SELECT uri FROM cls), FALSE)")
def rejected_entities(s, d):
    return abox.unknown_entities(table(s, d, "entities"), _classes(s, d)).select("entity_key", "class_uri")


@_query(_T + "SELECT rel_id, property_uri FROM relation_mentions WHERE property_uri IN (SELECT uri FROM prp)")
def closed_world_relations(s, d):
    return abox.known_relations(table(s, d, "relation_mentions"), _properties(s, d)).select("rel_id", "property_uri")


@_query(
    _T
    + """SELECT e AS entities, r AS relations, e + r AS skipped FROM (SELECT (SELECT count(*) FROM entities WHERE NOT coalesce(class_uri IN (SELECT uri FROM cls), FALSE)) AS e,
  (SELECT count(*) FROM relation_mentions WHERE NOT coalesce(property_uri IN (SELECT uri FROM prp), FALSE)) AS r)"""
)
def skip_counter(s, d):
    return abox.skipped(table(s, d, "entities"), table(s, d, "relation_mentions"), _classes(s, d), _properties(s, d))


@_query(
    f"""WITH l AS (SELECT {_norm('id')} AS norm, arg_min(id, entity_key) AS leader FROM entities WHERE id IS NOT NULL GROUP BY 1),
  m AS (SELECT DISTINCT doc_id, chunk_ix, id, leader FROM entities e JOIN l ON l.norm = {_norm('e.id')} WHERE id IS NOT NULL)
  SELECT rel_id, coalesce(a.leader, source_id) AS source_id, coalesce(b.leader, target_id) AS target_id FROM relation_mentions r
  LEFT JOIN m a ON a.doc_id = r.doc_id AND a.chunk_ix = r.chunk_ix AND a.id = r.source_id LEFT JOIN m b ON b.doc_id = r.doc_id AND b.chunk_ix = r.chunk_ix AND b.id = r.target_id"""
)
def id_remap(s, d):
    e = table(s, d, "entities")
    return abox.remap_relations(table(s, d, "relation_mentions"), e, abox.exact_leaders(e)).select("rel_id", "source_id", "target_id")


@_query("SELECT source_id, property_uri, target_id, evidence_span, min(rel_id) AS rel_id FROM relation_mentions GROUP BY ALL")
def relation_dedup(s, d):
    return abox.distinct_relations(table(s, d, "relation_mentions"), "rel_id")


@_query("SELECT DISTINCT source_id, property_uri, target_id FROM relation_mentions")
def triple_set(s, d):
    return abox.triples(table(s, d, "relation_mentions"))


@_query(
    """SELECT rel_id, source_id, form FROM (SELECT rel_id, source_id, doc_id, evidence_span, 'stated' AS form FROM relation_mentions UNION ALL SELECT rel_id, source_id, doc_id, upper(evidence_span), 'upper' FROM relation_mentions) r
  JOIN documents USING (doc_id) WHERE evidence_span IS NOT NULL AND NOT contains(text, evidence_span)"""
)
def evidence_check(s, d):
    """Relations whose evidence isn't a part of their document's text, as stated and, as all of that is, in upper case."""
    docs = table(s, d, "documents").select("doc_id", "text")
    rels = table(s, d, "relation_mentions").where("evidence_span is not null").select("rel_id", "source_id", "doc_id", "evidence_span", F.lit("stated").alias("form"))
    both = rels.unionByName(rels.withColumn("evidence_span", F.upper("evidence_span")).withColumn("form", F.lit("upper")))
    return both.join(docs, "doc_id").where(~F.contains("text", "evidence_span")).select("rel_id", "source_id", "form")


@_query(
    _T
    + """, t AS (SELECT DISTINCT id, class_uri FROM entities WHERE id IS NOT NULL AND class_uri IS NOT NULL)
  SELECT rel_id, source_id, domain FROM relation_mentions r JOIN prp p ON p.uri = r.property_uri WHERE domain NOT IN ('owl:Thing', 'ex:Thing', 'rdfs:Literal')
  AND source_id IN (SELECT id FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE t.id = source_id AND t.class_uri = domain)"""
)
def domain_typecheck(s, d):
    return abox.type_violations(table(s, d, "relation_mentions"), table(s, d, "entities"), _properties(s, d))


@_query(
    _T
    + """SELECT DISTINCT id, class_uri FROM (SELECT id, class_uri FROM entities WHERE id IS NOT NULL AND class_uri IS NOT NULL
  UNION ALL SELECT source_id, domain FROM relation_mentions JOIN prp ON prp.uri = property_uri WHERE source_id IS NOT NULL AND domain IS NOT NULL
  UNION ALL SELECT target_id, range FROM relation_mentions JOIN prp ON prp.uri = property_uri WHERE target_id IS NOT NULL AND range NOT LIKE 'xsd:%')"""
)
def inferred_types(s, d):
    return validation.inferred_types(table(s, d, "entities"), table(s, d, "relation_mentions"), _properties(s, d))


_NOUNS = "acid alloy array basin buffer cell complex enzyme filter ligand membrane mooring oxide peptide reactor residue resin rotor sensor strain turbine vessel".split()


@_query()
def knowledge_graph(s, d):
    """The flagship: documents to a deduplicated knowledge graph, counted per class."""
    nouns = {n: f"ex:{n.title()}" for n in _NOUNS}
    classes = s.createDataFrame([(c,) for c in nouns.values() if c != "ex:Complex"], "uri string")
    properties = s.createDataFrame([("ex:comparedWith",)], "uri string")
    kg = populate(table(s, d, "documents"), classes, properties, RuleBackend(nouns))
    per = kg["typed"].groupBy("class_uri").agg(F.count(F.lit(1)).alias("n_entities"))
    typed = kg["typed"].select(F.col("id").alias("source_id"), "class_uri")
    by_source = kg["relations"].groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    rels = by_source.join(typed, "source_id").groupBy("class_uri").agg(F.sum("n").alias("n_relations"))
    return per.join(rels, "class_uri", "left").select("class_uri", "n_entities", F.coalesce("n_relations", F.lit(0)).alias("n_relations"), kg["skipped"].select("skipped").scalar().alias("n_skipped"))


# export and reports

_PFX = "CASE WHEN regexp_matches({0}, '^(ex|xsd|rdfs|owl|bfo):') THEN {0} ELSE 'ex:' || {0} END"
_ESC = "replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' ')"
_SAFE = "regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9_]', '_', 'g'), '^ex_', '')"


@_query(
    _T
    + f""", c AS (SELECT seq, list_filter([{_PFX.format("uri")} || ' rdf:type owl:Class ;', '    rdfs:subClassOf ' || nullif(bfo_parent, '') || ' ;',
    '    rdfs:subClassOf ' || {_PFX.format("nullif(subclass_of, '')")} || ' ;', '    skos:definition "' || {_ESC.format("nullif(aristotelian_definition, '')")} || '" ;',
    '    rdfs:comment "' || {_ESC.format("coalesce(comment, '')")} || '" .'], lambda x: x IS NOT NULL) AS l FROM cls),
  p AS (SELECT seq, [{_PFX.format("uri")} || ' rdf:type ' || CASE WHEN range LIKE 'xsd:%' THEN 'owl:DatatypeProperty' ELSE 'owl:ObjectProperty' END || ' ;',
    '    rdfs:domain ' || {_PFX.format("domain")} || ' ;', '    rdfs:range ' || {_PFX.format("range")} || ' ;', '    rdfs:comment "' || {_ESC.format("coalesce(comment, '')")} || '" .'] AS l FROM prp),
  i AS (SELECT entity_key AS seq, ['ex:' || {_SAFE.format("id")} || ' rdf:type ' || {_PFX.format("coalesce(class_uri, 'owl:Thing')")} || ' ;', '    rdfs:label "' || {_ESC.format("id")} || '" .'] AS l FROM entities WHERE id IS NOT NULL),
  r AS (SELECT rel_id AS seq, ['ex:' || {_SAFE.format("source_id")} || ' ' || {_PFX.format("property_uri")} || ' ex:' || {_SAFE.format("target_id")} || ' .'] AS l FROM relation_mentions
    WHERE source_id IS NOT NULL AND property_uri IS NOT NULL AND target_id IS NOT NULL),
  h AS (SELECT unnest(range(7)) AS seq, unnest([{", ".join(f"'@prefix {p}: <{u}> .'" for p, u in TURTLE_PREFIXES.items())}]) AS line)
  SELECT 0 AS section, CAST(seq AS BIGINT) AS seq, 0 AS part, line FROM h
  UNION ALL SELECT section, CAST(seq AS BIGINT), CAST(k - 1 AS INT), l[k] FROM (SELECT section, seq, l, unnest(range(1, len(l) + 1)) AS k FROM (
    SELECT 1 AS section, seq, l FROM c UNION ALL SELECT 2, seq, l FROM p UNION ALL SELECT 3, seq, l FROM i UNION ALL SELECT 4, seq, l FROM r))"""
)
def turtle_lines(s, d):
    return turtle.export(
        turtle.class_lines(_classes(s, d)), turtle.property_lines(_properties(s, d)),
        turtle.instance_lines(table(s, d, "entities"), "entity_key"), turtle.relation_lines(table(s, d, "relation_mentions"), "rel_id"),
    )


def _jac(t: str, m: str, name: str) -> str:
    return f"""{name} AS (SELECT p.prev_run, p.run, CASE WHEN count(m) = 0 THEN 1.0 ELSE count(*) FILTER (m IS NOT NULL AND n = 2) * 1.0 / count(m) END AS s FROM pairs p
  LEFT JOIN (SELECT prev_run, run, m, count(*) AS n FROM (SELECT DISTINCT p.prev_run, p.run, t.run AS r, {m} AS m FROM pairs p JOIN {t} t ON t.run IN (p.prev_run, p.run)) GROUP BY ALL) x
  ON x.prev_run = p.prev_run AND x.run = p.run GROUP BY ALL)"""


@_query(
    f"""WITH runs AS (SELECT run FROM state_classes UNION SELECT run FROM state_properties UNION SELECT run FROM state_relations),
  pairs AS (SELECT * FROM (SELECT lag(run) OVER (ORDER BY TRY_CAST(split_part(run, '_', 2) AS INT), run) AS prev_run, run FROM runs WHERE run IS NOT NULL) WHERE prev_run IS NOT NULL),
  {_jac("state_classes", "t.uri", "c")}, {_jac("state_properties", "t.uri", "p")},
  {_jac("state_relations", "concat_ws(chr(1), coalesce(t.source_id, chr(2)), coalesce(t.property_uri, chr(2)), coalesce(t.target_id, chr(2)))", "r")}
  SELECT prev_run, run, round(c.s, 9) AS classes_similarity, round(p.s, 9) AS properties_similarity, round(r.s, 9) AS triples_similarity,
    CASE WHEN r.s >= 0.7 AND c.s >= 0.7 THEN 'STABLE' ELSE 'DIVERGENT' END AS verdict FROM c JOIN p USING (prev_run, run) JOIN r USING (prev_run, run)"""
)
def run_stability(s, d):
    out = report.stability(*[table(s, d, f"state_{x}") for x in ("classes", "properties", "relations")])
    return out.select("prev_run", "run", *[F.round(f"{x}_similarity", 9).alias(f"{x}_similarity") for x in ("classes", "properties", "triples")], "verdict")


@_query(
    """SELECT id, max(class_uri) AS class_uri, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT id, min(class_uri) AS class_uri, 0 AS o, 0 AS i FROM entities WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT source_id, NULL, count(*), 0 FROM relation_mentions WHERE source_id IS NOT NULL GROUP BY 1 UNION ALL SELECT target_id, NULL, 0, count(*) FROM relation_mentions WHERE target_id IS NOT NULL GROUP BY 1) GROUP BY id"""
)
def graph_nodes(s, d):
    return report.graph_nodes(table(s, d, "entities"), table(s, d, "relation_mentions"))


@_query("SELECT source_id, target_id, split_part(arg_max(property_uri, rel_id), ':', -1) AS label FROM relation_mentions WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2")
def graph_edges(s, d):
    return report.graph_edges(table(s, d, "relation_mentions"), "rel_id")


@_query("SELECT DISTINCT run, coalesce(TRY_CAST(split_part(run, '_', 2) AS INT), 0) AS no FROM state_classes")
def run_listing(s, d):
    return table(s, d, "state_classes").select("run").distinct().withColumn("no", report.run_number(F.col("run")))


_CL = """'- ' || uri || ' (BFO: ' || coalesce(bfo_parent, 'bfo:Entity') || ')' || CASE WHEN coalesce(subclass_of, '') <> '' THEN ' subClassOf ' || subclass_of ELSE '' END || ': ' || coalesce(aristotelian_definition, comment, '')"""


@_query(f"WITH {_CLASSES} SELECT seq, {_CL} AS line FROM cls")
def class_prompt_lines(s, d):
    return prompts.class_lines(_classes(s, d))


@_query(_T + "SELECT CAST(seq // 1000 AS BIGINT) AS page, string_agg('- ' || uri || ' (domain: ' || coalesce(domain, '') || ', range: ' || coalesce(range, '') || '): ' || coalesce(comment, ''), chr(10) ORDER BY seq) AS prompt FROM prp GROUP BY 1")
def properties_prompt(s, d):
    return prompts.properties_prompt(_properties(s, d))


@_query("SELECT entity_key AS seq, '- ' || id || ' (type: ' || coalesce(class_uri, '') || ')' AS line FROM entities WHERE id IS NOT NULL")
def entity_prompt_lines(s, d):
    return prompts.entity_lines(table(s, d, "entities"), "entity_key")


@_query("SELECT CAST(item_id - 1 AS BIGINT) AS seq, '  ' || item_id || '. [' || lang || '] ' || text AS line FROM eval_items")
def question_prompt_lines(s, d):
    q = table(s, d, "eval_items").select((F.col("item_id") - 1).alias("pos"), F.col("text").alias("question"), F.col("lang").alias("scope"))
    return prompts.question_lines(q)


# quotas


@_query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n_window FROM events")
def rate_window_60s(s, d):
    return limiter.sliding_count(table(s, d, "events"), "user_id", "ts").select("event_id", "n_window")


@_query("SELECT CAST(ts AS DATE) AS day, count(*) AS n_requests FROM events WHERE ts IS NOT NULL GROUP BY 1")
def daily_quota(s, d):
    return limiter.daily_count(table(s, d, "events"), "ts")


@_query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_requests, greatest(count(*) - 18, 0) AS n_denied FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def over_quota(s, d):
    return limiter.over_quota(table(s, d, "events"), "user_id", "ts", EngineConf())


@_query()
def request_schedule(s, d):
    return limiter.schedule(table(s, d, "events"), "user_id", "ts", "event_id", EngineConf())


@_query(
    """WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, count(*) FILTER (ts >= now - INTERVAL 60 SECOND) AS in_window, count(*) FILTER (CAST(ts AS DATE) = CAST(now AS DATE)) AS today,
  count(*) FILTER (ts >= now - INTERVAL 60 SECOND) < 8 AND count(*) FILTER (CAST(ts AS DATE) = CAST(now AS DATE)) < 18 AS can_proceed
  FROM events, n WHERE ts <= now AND CAST(ts AS DATE) >= CAST(now AS DATE) - 1 GROUP BY user_id"""
)
def rate_status(s, d):
    """State of every limiter at the time of the last event."""
    e = table(s, d, "events")
    return limiter.status(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), EngineConf())


@_query()
def streaming_schedule(s, d):
    return quota.drain(quota.admissions(quota.event_stream(s, d), "user_id", "event_id", EngineConf()), "append")


@_query("SELECT CAST(ts AS DATE) AS day, count(*) AS n_requests FROM events WHERE ts IS NOT NULL GROUP BY 1")
def streaming_daily_quota(s, d):
    return quota.drain(quota.daily(quota.event_stream(s, d)))
