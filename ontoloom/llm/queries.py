"""Queries of the problems on text corpora (1, 2, 4, 6, 8, 9 and 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import format_duplicates, leakage, mixing, spam_pages, splitting, term_mapping, truncation
from ontoloom.runtime import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return (
        format_duplicates.text_records(table(spark, d, "entities"), "entities", "entity_key", "id")
        .unionByName(format_duplicates.text_records(table(spark, d, "ontology_classes"), "ontology_classes", "class_row_id", "uri"))
        .unionByName(format_duplicates.nested_records(table(spark, d, "raw_records"), "raw_records", "record_id", "kind", "payload"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row that repeats an earlier record in other writing, with the smallest key of that record."""
    return format_duplicates.copies(_records(spark, d))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return format_duplicates.collapse(_records(spark, d)).select("record_table", "kept_key", "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that come out in more than one piece."""
    pieces = splitting.split_documents(table(spark, d, "documents"), table(spark, d, "chunk_settings"), with_text=False)
    return pieces.where("piece_ix = 1").select("doc_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized document."""
    return splitting.split_documents(table(spark, d, "documents"), table(spark, d, "chunk_settings"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized document put together again from its pieces, with the pieces that break a limit."""
    docs, settings = table(spark, d, "documents"), table(spark, d, "chunk_settings")
    pieces = splitting.split_documents(docs, settings)
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_ix", "begin", "end", "piece"))).alias("p"))  # no more than a text
    # fresh text of each piece: what lies behind the end of the piece before
    ends = F.transform("p", lambda x, i: F.when(i == 0, 0).otherwise(F.get("p", i - 1)["end"]))
    fresh = F.zip_with("p", ends, lambda x, e: F.substring(x["piece"], e - x["begin"] + 1, 2147483647))
    shared = F.zip_with("p", ends, lambda x, e: e - x["begin"])
    rest = settings.where("source = '*'").select(F.struct("chunk_size", "chunk_overlap").alias("_d"))
    own = settings.where("source <> '*'").select(F.col("source").alias("_s"), "chunk_size", "chunk_overlap")
    limits = docs.select("doc_id", "source").join(own, F.col("source") == F.col("_s"), "left").withColumn("_d", rest.scalar())
    limits = limits.select("doc_id", F.coalesce("chunk_size", "_d.chunk_size").alias("size"), F.coalesce("chunk_overlap", "_d.chunk_overlap").alias("overlap"))
    return whole.join(limits, "doc_id").select(
        "doc_id",
        F.md5(F.array_join(fresh, "")).alias("text_md5"),
        F.size(F.filter("p", lambda x: (F.char_length(x["piece"]) > F.col("size")) | (F.char_length(x["piece"]) != x["end"] - x["begin"]))).cast("long").alias("n_too_long"),
        F.size(F.filter(shared, lambda x: (x > F.col("overlap")) | (x < 0))).cast("long").alias("n_wrong_overlap"),
        F.exists("p", lambda x: x["begin"] > 0).alias("is_split"),
    )


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    bfo, terms = table(spark, d, "bfo_categories"), table(spark, d, "term_reference")
    parts = []
    for name, key, field, ref, exact in (
        ("ontology_classes", "class_row_id", "bfo_parent", bfo.select(F.col("cat").alias("uri"), F.regexp_replace("cat", "^bfo:", "").alias("label"), "short_form"), bfo.select(F.col("cat").alias("value"))),
        ("canonical_terms", "term_id", "term", terms.select("uri", "label", "short_form"), terms.select(F.col("label").alias("value")).unionByName(terms.where("short_form is not null").select(F.col("short_form").alias("value")))),
    ):
        rows = table(spark, d, name).select(F.col(key).cast("long").alias("row_key"), F.col(field).alias("value")).where("value is not null")
        open_ = rows.join(exact.distinct(), "value", "left_anti")
        parts.append(term_mapping.apply_mapping(open_, term_mapping.map_values(open_, ref)).select(F.lit(name).alias("value_table"), "row_key", "value", "matched_uri"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry meant by every value that isn't one exactly, or UNMATCHED."""
    return _mapping(spark, d).select("value_table", "row_key", "matched_uri")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry and the number of rows that have them."""
    return _mapping(spark, d).where("matched_uri = 'UNMATCHED'").groupBy("value_table", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ontology_classes")
    values = [rows.select(F.col("class_row_id").alias("row_key"), "source", F.lit(f).alias("field"), F.lit(None).cast("string").alias("lang"), F.col(f).alias("text")) for f in ("aristotelian_definition", "comment")]
    return truncation.truncated(values[0].unionByName(values[1]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that were cut before their end."""
    return _cut(spark, d).where("is_cut").select(F.col("row_key").alias("class_row_id"), "field")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of values that were cut, per source and field."""
    n_cut = F.count(F.when(F.col("is_cut"), 1))
    return _cut(spark, d).groupBy("source", "field").agg(F.count(F.lit(1)).alias("n_values"), n_cut.alias("n_cut"), F.round(n_cut / F.count(F.lit(1)), 6).alias("cut_rate"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items with the number of documents that carry them and the largest share carried."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max(F.round(F.col("n_carried") / F.col("n_words"), 6)).alias("most_carried"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: how often each document is taken."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Actual against target shares of the mix."""
    return mixing.report(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages most of whose text is repeated keywords, links or tags."""
    return spam_pages.spam_pages(table(spark, d, "documents")).select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of such pages per source."""
    docs = table(spark, d, "documents")
    scored = spam_pages.score_pages(docs).join(docs.select("doc_id", "source"), "doc_id")
    n_spam = F.count(F.when(F.col("share") > spam_pages.SHARE, 1))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), n_spam.alias("n_spam"), F.round(n_spam / F.count(F.lit(1)), 6).alias("spam_rate"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_pieces, p2_rebuilt, p4_found, p4_unmatched, p6_found, p6_rates, p8_found, p8_items, p9_mix, p9_report, p10_found, p10_sources)}

SQL = {
    "p2_rebuilt": """SELECT doc_id, md5(text) AS text_md5, 0::BIGINT AS n_too_long, 0::BIGINT AS n_wrong_overlap, true AS is_split
  FROM documents d LEFT JOIN chunk_settings s ON s.source = d.source AND s.source <> '*'
  WHERE length(text) > coalesce(s.chunk_size, (SELECT chunk_size FROM chunk_settings WHERE source = '*'))""",
    "p2_found": """SELECT doc_id FROM documents d LEFT JOIN chunk_settings s ON s.source = d.source AND s.source <> '*'
  WHERE length(text) > coalesce(s.chunk_size, (SELECT chunk_size FROM chunk_settings WHERE source = '*'))""",
}
