"""Sources and sinks: documents, saved states, run archives and the cache of backend answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.splitter import chunk
from ontoloom.functions.text import clean, section_cut
from ontoloom.operators.report import run_number
from ontoloom.runtime import spread

STATE = """approved_classes map<string, struct<comment:string, bfo_parent:string, aristotelian_definition:string, subclass_of:string>>,
  approved_properties map<string, struct<domain:string, range:string, comment:string>>, canonical_terms map<string, string>,
  subclass_relations map<string, string>, entities map<string, struct<class_uri:string, evidence_span:string>>,
  relations array<struct<source_id:string, property_uri:string, target_id:string, evidence_span:string>>"""


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path) of whole text files; a missing path raises Spark's PATH_NOT_FOUND."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return files.withColumn("doc_id", F.xxhash64("path"))


def read_pdf_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path) of PDF files, pages joined by line feeds. Needs a PDF library on the executors; without one it raises ImportError."""

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader  # not everywhere there

        for pdf in batches:
            texts = ["".join((p.extract_text() or "") + "\n" for p in PdfReader(io.BytesIO(c)).pages) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, "path string, text string").withColumn("doc_id", F.xxhash64("path"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists; FileNotFoundError if none does."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(", ".join(paths))


def prepare(docs: DataFrame, size: int = 2500, overlap: int = 200) -> DataFrame:
    """Cut, clean and chunk documents (doc_id, text): doc_id, chunk_ix, text."""
    return chunk(spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", clean(section_cut(F.col("text"))).alias("text")), size, overlap)


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of saved JSON states, with the file as run: classes, properties, canonical_terms, subclass_edges, entities, relations.

    A missing key gives no rows. Class values that are bare comments, as older states have them, come with their comment alone.
    """
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "value")
    s = raw.select("run", "value", F.from_json("value", STATE).alias("s"))
    old = raw.select("run", F.explode(F.from_json(F.get_json_object("value", "$.approved_classes"), "map<string,string>")).alias("uri", "v"))
    classes = old.select("run", "uri", F.from_json("v", "struct<comment:string,bfo_parent:string,aristotelian_definition:string,subclass_of:string>").alias("c"), "v")
    is_struct = F.col("v").startswith("{")
    return {
        "classes": classes.select("run", "uri", F.when(is_struct, F.col("c.comment")).otherwise(F.col("v")).alias("comment"), *[F.when(is_struct, F.col(f"c.{x}")).alias(x) for x in ("bfo_parent", "aristotelian_definition", "subclass_of")]),
        "properties": s.select("run", F.explode("s.approved_properties").alias("uri", "p")).select("run", "uri", "p.*"),
        "canonical_terms": s.select("run", F.explode("s.canonical_terms").alias("term", "uri")),
        "subclass_edges": s.select("run", F.explode("s.subclass_relations").alias("child", "parent")),
        "entities": s.select("run", F.explode("s.entities").alias("id", "e")).select("run", "id", "e.*"),
        "relations": s.select("run", F.inline("s.relations")),
    }


def list_runs(rows: DataFrame) -> DataFrame:
    """(run, no) in numeric order; run_10 comes after run_9."""
    return rows.select("run").distinct().withColumn("no", run_number(F.col("run"))).orderBy("no", "run")


def archive(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Write the tables of one run below root, partitioned by run; a run that exists is replaced alone."""
    for name, df in tables.items():
        df.drop("run").write.mode("overwrite").parquet(f"{root}/{name}/run={run}")


def next_run(spark: SparkSession, root: str, name: str) -> str:
    """The first run_N that the archive doesn't have."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()
    n = 1
    while f"run={f'run_{n}'}" in taken:
        n += 1
    return f"run_{n}"


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (prefix, key, ...) with their cached payload, and those without one. The cache is unique in prefix and key."""
    hits = requests.join(cache.select("prefix", "key", "payload"), ["prefix", "key"])
    return hits, requests.join(cache.select("prefix", "key"), ["prefix", "key"], "left_anti")


def write_state(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Write the tables of one run as JSON lines below root, one folder per table and run; a run that exists is replaced alone."""
    for name, df in tables.items():
        df.drop("run").write.mode("overwrite").json(f"{root}/{name}/run={run}")


def record_answers(answers: DataFrame, path: str) -> None:
    """Append answers (prefix, key, payload) to the cache at path; what is recorded already stays as it is."""
    spark = answers.sparkSession
    named = answers.groupBy("prefix", "key").agg(F.min("payload").alias("payload"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        named = named.join(spark.read.parquet(path).select("prefix", "key"), ["prefix", "key"], "left_anti")
    named.write.mode("append").parquet(path)
