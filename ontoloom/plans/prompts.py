"""Tables as the text that goes into prompts, one line per row in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Lines to a prompt; more lines make more prompts.
PAGE = 1000


def _joined(lines: DataFrame, empty: str) -> DataFrame:
    """(page, prompt): the lines (seq, line) in order, in pages by seq of at most PAGE lines; one page `empty` if there are none.

    seq is a unique number, so a page is bounded and no task holds all lines.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    pages = lines.groupBy(F.floor(F.col("seq") / PAGE).cast("long").alias("page")).agg(text.alias("prompt"))
    none = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("page"), F.lit(empty).alias("prompt"))
    return pages.unionByName(none)


def class_lines(classes: DataFrame) -> DataFrame:
    """(seq, line) of classes with category, parent and definition."""
    sub = F.when(F.coalesce("subclass_of", F.lit("")) != "", F.concat(F.lit(" subClassOf "), F.col("subclass_of"))).otherwise("")
    return classes.select("seq", F.concat(F.lit("- "), "uri", F.lit(" (BFO: "), F.coalesce("bfo_parent", F.lit("bfo:Entity")), F.lit(")"), sub, F.lit(": "), F.coalesce("aristotelian_definition", "comment", F.lit(""))).alias("line"))


def property_lines(properties: DataFrame) -> DataFrame:
    return properties.select("seq", F.concat(F.lit("- "), "uri", F.lit(" (domain: "), F.coalesce("domain", F.lit("")), F.lit(", range: "), F.coalesce("range", F.lit("")), F.lit("): "), F.coalesce("comment", F.lit(""))).alias("line"))


def entity_lines(entities: DataFrame, seq: str) -> DataFrame:
    return entities.where("id is not null").select(F.col(seq).alias("seq"), F.concat(F.lit("- "), "id", F.lit(" (type: "), F.coalesce("class_uri", F.lit("")), F.lit(")")).alias("line"))


def question_lines(questions: DataFrame) -> DataFrame:
    """(seq, line) of competency questions (pos from 0, question, scope), numbered from 1."""
    return questions.select(F.col("pos").alias("seq"), F.format_string("  %d. [%s] %s", F.col("pos") + 1, F.col("scope"), F.col("question")).alias("line"))


def classes_prompt(classes: DataFrame) -> DataFrame:
    return _joined(class_lines(classes), "(none)")


def properties_prompt(properties: DataFrame) -> DataFrame:
    return _joined(property_lines(properties), "(none)")


def entities_prompt(entities: DataFrame, seq: str) -> DataFrame:
    return _joined(entity_lines(entities, seq), "None yet.")


def questions_prompt(questions: DataFrame) -> DataFrame:
    return _joined(question_lines(questions), "(no competency questions generated)")


def errors_prompt(findings: DataFrame) -> DataFrame:
    """(page, prompt) of findings (severity, message), errors first and numbered within severity and page.

    Findings are dealt to as many pages of about PAGE as they need by the hash of their message.
    """
    from pyspark.sql import Window

    pages = max(1, -(-findings.count() // PAGE))
    w = Window.partitionBy("page", "severity").orderBy("message")
    dealt = findings.select("severity", "message", F.pmod(F.xxhash64("message"), F.lit(pages)).alias("page"))
    lines = dealt.withColumn("n", F.row_number().over(w)).select("page", "severity", "n", F.format_string("%s %d: %s", "severity", "n", "message").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("severity", "n", "line")))
    out = lines.groupBy("page").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"))
    none = findings.agg(F.count(F.lit(1)).alias("k")).where("k = 0").select(F.lit(0).cast("long").alias("page"), F.lit("No errors detected.").alias("prompt"))
    return out.unionByName(none)


def bfo_prompt(categories: DataFrame) -> DataFrame:
    """One row: the leaf categories of the upper ontology, a fixed short list, by name."""
    line = F.concat(F.lit("- "), "cat", F.lit(" < "), F.coalesce("parent", F.lit("")))
    return categories.where("is_leaf").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("prompt"))
