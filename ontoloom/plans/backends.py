"""Extraction as a table function from text to rows: replay of recorded answers, and deterministic rules."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.json_repair import extract, normalize
from ontoloom.runtime import checkpoint, spread

MENTIONS = "doc_id bigint, chunk_ix int, pos int, id string, class_uri string, evidence_span string"
RELATIONS = "doc_id bigint, chunk_ix int, pos int, source_id string, property_uri string, target_id string, evidence_span string"
FOUND = "doc_id bigint, chunk_ix int, nr int, related boolean, pos int, id string, kind string, target_id string, evidence_span string"

_SENTENCE = re.compile(r"[^.!?]+[.!?]?")


class ExtractorBackend(Protocol):
    """Anything that turns chunks (doc_id, chunk_ix, text) into entity and relation mentions."""

    def entities(self, chunks: DataFrame) -> DataFrame: ...

    def relations(self, chunks: DataFrame) -> DataFrame: ...


def cache_key(prompt: str, **arguments: str) -> str:
    """The key under which an answer is recorded: the digest of prompt and arguments, names sorted."""
    body = json.dumps({"prompt": prompt, "kwargs": arguments}, sort_keys=True, ensure_ascii=False)
    return hashlib.md5(body.encode()).hexdigest()


def both(backend: ExtractorBackend, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relation mentions of chunks as tables that can be read again: from one pass where the backend has `both`."""
    if hasattr(backend, "both"):
        return backend.both(chunks)
    chunks = checkpoint(chunks, release=True)
    return checkpoint(backend.entities(chunks), release=True), checkpoint(backend.relations(chunks), release=True)


class ReplayBackend:
    """Recorded answers: a table (prefix, key, payload) joined to requests (prefix, key, ...); what isn't recorded gives no rows."""

    def __init__(self, cache: DataFrame, prompt: Callable[[str], str] = str, prefix: str = "extract") -> None:
        """prompt: from the text of a chunk to the request under whose key its answer was recorded with that prefix."""
        self.cache, self.prompt, self.prefix = cache, prompt, prefix

    def answers(self, requests: DataFrame, kind: str) -> DataFrame:
        """Requests with `answer`, the normalised JSON of their recorded payload as text."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [json.dumps(normalize(extract(p or ""), kind), ensure_ascii=False) for p in b["payload"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["prefix"], b["key"], pa.array(out, pa.string())], ["prefix", "key", "answer"])

        hit = requests.select("prefix", "key").distinct().join(self.cache.select("prefix", "key", "payload"), ["prefix", "key"])
        return requests.join(hit.mapInArrow(read, "prefix string, key string, answer string"), ["prefix", "key"])


    def requests(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the prefix and key of their request."""
        prompt = self.prompt
        keyed = F.pandas_udf(lambda texts: texts.map(lambda t: cache_key(prompt(t)), na_action="ignore"), "string")
        return chunks.select("doc_id", "chunk_ix", F.lit(self.prefix).alias("prefix"), keyed("text").alias("key"))

    def _items(self, chunks: DataFrame, kind: str, schema: str) -> DataFrame:
        fields = [x.split()[0] for x in schema.split(", ")[3:]]
        of = ", ".join(f"{f}: string" for f in fields)
        answers = self.answers(self.requests(chunks), kind).withColumn("a", F.from_json("answer", f"struct<{kind}: array<struct<{of}>>>"))
        return answers.select("doc_id", "chunk_ix", F.posexplode(f"a.{kind}").alias("pos", "x")).select("doc_id", "chunk_ix", "pos", *[F.col(f"x.{f}").alias(f) for f in fields])

    def entities(self, chunks: DataFrame) -> DataFrame:
        return self._items(chunks, "entities", MENTIONS)

    def relations(self, chunks: DataFrame) -> DataFrame:
        return self._items(chunks, "relations", RELATIONS)


class RuleBackend:
    """Names of two words and a head noun as entities of the noun's class; neighbours in a sentence as related.

    nouns: head noun to class uri. Lower-case letters of any script count; an id is the name with underscores.
    """

    def __init__(self, nouns: dict[str, str], relation: str = "ex:comparedWith") -> None:
        self.nouns, self.relation = nouns, relation
        self.name = re.compile(rf"\b([^\W\d_]+) ([^\W\d_]+) ({'|'.join(sorted(map(re.escape, nouns), key=len, reverse=True))})\b")

    def _found(self, text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        for s in _SENTENCE.findall(text):
            names = [("_".join(m.groups()).lower(), self.nouns[m.group(3)]) for m in self.name.finditer(s)]
            if names:
                yield s.strip(), names

    def _run(self, chunks: DataFrame, schema: str, rows: Callable[[str], Iterator[tuple]]) -> DataFrame:
        fields = [x.strip().split()[0] for x in schema.split(",")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        types = [kinds[x.strip().split()[1]] for x in schema.split(",")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a part of a batch at a time: a chunk has many rows
            for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
                out = [(d, c, i, *r) for d, c, t in zip(b["doc_id"].to_pylist(), b["chunk_ix"].to_pylist(), b["text"].to_pylist(), strict=True) if t for i, r in enumerate(rows(t))]
                cols = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], fields)

        return spread(chunks.select("doc_id", "chunk_ix", "text"), "doc_id").mapInArrow(run, schema)

    def entities(self, chunks: DataFrame) -> DataFrame:
        return self._run(chunks, MENTIONS, lambda t: ((n, c, s) for s, names in self._found(t) for n, c in names))

    def relations(self, chunks: DataFrame) -> DataFrame:
        return self._run(chunks, RELATIONS, lambda t: (r for s, names in self._found(t) for r in self._related(s, names)))

    def _related(self, sentence: str, names: list[tuple[str, str]]) -> Iterator[tuple]:
        for (a, _), (b, _) in zip(names, names[1:], strict=False):
            if a != b:
                yield a, self.relation, b, sentence

    def both(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of entities and of relations, by one pass over the text."""

        def rows(t: str) -> Iterator[tuple]:
            n = m = 0
            for s, names in self._found(t):
                for name, c in names:
                    yield False, n, name, c, None, s
                    n += 1
                for a, p, b, _ in self._related(s, names):
                    yield True, m, a, p, b, s
                    m += 1

        found = checkpoint(self._run(chunks, FOUND, rows), release=True)
        at = ["doc_id", "chunk_ix", "pos"]
        return (
            found.where("not related").select(*at, "id", F.col("kind").alias("class_uri"), "evidence_span"),
            found.where("related").select(*at, F.col("id").alias("source_id"), F.col("kind").alias("property_uri"), "target_id", "evidence_span"),
        )


def with_retry(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of a backend call, tried again after a wait that depends on the error; the last error is raised."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            text = str(e)
            if n == attempts:
                raise
            quota, busy = any(x in text for x in ("429", "Quota", "RESOURCE_EXHAUSTED")), any(x in text for x in ("503", "overloaded"))
            sleep(60 if quota else 30 if busy else 5 * n)
    raise AssertionError("attempts must be positive")


def batches_of(chunks: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, batch_ix, text): `size` consecutive chunks of a document joined by empty lines."""
    grouped = chunks.groupBy("doc_id", F.floor(F.col("chunk_ix") / size).cast("int").alias("batch_ix"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_ix", "text")))  # at most `size` of them
    return grouped.agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))
