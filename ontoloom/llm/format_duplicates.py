"""Duplicates hidden by formatting differences: Merkle-style digests of normalised nested records."""

from __future__ import annotations

import ast
import json
import unicodedata
from decimal import Decimal
from hashlib import blake2b

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import HOT_SHARE, checkpoint, lookup

#: Everything but letters, figures and the marks that belong to letters (not the selectors of a glyph's variant).
_NOT_ALNUM = regex.compile(r"[^\p{L}\p{N}\p{M}]|[\uFE00-\uFE0F\u20E3]")


def leaf(value: object) -> str:
    """A leaf without case, white space, punctuation and symbols; letters with accents or vowel signs and other scripts stay.

    A number is written in one way, with its sign and point, which are no punctuation there; a whole one equals its figures as text.
    """
    if value is None:
        return "\x00"
    if isinstance(value, int | float | Decimal) and not isinstance(value, bool):
        number = Decimal(str(value))
        return format(number.normalize() + 0, "f") if number.is_finite() and abs(number.adjusted()) < 400 else str(number)
    text = value if isinstance(value, str) else json.dumps(value)
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFC", text).casefold().replace("ς", "σ"))


def merkle(value: object) -> tuple[bytes, str]:
    """Digest and canonical form of a nested record, bottom up.

    Objects are unordered: their children's digests are sorted, field names are normalised like leaves.
    Arrays keep their order. A null leaf differs from an empty one; a missing field from both.
    """
    if isinstance(value, dict):
        nodes = sorted((blake2b(leaf(k).encode() + b"\x01" + d, digest_size=16).digest(), f"{leaf(k)}:{c}") for k, (d, c) in ((k, merkle(v)) for k, v in value.items()))
        return blake2b(b"\x02" + b"".join(d for d, _ in nodes), digest_size=16).digest(), "{" + ",".join(c for _, c in nodes) + "}"
    if isinstance(value, list | tuple):
        nodes = [merkle(v) for v in value]
        return blake2b(b"\x03" + b"".join(d for d, _ in nodes), digest_size=16).digest(), "[" + ",".join(c for _, c in nodes) + "]"
    text = leaf(value)
    return blake2b(b"\x04" + text.encode(), digest_size=16).digest(), text


def parse_record(payload: str) -> object:
    """A JSON record, or one written like JSON with single quotes and Python constants; else the text itself as a leaf."""
    try:
        return json.loads(payload, strict=False, parse_float=Decimal)
    except ValueError:
        pass
    try:
        value = ast.literal_eval(payload.strip())
        return value if isinstance(value, dict | list) else payload
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return payload


def _payload_digest(kind: pd.Series, payload: pd.Series) -> pd.DataFrame:
    rows = []
    for k, p in zip(kind, payload, strict=True):
        # kind is a leaf of the record like any other
        rows.append((None, None) if p is None else merkle([k, parse_record(p)]))
    return pd.DataFrame(rows, columns=["root", "canon"])


def _compose(text: pd.Series) -> pd.Series:
    return text.map(leaf, na_action="ignore")


#: Combining marks, parts of Hangul syllables, and letters that folding case turns into several or into others: text with them takes the Python way.
_SPECIAL = r"[\p{M}\x{1100}-\x{11FF}\x{A960}-\x{A97C}\x{D7B0}-\x{D7FB}\x{DF}\x{130}\x{149}\x{17F}\x{1F0}\x{345}\x{390}\x{3B0}\x{587}\x{1E96}-\x{1E9E}\x{1F50}-\x{1FFC}\x{13A0}-\x{13FD}\x{AB70}-\x{ABBF}\x{FB00}-\x{FB17}\x{212A}\x{212B}\x{2126}]"


def canonical(text: Column) -> Column:
    """The leaf form of text without special letters, without leaving the JVM."""
    return F.translate(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", ""), "ς", "σ")


def text_records(df: DataFrame, record_table: str, key: str, field: str) -> DataFrame:
    """Records of one text field: record_table, key, root (digest), canon. Null fields and keys make no record.

    Text with combining marks or letters of special case folding is normalised in Python; all other text stays in the JVM.
    """
    rows = df.where(F.col(field).isNotNull() & F.col(key).isNotNull()).select(F.lit(record_table).alias("record_table"), F.col(key).cast("long").alias("key"), F.col(field).alias("text"))
    marked = F.col("text").rlike(_SPECIAL)
    plain = rows.where(~marked).select("record_table", "key", canonical(F.col("text")).alias("canon"))
    other = rows.where(marked).select("record_table", "key", F.pandas_udf(_compose, "string")("text").alias("canon"))
    return plain.unionByName(other).select("record_table", "key", F.unhex(F.md5(F.concat_ws("\x00", "record_table", "canon"))).alias("root"), "canon")


def nested_records(df: DataFrame, record_table: str, key: str, kind: str, payload: str) -> DataFrame:
    """Records of a payload column together with its kind. Null payloads and keys make no record."""
    rows = df.where(F.col(payload).isNotNull() & F.col(key).isNotNull())
    hashed = rows.select(F.lit(record_table).alias("record_table"), F.col(key).cast("long").alias("key"), F.pandas_udf(_payload_digest, "root binary, canon string")(F.col(kind), F.col(payload)).alias("m"))
    return hashed.select("record_table", "key", F.unhex(F.md5(F.concat_ws("\x00", "record_table", F.hex("m.root")))).alias("root"), "m.canon")


def collapse(records: DataFrame) -> DataFrame:
    """One row per distinct record: record_table, root, canon, kept_key (smallest), copies (number of rows).

    Rows are grouped by root digest and, within it, by the whole canonical structure, so a digest shared by
    different records merges nothing. Counting combines on the map side, whatever share one record holds.
    """
    return records.groupBy("record_table", "root", "canon").agg(F.min("key").alias("kept_key"), F.count(F.lit(1)).alias("copies"))


def copies(records: DataFrame) -> DataFrame:
    """(record_table, kept_key, copy_key) for every row that isn't the smallest key of its record. No copies: no rows."""
    records = checkpoint(records.select("record_table", F.concat("root", F.encode("canon", "utf-8")).alias("id"), "key"))
    # an id is the digest with the whole structure behind it, so a digest shared by different records joins nothing
    groups = checkpoint(records.groupBy("id").agg(F.min("key").alias("kept_key"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    hot = groups.where((F.col("copies") * HOT_SHARE >= groups.agg(F.sum("copies")).scalar()) & (F.col("copies") >= 1000)).select("id")
    found = lookup(records.withColumnRenamed("key", "copy_key"), groups.select("id", "kept_key"), "id", "inner", hot)
    return found.where(F.col("copy_key") != F.col("kept_key")).select("record_table", "kept_key", "copy_key").distinct()
