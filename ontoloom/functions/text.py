"""Scalar text functions as column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontoloom.conf import KEPT_PREFIXES

#: White space of Unicode, spelled out because engines disagree about \s.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EDGE = f"^{SPACE}+|{SPACE}+$"

# Page furniture that is deleted from documents.
FURNITURE = (
    r"STM Journals \p{Nd}{4}\. All Rights Reserved",
    rf"©{SPACE}*\p{{Nd}}+(?:{SPACE}*,{SPACE}*\p{{Nd}}+)?",
    r"Volume \p{Nd}+, Issue \p{Nd}+",
    r"ISSN: \p{Nd}{4}-\p{Nd}{4}",
)


def section_cut(text: Column, *markers: str) -> Column:
    """The text before the first occurrence of each marker, taken in turn; case matters."""
    for m in markers or ("REFERENCES", "Acknowledgments"):
        text = F.substring_index(text, m, 1)
    return text


def clean(text: Column) -> Column:
    """Text without page furniture, white space collapsed and trimmed."""
    for pattern in FURNITURE:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def normalize_id(value: Column) -> Column:
    """Lower case without separators and without one trailing s."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), rf"(?:[_\-]|{SPACE})+", ""), "s$", "")


def bigrams(value: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for fewer than two characters."""
    n = F.char_length(value)
    return F.when(n < 2, F.array().cast("array<string>")).when(
        n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(value, i, 2)))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct values; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)))


def similar(a: Column, b: Column, threshold: float = 0.85, substring_rule: bool = True) -> Column:
    """Whether two normalised ids mean the same: equal, one inside the other, or close in bigrams. Empty ids equal only each other."""
    inside = (F.contains(a, b) | F.contains(b, a)) if substring_rule else F.lit(False)
    ga, gb = bigrams(a), bigrams(b)
    near = (F.size(ga) > 0) & (F.size(gb) > 0) & (jaccard(ga, gb) >= threshold)
    return (a == b) | ((a != "") & (b != "") & (inside | near))


def ensure_prefix(uri: Column) -> Column:
    """The uri with a known prefix, `ex:` put before any other."""
    known = F.lit(False)
    for p in KEPT_PREFIXES:
        known = known | uri.startswith(f"{p}:")
    return F.when(known, uri).otherwise(F.concat(F.lit("ex:"), uri))


def escape_literal(text: Column) -> Column:
    """A text as the inside of a Turtle literal: backslash and quote escaped, line feeds as spaces."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def safe_id(value: Column) -> Column:
    """An id as local name: other characters as underscores, a leading ex_ left out."""
    return F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9_]", "_"), "^ex_", "")


def repair_key(category: Column) -> Column:
    """What a typed category is looked up by: lower case without spaces and underscores."""
    return F.translate(F.lower(category), " _", "")


def local_name(uri: Column) -> Column:
    """The uri without every `ex:` in it."""
    return F.replace(uri, F.lit("ex:"), F.lit(""))
