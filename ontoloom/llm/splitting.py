"""Splitting oversized texts at natural boundaries with balanced piece lengths and a given overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.runtime import spread

#: Boundaries from strong to weak; a cut falls after the match. Fixed order of the method.
_LEVELS = [re.compile(p) for p in (r"\r?\n[ \t]*\r?\n\s*|\r[ \t]*\r\s*", r"\r\n|\n|\r", r"[.!?…。！？][\"'”’»)\]]*\s+", r"[;:]\s+|[。！？；：]", r",\s+|\s[–—-]\s", r"\s+")]


@lru_cache(maxsize=64)
def _reach(size: int) -> int:
    return max(1, size // 5)


def _snap(text: str, low: int, target: int, high: int) -> int:
    """The end of the strongest boundary in (low, high], of equals the nearest to target; target itself if there is none."""
    for level in _LEVELS:
        best = None
        # a match may begin before low; what counts is where it ends
        for m in level.finditer(text, low, high):
            end = m.end()
            if low < end <= high and (best is None or abs(end - target) < abs(best - target)):
                best = end
        if best is not None:
            return best
    return min(max(target, low + 1), high)


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans [begin, end) of at most `size` characters that cover `text`, consecutive ones sharing up to `overlap`.

    Balanced targets: the least number of pieces that can hold the text, with equal target lengths; each target is
    snapped to the strongest boundary near it; when a piece breaks its limit, or the last one can't hold
    what is left, one more piece is tried. The overlap begins at the strongest boundary within its reach, so
    it is at most, and usually a little under, `overlap`; where a text has no boundary it is exact. A text that
    fits is one span; an empty text has none. An overlap that is not below the size is an error, as pieces could not advance.
    """
    size, overlap = max(1, size), max(0, overlap)
    if overlap >= size:
        raise ValueError(f"an overlap of {overlap} leaves no room in pieces of {size}")
    n = len(text)
    if n == 0:
        return []
    if n <= size:
        return [(0, n)]
    step = size - overlap
    count = -(-(n - overlap) // step)
    while True:
        # fresh text per piece, the overlap comes on top of it
        spans, begin, fresh = [], 0, 0
        for i in range(count):
            left = count - i
            if left == 1:
                spans.append((begin, n))
                break
            target = fresh + (n - fresh) / left
            high = min(begin + size, n - 1)
            reach = _reach(size)
            # the pieces to come must be able to hold the rest
            low = max(fresh, int(target) - reach, n - (left - 1) * step - 1 if overlap else n - (left - 1) * size - 1)
            low = min(low, high - 1)
            cut = _snap(text, low, int(target), min(high, max(int(target) + reach, low + 1)))
            spans.append((begin, cut))
            fresh = cut
            begin = _snap_back(text, cut, overlap, spans[-1][0])
        if all(b - a <= size for a, b in spans) and all(x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False)):
            return spans
        count += 1
        if count > 2 * n:  # windows without regard to boundaries fit any size
            return [(i, min(n, i + size)) for i in range(0, n - overlap, step)]


def _snap_back(text: str, cut: int, overlap: int, floor: int) -> int:
    """Where the next piece begins: at most `overlap` before the cut, after a sentence end or a space if there is one."""
    if not overlap:
        return cut
    low = max(floor + 1, cut - overlap)
    for level in (_LEVELS[2], _LEVELS[5]):
        for m in level.finditer(text, low, cut):
            if low <= m.end() < cut:
                return m.end()
    return low


def _pieces(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"doc_id": [], "piece_ix": [], "begin": [], "end": [], "n_pieces": []}
        body: list[str] = []
        for doc, text, size, overlap in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["size"].to_pylist(), b["overlap"].to_pylist(), strict=True):
            spans = split_spans(text, size, overlap)
            out["doc_id"] += [doc] * len(spans)
            out["piece_ix"] += range(len(spans))
            out["begin"] += [a for a, _ in spans]
            out["end"] += [z for _, z in spans]
            out["n_pieces"] += [len(spans)] * len(spans)
            if with_text:
                body += [text[a:z] for a, z in spans]
        cols = [pa.array(out["doc_id"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("piece_ix", "begin", "end", "n_pieces"))]
        names = list(out)
        if with_text:
            cols, names = [*cols, pa.array(body, pa.string())], [*names, "piece"]
        yield pa.RecordBatch.from_arrays(cols, names)


def split_documents(docs: DataFrame, settings: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of every document longer than the chunk size of its source (settings row `*` for every other source).

    docs: doc_id, text, source; settings: source, chunk_size, chunk_overlap, a handful of rows joined by Spark's own
    size-checked broadcast. Null texts and documents that fit make no pieces; a source named `*` or null takes
    the row `*`; a missing row `*` leaves those documents whole. Returns doc_id, piece_ix, begin, end (character
    offsets, end exclusive), n_pieces and, with_text, piece.
    """
    own = settings.select(F.col("source").alias("_s"), "chunk_size", "chunk_overlap").where("_s <> '*'")
    rest = settings.where("source = '*'").agg(F.min(F.struct("chunk_size", "chunk_overlap")))
    base = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "source")
    sized = base.join(own, F.col("source") == F.col("_s"), "left").withColumn("_d", rest.scalar())
    sized = sized.select("doc_id", "text", F.coalesce("chunk_size", "_d.chunk_size").alias("size"), F.coalesce("chunk_overlap", "_d.chunk_overlap", F.lit(0)).alias("overlap"))
    schema = "doc_id bigint, piece_ix int, begin int, end int, n_pieces int" + (", piece string" if with_text else "")
    return spread(sized.where(F.char_length("text") > F.col("size")), "doc_id", base).mapInArrow(lambda it: _pieces(it, with_text), schema)
