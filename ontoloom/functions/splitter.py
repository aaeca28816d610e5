"""Recursive text splitting: coarse separators first, pieces merged up to a size with an overlap of whole pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ontoloom.runtime import spread

#: Separators from coarse to fine; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", ".", " ", "")


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of text, each but the first beginning with the separator; no empty pieces."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in (head, *(sep + r for r in rest)) if p]


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            if joined := "".join(held).strip():
                yield joined
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    if joined := "".join(held).strip():
        yield joined


def split_text(text: str, size: int = 2500, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about `size` characters; consecutive ones share whole pieces of up to `overlap` characters."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for p in _cut(text, separators[at]):
        if len(p) < size:
            short.append(p)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(p, size, overlap, finer) if finer else [p]
    return [*out, *_merge(short, size, overlap)]


def chunk(docs: DataFrame, size: int = 2500, overlap: int = 200) -> DataFrame:
    """Chunks of every document: doc_id, chunk_ix (from 0), text. Null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(d, split_text(t, size, overlap)) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) if t]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, p in parts for _ in p], pa.int64()), pa.array([i for _, p in parts for i in range(len(p))], pa.int32()), pa.array([x for _, p in parts for x in p], pa.string())],
                ["doc_id", "chunk_ix", "text"],
            )

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, chunk_ix int, text string")
