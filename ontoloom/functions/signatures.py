"""Digests by which similar names meet in an equi-join, computed in Arrow batches: of parts of bigram sets, and of substrings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa

#: Characters that are worked on at a time, padding counted.
CELLS = 1 << 19
#: Bits of a bit table at most.
TABLE_BITS = 28
#: Up to this many differences two equal parts are asked for; beyond, one.
PAIRED = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
_EPS = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _padded(names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names by length, a bounded number of characters at a time: their places in the list, code points (0 as padding), lengths."""
    lens = np.fromiter(map(len, names), np.int64, len(names))
    order = np.argsort(lens, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + max(1, CELLS // max(1, int(lens[order[at]]))))
        while end > at + 1 and (end - at) * lens[order[end - 1]] > 2 * CELLS:
            end = at + (end - at + 1) // 2
        rows = order[at:end]
        most = max(1, int(lens[rows[-1]]))
        codes = np.array([names[r] for r in rows], f"U{most}").view(np.uint32).reshape(len(rows), most)
        yield rows, codes.astype(np.uint64), lens[rows]
        at = end


def differences(n: int, threshold: float) -> int:
    """Most elements that are in one only of two sets, the smaller of n, whose Jaccard similarity reaches the threshold."""
    return floor((1 - threshold) / (1 + threshold) * (n + floor(n / threshold + _EPS)) + _EPS)


@cache
def _levels(n: int, threshold: float) -> frozenset[int]:
    """The differences allowed in pairs with a set of n, by the sizes that the smaller of both may have."""
    return frozenset(differences(m, threshold) for m in range(max(1, ceil(threshold * n - _EPS)), n + 1))


def near_keys(batches: Iterator[pa.RecordBatch], threshold: float, round_: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """(g, k, m, n) for names (k, norm): digests of which two sets of bigrams that reach the threshold share one at least.

    All bigrams are dealt to D + 2 parts, D the differences allowed: two parts at least are the same in both sets, and
    each pair of parts gives a digest (beyond PAIRED differences, each of D + 1 parts). m has a bit for every bigram, n is
    their number. Of the digests those of one of the rounds are given.
    """
    for b in batches:
        ks, names = b["k"].to_numpy(), b["norm"].to_pylist()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for rows, codes, lens in _padded(names):
            if codes.shape[1] < 2:
                continue
            g = _mix((codes[:, :-1] << np.uint64(32)) | codes[:, 1:])
            g[np.arange(g.shape[1]) >= (lens - 1)[:, None]] = _NONE
            g.sort(axis=1)
            keep = g != _NONE
            keep[:, 1:] &= g[:, 1:] != g[:, :-1]
            n = keep.sum(axis=1)
            mask = np.bitwise_or.reduce(np.where(keep, np.uint64(1) << (g >> np.uint64(58)), np.uint64(0)), axis=1)
            weight = np.where(keep, _mix(g ^ _BASE), np.uint64(0))
            sizes = [int(x) for x in np.unique(n) if x]
            for d in sorted(set().union(*(_levels(x, threshold) for x in sizes))):
                at = np.flatnonzero(np.isin(n, [x for x in sizes if d in _levels(x, threshold)]))
                count = d + 2 if d <= PAIRED else d + 1
                part = g[at] % np.uint64(count)
                sums = [np.where(part == np.uint64(p), weight[at], np.uint64(0)).sum(axis=1, dtype=np.uint64) for p in range(count)]
                for p, q in combinations(range(count), 2) if d <= PAIRED else ((p, p) for p in range(count)):
                    key = _mix(_mix(sums[p] + np.uint64((d * 2048 + p) * 2048 + q)) + sums[q] * _BASE)
                    mine = (key >> np.uint64(32)) % np.uint64(rounds) == np.uint64(round_)
                    who = at[mine]
                    for o, x in zip(out, (key[mine].view(np.int64), ks[rows[who]], mask[who].view(np.int64), n[who].astype(np.int32)), strict=True):
                        o.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["g", "k", "m", "n"])


def _running(codes: np.ndarray) -> np.ndarray:
    """Polynomial digests of every beginning of the names, the empty one first."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    spread = _mix(codes + _BASE)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + spread[:, j]
    return out


def _digest(run: np.ndarray, length: int) -> np.ndarray:
    """Digests of all substrings of a length, by where they begin."""
    power = np.uint64(pow(int(_BASE), length, 2**64))
    return _mix((run[:, length:] - run[:, : run.shape[1] - length] * power) ^ np.uint64(length))


def whole_keys(batches: Iterator[pa.RecordBatch], shard: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(g, k) for names (k, norm): the digest of the whole name, if it falls into the shard."""
    for b in batches:
        ks, g = b["k"].to_numpy(), np.zeros(b.num_rows, np.uint64)
        for rows, codes, lens in _padded(b["norm"].to_pylist()):
            run = _running(codes)
            for length in np.unique(lens):
                same = np.flatnonzero(lens == length)
                g[rows[same]] = _digest(run[same, : length + 1], int(length))[:, 0]
        mine = _in_shard(g, shard, shards)
        yield pa.RecordBatch.from_arrays([pa.array(g[mine].view(np.int64)), pa.array(ks[mine])], ["g", "k"])


def inner_keys(batches: Iterator[pa.RecordBatch], lengths: list[int], table: np.ndarray, shard: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(g, k) for names (k, norm): digests of their proper substrings of the lengths that fall into the shard and may be in the table."""
    for b in batches:
        ks, names = b["k"].to_numpy(), b["norm"].to_pylist()
        out: tuple[list, list] = ([], [])
        for rows, codes, lens in _padded(names):
            run = _running(codes)
            for length in lengths:
                if length >= lens[-1]:
                    break
                longer = np.searchsorted(lens, length, "right")  # they come by length
                g = _digest(run[longer:], length)
                inside = np.arange(g.shape[1]) <= (lens[longer:] - length)[:, None]
                r, c = np.nonzero(inside & _in_shard(g, shard, shards) & _held(g, table))
                out[0].append(g[r, c].view(np.int64))
                out[1].append(ks[rows[longer + r]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["g", "k"])


def _in_shard(g: np.ndarray, shard: int, shards: int) -> np.ndarray:
    return ((g >> np.uint64(56)) * np.uint64(shards)) >> np.uint64(8) == np.uint64(shard)


def _places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64((1 << bits) - 1)
    return g & last, (g >> np.uint64(TABLE_BITS)) & last


def _held(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = int(len(table) * 8).bit_length() - 1
    a, b = _places(g, bits)
    return (table[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def table_places(batches: Iterator[pa.RecordBatch], bits: int, segment: int) -> Iterator[pa.RecordBatch]:
    """(s, p) for digests (g): by segment, the places in it of the bits of a batch, packed."""
    for b in batches:
        places = np.sort(np.concatenate(_places(b["g"].to_numpy().view(np.uint64), bits)))
        s, at = np.unique(places >> np.uint64(segment), return_index=True)
        packed = [x.tobytes() for x in np.split((places & np.uint64((1 << segment) - 1)).astype(np.uint32), at[1:])] if len(s) else []
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(packed, pa.binary())], ["s", "p"])


def table_segment(places: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """(s, bits) for the packed places (s, p) of whole segments: their bits as bytes."""
    bits: dict[int, np.ndarray] = {}
    for b in places:
        for s, p in zip(b["s"].to_pylist(), b["p"].to_pylist(), strict=True):
            bits.setdefault(s, np.zeros(1 << segment, bool))[np.frombuffer(p, np.uint32)] = True
    packed = [np.packbits(x, bitorder="little").tobytes() for x in bits.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(packed, pa.binary())], ["s", "bits"])
