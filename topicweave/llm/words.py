"""Hashes of words and of word series, computed for a whole batch at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

U = np.uint64
_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LETTER[ord("0") : ord("9") + 1] = np.arange(27, 37)
_BASE = U(0x9E3779B97F4A7C15)
_LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: pa.Array, most: int = 1 << 21):
    """``(first, array)`` pieces of about ``most`` bytes, so that the working arrays stay small."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, texts.slice(first, end - first)
        first = end


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word, in order; a word is a run of a-z and 0-9.  Texts are in lower case already."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.int64), np.empty(0, U)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    code = _LETTER[raw]
    inside = code > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets - offsets[0]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, size = np.flatnonzero(begins), np.flatnonzero(ends)
    size = size - start + 1
    row = np.searchsorted(offsets - offsets[0], start, "right") - 1
    return row, hash_runs(code, start, size)


def hash_runs(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run of codes, place by place for all runs at once."""
    h = np.zeros(len(start), U)
    order = np.argsort(-size, kind="stable")
    s, z = start[order], size[order]
    part, falling = np.zeros(len(s), U), -z
    for i in range(min(int(z[0]) if len(z) else 0, _LONG_WORD)):
        live = int(np.searchsorted(falling, -i, "left"))  # runs longer than i come first
        part[:live] = part[:live] * _BASE + code[s[:live] + i]
    for j in range(int(np.searchsorted(falling, -_LONG_WORD, "left"))):
        part[j] = U(xxhash.xxh3_64_intdigest(code[s[j] : s[j] + z[j]].tobytes()))
    h[order] = mix(part)
    return h


def shingles(row: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every series of ``size`` words, in order and with repeats."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    h = np.zeros(n, U)
    for i in range(size):
        h = (h ^ word[i : i + n]) * _BASE + U(i + 1)
        h ^= h >> U(29)
    whole = row[:n] == row[size - 1 :]
    return row[:n][whole], mix(h[whole])


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once in its row, sorted by row and hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


# ---- bitmaps of identifiers ------------------------------------------------------

_SLICE = 1 << 16


def _bit(ids: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (mix(ids.view(U) + U(probe * int(_BASE) % (1 << 64))) >> U(64 - bits)).astype(np.int64)


def _marks(bits: int, probes: int):
    """Bitmap of the identifiers in a partition, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for probe in range(probes):
                at = _bit(ids, bits, probe)
                np.bitwise_or.at(packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        for i in range(0, len(packed), _SLICE):
            if packed[i : i + _SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE], pa.int32()), pa.array([zlib.compress(packed[i : i + _SLICE].tobytes(), 1)], pa.binary())], ["slice", "marks"])

    return run


def _join_marks(group: pa.Table) -> pa.Table:
    total = None
    for marks in group.column("marks"):
        part = np.frombuffer(zlib.decompress(marks.as_py()), np.uint8)
        total = part if total is None else total | part
    return pa.table({"slice": group.column("slice")[:1], "marks": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def bitmap(ids: DataFrame, bits: int, probes: int = 1) -> np.ndarray:
    """Bitmap of fixed size, ``2 ** bits`` bits, with ``probes`` bits set for every identifier (bigint)."""
    packed = np.zeros((1 << bits) // 8, np.uint8)
    rows = ids.mapInArrow(_marks(bits, probes), "slice int, marks binary").groupBy("slice").applyInArrow(_join_marks, "slice int, marks binary")
    for r in rows.collect():
        packed[r[0] * _SLICE : (r[0] + 1) * _SLICE] = np.frombuffer(zlib.decompress(bytes(r[1])), np.uint8)
    return packed


def in_bitmap(packed: np.ndarray, bits: int, ids: np.ndarray, probes: int = 1) -> np.ndarray:
    """Places of the identifiers that may be in the bitmap."""
    out = np.arange(len(ids))
    for probe in range(probes):
        at = _bit(ids[out], bits, probe)
        out = out[(packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    return out
