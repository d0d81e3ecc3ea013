"""Test passages inside training documents: MinHash containment search over sets partitioned by size, then an exact check.

A passage is a set of word series, and so is each stretch of a document.  The smaller the stretch
that holds a passage, the more of the stretch the passage is: stretches are partitioned
by size, and each partition takes as many hash functions as its largest size calls for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.words import bitmap, distinct, in_bitmap, mix, shingles, slices, words
from topicweave.plans.stage import stage

U = np.uint64
#: Bits of the bitmap for each key, their number at most, and probes of a key.
_BITS, _MOST_BITS, _PROBES = 32, 30, 6
#: Number of the plain hash function, for passages that repeat themselves.
_PLAIN = 1 << 20


def functions_for(size: int, passage: int, containment: float, miss: float) -> int:
    """Hash functions needed so that a stretch of ``size`` series is missed with a probability of ``miss``.

    A stretch that holds ``containment`` of a passage has at least this Jaccard similarity with it.
    """
    shared = containment * passage
    similar = min(1.0, shared / (size + passage - shared))
    return 1 if similar == 1 else math.ceil(math.log(miss) / math.log(1 - similar))


def partitions(passage: int, length: int, containment: float, miss: float) -> np.ndarray:
    """Number of hash functions by size of stretch, 0 to ``length``: equal within a partition, none where a passage finds no room."""
    out, low = np.zeros(length + 1, np.int64), math.ceil(containment * passage - 1e-9)
    while low <= length:
        high = min(length, max(low, passage if low <= passage else math.floor(low * 1.3)))
        out[low : high + 1] = functions_for(high, passage, containment, miss)
        low = high + 1
    return out


def _factors(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32) | np.uint32(1)


def _stretches(row: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of overlapping stretches of ``length`` shingles in each text; the last may be shorter."""
    if not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = np.r_[starts[1:], len(row)]
    # the last stretch begins where the one before it leaves the rest uncovered
    count = np.maximum(1, -(-(ends - starts - (length - step)) // step))
    first = np.repeat(starts, count)
    at = first + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return at, np.minimum(at + length, np.repeat(ends, count))


def _minima(h: np.ndarray, begin: np.ndarray, end: np.ndarray, factor: np.uint32) -> np.ndarray:
    """MinHash of each stretch under one hash function."""
    # the hashes are well mixed already, so an odd factor alone gives another order of them
    v = np.append(h * factor, np.uint32(0xFFFFFFFF))
    cuts = np.empty(2 * len(begin), np.int64)
    cuts[::2], cuts[1::2] = begin, end
    return np.minimum.reduceat(v, cuts)[::2] if len(cuts) else np.empty(0, np.uint32)


def _key(number: int, low: np.ndarray) -> np.ndarray:
    return (U(number) << U(32) | low.astype(U)).view(np.int64)


def _item_keys(run: int, width: int, need: np.ndarray):
    """Keys of all passages of ``run`` words of each item."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(int(need.max()))
        n = run - width + 1
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, piece in slices(batch.column(1)):
                row, h = shingles(*words(piece), width)
                begin = np.arange(max(0, len(row) - n + 1))
                begin = begin[row[begin] == row[begin + n - 1]]
                if not len(begin):
                    continue
                low = (h & U(0xFFFFFFFF)).astype(np.uint32)
                # a passage that repeats series of its own is a smaller set: it is looked for by its least series
                inside = np.sort(h[begin[:, None] + np.arange(n)], axis=1)
                again = (inside[:, 1:] == inside[:, :-1]).any(1)
                parts = [(_key(i, _minima(low, begin, begin + n, f)), begin) for i, f in enumerate(factors)]
                parts.append((_key(_PLAIN, (inside[again, 0] & U(0xFFFFFFFF))), begin[again]))
                for key, at in parts:
                    if len(key):
                        both = np.unique(np.rec.fromarrays([key, ids[first + row[at]]], names="key,item"))
                        yield pa.RecordBatch.from_arrays([pa.array(both["key"]), pa.array(both["item"])], ["key", "item"])

    return keys


def _search(marks, bits: int, plain: bool, width: int, length: int, step: int, need: np.ndarray):
    """Documents with keys that may be an item's, with these keys and their text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, factors = marks.value, _factors(int(need.max()))
        for batch in batches:
            for first, piece in slices(batch.column(1)):
                row, h = shingles(*words(piece), width)
                low = (h & U(0xFFFFFFFF)).astype(np.uint32)
                begin, end = _stretches(row, length, step)
                wants = need[end - begin]
                order = np.argsort(-wants, kind="stable")  # those that take most functions first
                begin, end, wants = begin[order], end[order], wants[order]
                rows, keys = [], []
                for i, f in enumerate(factors):
                    m = int(np.searchsorted(-wants, -i, "left"))
                    key = _key(i, _minima(low, begin[:m], end[:m], f))
                    hit = in_bitmap(known, bits, key, _PROBES)
                    rows.append(row[begin[hit]]), keys.append(key[hit])
                if plain:
                    key = _key(_PLAIN, low)
                    hit = in_bitmap(known, bits, key, _PROBES)
                    rows.append(row[hit]), keys.append(key[hit])
                r, k = np.concatenate(rows), np.concatenate(keys)
                if len(r):
                    both = np.unique(np.rec.fromarrays([r, k], names="r,k"))
                    docs, starts = np.unique(both["r"], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(both)].astype(np.int32)), pa.array(both["k"]))
                    at = pa.array(first + docs, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists], ["doc", "text", "keys"])

    return find


def _contained(run: int):
    """Exact check: the item's series of ``run`` words that stand in the document."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                n = len(texts)
                (d, g), (i, h) = (distinct(*shingles(*words(c), run)) for c in (texts, batch.column(3).slice(first, n)))
                # a series counts only within its own candidate: its hash is mixed with the row
                own = lambda row, x: mix(x + (row.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
                inside = np.isin(own(i, h), own(d, g))
                shared, total = np.bincount(i[inside], minlength=n), np.bincount(i, minlength=n)
                keep = np.flatnonzero(shared)
                at = pa.array(first + keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shared[keep], pa.int32()), pa.array(total[keep], pa.int32())], ["doc", "item", "shared", "total"])

    return check


def leaked_items(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, width: int = 5, containment: float = 1.0, miss: float = 1e-9
) -> DataFrame:
    """``(doc, item, shared, total)``: documents that hold ``run`` words in a row of an item.

    A word is a run of a-z and 0-9 in the lower-cased text; both identifiers are
    bigint.  ``shared`` of the item's ``total`` distinct series of ``run`` words stand in the document.

    Every passage of ``run`` words is searched as a set of word series of
    ``width``.  Documents are cut into overlapping stretches of two such passages at most, so any
    passage lies whole in one of them.  Stretches are partitioned by size; in each partition a
    stretch is a candidate if one of its MinHash values is the passage's, under as many hash functions as
    the threshold ``containment`` and the chance ``miss`` of missing a stretch call for.
    Passages that repeat series of their own are too small for that and are looked for by one of their series.
    All candidates are checked exactly on the whole texts.

    The items' keys go to every task as a bitmap of 2^30 bits at most; documents with
    a key in it are set aside with their text, and only these meet the keys and the items.  Null keys are left out; null,
    empty and short texts give no row, as do empty tables.
    """
    n = run - width + 1
    length, step = 2 * run - width + 1, run + 1  # a stretch of 2 * run words, the next one run + 1 words on
    assert n >= 1 and length - step >= n - 1
    need = partitions(n, length, containment, miss)
    docs = documents.select(documents[key].cast("bigint").alias("doc"), F.lower(documents[text]).alias("text")).filter("doc is not null and text is not null")
    tests = items.select(items[item_key].cast("bigint").alias("item"), F.lower(items[item_text]).alias("item_text")).filter("item is not null and item_text is not null")
    keys = stage(tests.mapInArrow(_item_keys(run, width, need), "key bigint, item bigint").distinct())
    size, plain = keys.agg(F.count("*"), F.count_if(F.col("key") >= _PLAIN << 32)).first()
    bits = min(_MOST_BITS, max(16, math.ceil(math.log2(max(1, size) * _BITS))))
    marks = documents.sparkSession.sparkContext.broadcast(bitmap(keys.select("key"), bits, _PROBES))
    met = stage(docs.mapInArrow(_search(marks, bits, plain > 0, width, length, step, need), "doc bigint, text string, keys array<bigint>"))
    pairs = met.select("doc", F.explode("keys").alias("key")).join(keys, "key").select("doc", "item").distinct()
    return pairs.join(met.select("doc", "text"), "doc").join(tests, "item").select("doc", "item", "text", "item_text").mapInArrow(_contained(run), "doc bigint, item bigint, shared int, total int")
