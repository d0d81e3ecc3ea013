"""How distinctive a term is for its record: hypergeometric enrichment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.plans.stage import stage

SCORED = "record bigint, term string, n_in_record bigint, record_size bigint, n bigint, records bigint, neg_log_p double, score double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0: Stirling's series after shifting x to 8 or more."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_upper_tail(k: np.ndarray, total: float, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """log P(X >= k), X hypergeometric: ``drawn`` of ``total`` tokens, ``marked`` of them the term.

    From the mean upwards the terms from k on are added; below the mean, one
    minus the terms under k, which is then the well-conditioned side.
    """
    k, marked, drawn = (np.asarray(x, float) for x in (k, marked, drawn))
    upper = k >= drawn * marked / total
    x = np.where(upper, k, k - 1)
    floor, ceil = np.maximum(0, drawn + marked - total), np.minimum(drawn, marked)
    inside = (x >= floor) & (x <= ceil)
    at = np.clip(x, floor, ceil)
    log_first = _log_choose(marked, at) + _log_choose(total - marked, drawn - at) - _log_choose(np.full_like(at, total), drawn)
    ratio, added = np.ones_like(k), np.ones_like(k)
    live = np.flatnonzero(inside)
    while len(live):
        v, m, d = at[live], marked[live], drawn[live]
        up = upper[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(up, (m - v) * (d - v) / ((v + 1) * (total - m - d + v + 1)), v * (total - m - d + v) / ((m - v + 1) * (d - v + 1)))
        step = np.where(np.isfinite(step), np.maximum(step, 0), 0)
        ratio[live] *= step
        added[live] += ratio[live]
        at[live] += np.where(up, 1, -1)
        live = live[ratio[live] > 1e-17 * added[live]]
    log_sum = np.where(inside, log_first + np.log(added), -np.inf)
    with np.errstate(divide="ignore"):
        return np.minimum(0, np.where(upper, log_sum, np.log1p(-np.minimum(np.exp(log_sum), 1 - 1e-16))))


def _adjusted(row: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg adjusted log probabilities; the terms of one record are one family."""
    order = np.lexsort((log_p, row))
    r, p = row[order], log_p[order]
    first = np.r_[True, r[1:] != r[:-1]]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(r)])
    rank = np.arange(len(r)) - np.repeat(starts, sizes) + 1
    q = p + np.log(np.repeat(sizes, sizes) / rank)
    shift = 1
    while shift < sizes.max():  # running minimum from the end of each record, by doubling
        same = np.flatnonzero(r[shift:] == r[:-shift])
        q[same] = np.minimum(q[same], q[same + shift])
        shift *= 2
    out = np.empty_like(q)
    out[order] = np.minimum(q, 0)
    return out


def _counts(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of each distinct term in each row; the terms; the rows' sizes."""
    coded = tokens.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(tokens.offsets.to_numpy())
    row = np.repeat(np.arange(len(tokens)), sizes)
    width = max(1, len(coded.dictionary))
    keys, n = np.unique(row * width + codes, return_counts=True)
    return keys // width, keys % width, n, coded.dictionary.to_numpy(zero_copy_only=False), sizes


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and records of each term in this partition."""
    n: dict[str, int] = defaultdict(int)
    records: dict[str, int] = defaultdict(int)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([records[t] for t in n], pa.int64())], ["term", "n", "records"])
        n.clear(), records.clear()
        return out

    for batch in batches:
        if batch.num_rows:
            _, code, count, terms, _ = _counts(batch.column(1))
            total = np.bincount(code, count, len(terms)).astype(np.int64)
            for t, c, r in zip(terms, total.tolist(), np.bincount(code, minlength=len(terms)).tolist()):
                n[t] += c
                records[t] += r
            if len(n) > 500_000:  # so many terms: their partial counts go on early
                yield flush()
    yield flush()


def _scores(record, row, count, sizes, n, records, total):
    """log p and adjusted log p of each (row, term); equal cases are computed once."""
    cases = np.empty((len(row), 3), np.int64)
    cases[:, 0], cases[:, 1], cases[:, 2] = count, n, sizes[row]
    key = pd.util.hash_array(cases[:, 0] * np.int64(1_000_003) + cases[:, 1]) ^ pd.util.hash_array(cases[:, 2])
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    log_p = log_upper_tail(cases[at, 0], float(total), cases[at, 1], cases[at, 2])[back]
    return log_p, _adjusted(row, log_p)


def _emit(record, row, terms, count, sizes, n, records, log_p, log_q, keep) -> pa.RecordBatch:
    k = np.flatnonzero(keep)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(record[row[k]], pa.int64()),
            pa.array(terms[k], pa.string()),
            *(pa.array(x[k], pa.int64()) for x in (count, sizes[row], n, records)),
            pa.array(np.abs(log_p[k]), pa.float64()),
            pa.array(np.abs(log_q[k]), pa.float64()),
        ],
        [x.split()[0] for x in SCORED.split(", ")],
    )


def _kept(count, records, min_count, min_records, max_records):
    keep = (count >= min_count) & (records >= min_records)
    return keep if max_records is None else keep & (records <= max_records)


def distinctive_terms(
    records: DataFrame,
    key: str,
    tokens: str,
    min_count: int = 1,
    min_records: int = 1,
    max_records: int | None = None,
    max_local_terms: int = 1_000_000,
    max_local_bytes: int = 32 << 20,
    hot_terms: int = 50_000,
) -> DataFrame:
    """Score of every distinct term of every record: how far it sets the record apart.

    ``records`` has a unique identifier ``key`` (bigint) and an array of strings
    ``tokens``.  With N tokens in all, ``n`` of them the term, ``record_size`` in
    the record and ``n_in_record`` of those the term, the probability is the
    exact hypergeometric upper tail; ``score`` is its negative logarithm after
    Benjamini-Hochberg adjustment over all terms of the record.  The counts
    and the adjustment cover all terms; the limits ``min_count`` (in the
    record), ``min_records`` and ``max_records`` (records with the term) only
    choose which rows are returned.

    Corpus counts are added up within each partition before they are shuffled.
    They are then handed to the tasks that score the records, if their measured size is within
    ``max_local_terms`` and ``max_local_bytes``.  Of a larger vocabulary only the ``hot_terms`` most frequent terms
    (of 256 bytes at most each) are handed over, and the rest, none of which fills many rows, is
    joined by term.  Both ways give the same rows.

    Null keys, null or empty arrays and null tokens are left out; an empty
    input gives no row.
    """
    spark = records.sparkSession
    rows = records.select(records[key].cast("bigint").alias("record"), F.filter(records[tokens], lambda t: t.isNotNull()).alias("tokens"))
    rows = rows.filter("record is not null and size(tokens) > 0")
    known = stage(rows.mapInArrow(_partial, "term string, n bigint, records bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("records").alias("records")))
    total, width, size = known.agg(F.sum("n"), F.count("*"), F.sum(F.octet_length("term"))).first()
    if not total:
        return spark.createDataFrame([], SCORED)
    if width <= max_local_terms and size <= max_local_bytes:
        table = known.toPandas()
        held = spark.sparkContext.broadcast((table["term"].to_numpy(), table["n"].to_numpy(), table["records"].to_numpy()))
        return rows.mapInArrow(_score_local(held, total, min_count, min_records, max_records), SCORED)
    hot = known.filter(F.octet_length("term") <= 256).orderBy(F.desc("n"), "term").limit(hot_terms).toPandas()
    held = spark.sparkContext.broadcast((hot["term"].to_numpy(), hot["n"].to_numpy(), hot["records"].to_numpy()))
    entries = rows.mapInArrow(_entries(held), "record bigint, record_size bigint, term string, n_in_record bigint, n_hot bigint, records_hot bigint")
    # an entry with a hot term has its counts already: its key is its record, which no term is
    key = F.when(F.col("n_hot").isNull(), F.concat(F.lit("t"), "term")).otherwise(F.concat(F.lit("r"), F.col("record").cast("string")))
    counts = known.select(F.concat(F.lit("t"), "term").alias("key"), "n", "records")
    joined = entries.withColumn("key", key).join(counts, "key", "left")
    entry = F.struct("term", "n_in_record", F.coalesce("n", "n_hot").alias("n"), F.coalesce("records", "records_hot").alias("records"))
    grouped = joined.groupBy("record", "record_size").agg(F.collect_list(entry).alias("terms"))
    return grouped.mapInArrow(_score_joined(total, min_count, min_records, max_records), SCORED)


def _score_local(held, total, min_count, min_records, max_records):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n_of, records_of = held.value
        index = pd.Index(terms)
        for batch in batches:
            if not batch.num_rows:
                continue
            record = batch.column(0).to_numpy()
            row, code, count, words, sizes = _counts(batch.column(1))
            at = index.get_indexer(words)[code]
            n, records = n_of[at], records_of[at]
            log_p, log_q = _scores(record, row, count, sizes, n, records, total)
            yield _emit(record, row, words[code], count, sizes, n, records, log_p, log_q, _kept(count, records, min_count, min_records, max_records))

    return score


def _entries(held):
    """A row for each term of a record, with its corpus counts if the term is a hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n_of, records_of = held.value
        index = pd.Index(terms)
        for batch in batches:
            if not batch.num_rows:
                continue
            record = batch.column(0).to_numpy()
            row, code, count, words, sizes = _counts(batch.column(1))
            at = index.get_indexer(words)[code] if len(index) else np.full(len(code), -1)
            of = lambda values: pa.array(values[at] if len(values) else np.zeros(len(at), np.int64), pa.int64(), mask=at < 0)
            columns = [pa.array(record[row]), pa.array(sizes[row], pa.int64()), pa.array(words[code], pa.string()), pa.array(count, pa.int64()), of(n_of), of(records_of)]
            yield pa.RecordBatch.from_arrays(columns, ["record", "record_size", "term", "n_in_record", "n_hot", "records_hot"])

    return run


def _score_joined(total, min_count, min_records, max_records):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            record, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            words, count, n, records = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            log_p, log_q = _scores(record, row, count, sizes, n, records, total)
            yield _emit(record, row, words, count, sizes, n, records, log_p, log_q, _kept(count, records, min_count, min_records, max_records))

    return score
