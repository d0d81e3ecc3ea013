"""Frequency of every distinct term and in how many records it stands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows sorted by (term, record).

    The run that is open at the end of a batch is carried into the next one, so
    memory stays at one batch whatever the length of a run.
    """
    term, record, count, records = None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t, r = batch.column(0), batch.column(1)
        n = batch.num_rows
        new_t = np.ones(n, bool)
        new_r = np.ones(n, bool)
        if n > 1:
            new_t[1:] = pc.not_equal(t.slice(1), t.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_r[1:] = pc.not_equal(r.slice(1), r.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_t[0] = t[0].as_py() != term
        new_r[0] = r[0].as_py() != record
        new_r |= new_t
        starts = np.flatnonzero(new_t)
        head = starts[0] if len(starts) else n
        count += int(head)
        records += int(new_r[:head].sum())
        if len(starts):
            if term is not None:
                yield _rows([term], [count], [records])
            ends = np.append(starts[1:], n)
            counts = ends - starts
            per = np.add.reduceat(new_r.astype(np.int64), starts)
            if len(starts) > 1:
                yield _rows(t.take(pa.array(starts[:-1])), counts[:-1], per[:-1])
            term, count, records = t[int(starts[-1])].as_py(), int(counts[-1]), int(per[-1])
        record = r[n - 1].as_py()
    if term is not None:
        yield _rows([term], [count], [records])


def _rows(terms, counts, records) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()) if isinstance(terms, list) else terms.cast(pa.string()), pa.array(counts, pa.int64()), pa.array(records, pa.int64())],
        ["term", "n", "records"],
    )


def term_frequency(records: DataFrame, key: str, terms: str, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``(term, n, records, mark)`` for every distinct term of the collection.

    ``records`` has an identifier ``key`` (bigint) and an array ``terms``; rows
    with the same key are one record, and repeated terms count in ``n``.  The pairs of term
    and record are range-partitioned by both columns, so a term that holds a third
    of all rows is spread over many partitions; each partition is sorted externally and
    scanned run by run, and the partial runs of a term are added.  ``mark`` is
    ``rare`` below ``rare_below`` records, ``common`` above the share
    ``common_above`` of the records that have any term, else ``useful``.

    Null keys, null or empty arrays and null terms are left out; an empty input
    gives no row.
    """
    rows = records.select(records[key].cast("bigint").alias("record"), records[terms].alias("terms")).filter("record is not null and size(terms) > 0")
    pairs = rows.select(F.explode("terms").alias("term"), "record").filter("term is not null")
    runs = (
        pairs.repartitionByRange("term", "record")
        .sortWithinPartitions("term", "record")
        .mapInArrow(_runs, "term string, n bigint, records bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
    )
    total = rows.filter(F.exists("terms", lambda t: t.isNotNull())).agg(F.count_distinct("record").alias("all_records"))
    return runs.crossJoin(F.broadcast(total)).select(  # one row by construction
        "term",
        "n",
        "records",
        F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("all_records"), "common").otherwise("useful").alias("mark"),
    )
