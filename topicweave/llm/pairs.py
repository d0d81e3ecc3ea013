"""Items that appear together: pair counts and lift by heavy-light decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.plans.stage import stage

PAIR = "a bigint, b bigint, n bigint"


def _pairs(a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])


def _bit_matrix(heavy: int):
    """Counts all pairs of heavy items by AND and popcount over a dense bit matrix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((heavy, heavy), np.int64)
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(offsets))
            dense = np.zeros((heavy, -(-n // 64) * 64), np.uint8)
            dense[values, row] = 1
            bits = np.packbits(dense, axis=1).view(np.uint64)
            for i in range(heavy - 1):
                total[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
        a, b = np.nonzero(total)
        if len(a):
            yield _pairs(a, b, total[a, b])

    return count


def _probe(heavy: int):
    """For each list of a light item, or part of one, the sum of its records' heavy bits.

    Rows are sorted by the light item; the list that is open at the end of a
    batch is carried on, so a list's length doesn't matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            light = batch.column(0).to_numpy()
            lists = batch.column(1)
            row = np.repeat(np.arange(len(light)), np.diff(lists.offsets.to_numpy()))
            bits = np.zeros((len(light), heavy), np.int32)
            bits[row, lists.flatten().to_numpy()] = 1
            starts = np.flatnonzero(np.r_[True, light[1:] != light[:-1]])
            sums = np.add.reduceat(bits, starts, axis=0).astype(np.int64)
            ids = light[starts]
            if item is not None:
                if ids[0] == item:
                    sums[0] += held
                else:
                    ids, sums = np.r_[item, ids], np.vstack([held, sums])
            item, held = ids[-1], sums[-1].copy()
            r, h = np.nonzero(sums[:-1])
            if len(r):
                yield _pairs(h, ids[r], sums[r, h])
        if item is not None:
            h = np.flatnonzero(held)
            if len(h):
                yield _pairs(h, np.full(len(h), item), held[h])

    return count


def item_pairs(records: DataFrame, key: str, items: str, min_count: int = 2, heavy: int = 256, block: int = 512) -> DataFrame:
    """``(term_a, term_b, n, n_a, n_b, n_records, lift)`` of all pairs in ``min_count`` records or more.

    ``records`` has an identifier ``key`` (bigint) and an array of strings ``items``.
    Rows with one key are one record and an item counts once in it.  ``term_a``
    < ``term_b`` by code point; ``lift`` is ``n * n_records / (n_a * n_b)``.

    Items in fewer than ``min_count`` records can't be part of a result and go
    first.  The ``heavy`` most frequent items (a fixed number) are counted pairwise in a bit
    matrix; pairs of light items are hash-counted; each light item's list of
    records is probed for heavy ones.  Lists are range-partitioned by item and record, so a
    long one is spread over tasks that each give a part of its counts.  A record with very many items is cut
    into blocks of about ``block`` light items, and two blocks meet under a key of
    their own, so no task holds a record as a whole.

    Null keys, null or empty arrays and null items are left out; an empty input
    gives no row.
    """
    spark = records.sparkSession
    rows = records.select(records[key].cast("bigint").alias("record"), records[items].alias("items"))
    rows = rows.filter("record is not null and size(items) > 0")
    postings = stage(rows.select("record", F.explode(F.array_distinct("items")).alias("item")).filter("item is not null").distinct())
    n_records = postings.agg(F.count_distinct("record")).first()[0]
    counted = postings.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    # ids below `heavy` are the heavy items in order; the others get ids above it
    counted = stage(counted)
    top = counted.orderBy(F.desc("n"), "item").limit(heavy).select("item").collect()  # `heavy` rows at most
    rank = spark.createDataFrame([(r[0], i) for i, r in enumerate(top)], "item string, rank bigint")
    known = stage(
        counted.join(F.broadcast(rank), "item", "left").select("item", "n", F.coalesce("rank", F.monotonically_increasing_id() + heavy).alias("id"))
    )
    held = postings.join(known.select("item", "id"), "item").select("record", "id")
    is_light = F.col("id") >= heavy
    large = held.groupBy("record").agg(F.count("*").alias("size")).filter(F.col("size") > 2 * block + heavy)
    held = held.join(large, "record", "left").withColumn("blocks", F.when(F.col("size").isNull(), 1).otherwise(F.ceil(F.col("size") / block)).cast("int"))
    # a heavy item goes to every block of its record, a light one to a single block
    placed = held.withColumn("block", F.explode(F.when(is_light, F.array(F.pmod(F.xxhash64("id"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    baskets = stage(
        placed.repartition("record", "block")
        .groupBy("record", "block", "blocks")
        .agg(
            F.collect_list(F.when(~is_light, F.col("id").cast("int"))).alias("hs"),
            F.sort_array(F.collect_list(F.when(is_light, F.col("id")))).alias("ls"),
        )
    )
    dense = baskets.filter("block = 0 and size(hs) > 1").select("hs").mapInArrow(_bit_matrix(heavy), PAIR)
    probed = (
        baskets.filter("size(hs) > 0 and size(ls) > 0")
        .select(F.explode("ls").alias("l"), "hs", F.xxhash64("record", "block").alias("r"))
        .repartitionByRange("l", "r")
        .sortWithinPartitions("l")
        .select("l", "hs")
        .mapInArrow(_probe(heavy), PAIR)
    )
    one = baskets.filter("size(ls) > 1").select(F.explode("ls").alias("a"), "ls").select("a", F.explode(F.filter("ls", lambda x: x > F.col("a"))).alias("b"))
    wide = baskets.filter("blocks > 1 and size(ls) > 0")
    later = wide.filter("block < blocks - 1").select("record", F.col("block").alias("p"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("q"), "ls")
    earlier = wide.filter("block > 0").select("record", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("p"), F.col("block").alias("q"), F.col("ls").alias("ls2"))
    across = later.join(earlier, ["record", "p", "q"]).select(F.explode("ls").alias("x"), "ls2").select("x", F.explode("ls2").alias("y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    hashed = one.unionByName(across).withColumn("n", F.lit(1).cast("bigint"))
    # each pair comes from exactly one of the three ways; the parts of its count are added
    pairs = dense.unionByName(probed).unionByName(hashed).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    left = known.select(F.col("id").alias("a"), F.col("item").alias("item_1"), F.col("n").alias("n_1"))
    right = known.select(F.col("id").alias("b"), F.col("item").alias("item_2"), F.col("n").alias("n_2"))
    first = F.col("item_1") < F.col("item_2")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(
            F.when(first, F.col("item_1")).otherwise(F.col("item_2")).alias("term_a"),
            F.when(first, F.col("item_2")).otherwise(F.col("item_1")).alias("term_b"),
            "n",
            F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
            F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"),
            F.lit(n_records).cast("bigint").alias("n_records"),
        )
        .withColumn("lift", F.col("n").cast("double") * F.col("n_records") / F.col("n_a") / F.col("n_b"))
    )
