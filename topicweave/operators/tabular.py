"""Helpers for model inputs and outputs: sub-sequences, codes, padding, look-ups, scores, boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.operators.groups import with_stats


def subsequences(rows: DataFrame, key: str, column: str, size: int, step: int | None = None) -> DataFrame:
    """``(key, start, part)``: pieces of ``size`` values, a new one every ``step`` (by default ``size``) places; a rest too short is left out."""
    last = F.size(column) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step or size)))
    return rows.select(key, column, F.explode(starts).alias("start")).select(key, "start", F.slice(column, F.col("start") + 1, size).alias("part"))


def linear_fit(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``(*by, slope, intercept, n)`` of least squares in each group; null where ``x`` doesn't vary."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def accuracy(rows: DataFrame, predicted: Column, label: Column, by: list[str]) -> DataFrame:
    """``(*by, n, accuracy)``: the share of rows whose prediction is the label; rows without either don't count."""
    right = F.when(predicted.isNotNull() & label.isNotNull(), (predicted == label).cast("double"))
    return rows.groupBy(*by).agg(F.count(right).alias("n"), F.avg(right).alias("accuracy"))


def one_hot(value: Column, classes: list[str]) -> Column:
    """0 and 1 for each class, in order; all 0 for a value that is none of them."""
    return F.array(*(F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for c in classes))


def label_name(code: Column, names: list[str]) -> Column:
    """Name of a label's number, counted from 0; null outside."""
    return F.get(F.array(*map(F.lit, names)), code)


def standard_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-score of several columns, from one aggregate; null where a column doesn't vary."""
    stats = {f"_{k}_{c}": f(c) for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_pop))}
    told = with_stats(rows, [], **stats)
    scored = {c: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")) for c in columns}
    return told.withColumns(scored).drop(*stats)


def token_codes(counts: DataFrame, least: int = 5) -> DataFrame:
    """``(token, code)``: numbers from 1 for the tokens that occur ``least`` times or more, in their order; 0 is for all others.

    Numbered by the sizes of hash buckets and the place within one, so no task orders them all.
    """
    from pyspark.sql.window import Window

    known = counts.filter(F.col("n") >= least).select("token", F.substring(F.md5("token"), 1, 2).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("token"))
    sizes = known.groupBy("_b").agg(F.count("*").alias("_n"))  # 256 rows at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return known.withColumn("_place", place).join(F.broadcast(before), "_b").select("token", (F.col("_before") + F.col("_place")).cast("int").alias("code"))


def padded(values: Column, size: int, fill) -> Column:
    """The first ``size`` values, filled up at the end."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size)


def looked_up(words: DataFrame, word: str, vectors: DataFrame, size: int) -> DataFrame:
    """``words`` with their ``vector``; zeros for words without one."""
    return words.join(vectors.select(F.col("word").alias(word), "vector"), word, "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)))


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of boxes ``[x1, y1, x2, y2]``; 0 where both are empty."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = side(0, 2) * side(1, 3)
    every = area(a) + area(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def kept_boxes(rows: DataFrame, group: str, key: str, box: str, score: str, most_overlap: float = 0.5) -> DataFrame:
    """``(group, key)``: non-maximum suppression.  By falling score (ties by key) a box stays unless one that stays overlaps it by more than ``most_overlap``."""
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True])
        boxes = np.stack(pdf[box].to_numpy()).astype(float)
        area, kept = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), []
        for i in range(len(boxes)):
            low, high = np.maximum(boxes[kept, :2], boxes[i, :2]), np.minimum(boxes[kept, 2:], boxes[i, 2:])
            both = np.prod(np.maximum(high - low, 0), axis=1)
            if not len(kept) or (both <= most_overlap * (area[kept] + area[i] - both)).all():
                kept.append(i)
        return pdf.iloc[kept][[group, key]]

    return rows.select(group, key, box, score).filter(F.col(box).isNotNull()).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}")
