"""Figures of whole groups beside their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """``df`` with aggregates of each row's group (of the whole table without ``by``) as further columns.

    Aggregated first and joined back, where a window would bring a whole group into one task.
    Null keys are a group too.
    """
    columns = [c.alias(n) for n, c in stats.items()]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*columns)))  # one row by construction
    small = df.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).agg(*columns)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    return df.join(small, same).drop(*(f"_by{i}" for i in range(len(by))))
