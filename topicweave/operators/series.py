"""Monthly series, buckets, smoothing of issues over months, and segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicweave.functions.months import even_split, from_ordinal, ordinal, publication_month
from topicweave.operators.groups import with_stats
from topicweave.plans.stage import stage


def clean_papers(papers: DataFrame) -> DataFrame:
    """``(paper_id, month, journal, doi)`` of the papers whose keywords, abstract, year and month are all known.

    A paper whose date begins with no month name is left out; a null journal stays null.
    """
    return (
        papers.filter("author_keywords is not null and abstract is not null and publication_year is not null and publication_date is not null")
        .select("paper_id", publication_month(F.col("publication_year"), F.col("publication_date")).alias("month"), F.upper("source_title").alias("journal"), "doi")
        .filter("month is not null")
    )


def distinct_per_month(values: DataFrame, month: str, value: str) -> DataFrame:
    """``(month, n)``: distinct values in each month; null months and values don't count."""
    return values.filter(F.col(month).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(month).alias("month")).agg(F.count_distinct(value).alias("n"))


def bucket_months(series: DataFrame, size: int) -> DataFrame:
    """``(bucket, first_month, n)``: every ``size`` consecutive rows of a monthly series added up.

    Works on a series that is already one row per month, so one task is enough.
    """
    at = F.row_number().over(Window.orderBy("month")) - 1
    return series.withColumn("bucket", F.floor(at / size).cast("int")).groupBy("bucket").agg(F.min("month").alias("first_month"), F.sum("n").alias("n"))


def standardise(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Population z-score within each group; null where the values don't vary."""
    told = with_stats(df, by or [], _mean=F.avg(value), _sd=F.stddev_pop(value))
    return told.withColumn(out, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def min_max(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Values scaled to 0..1 within each group; unchanged where they don't vary."""
    low, high = F.col("_low"), F.col("_high")
    told = with_stats(df, by or [], _low=F.min(value), _high=F.max(value))
    return told.withColumn(out, F.when(low == high, F.col(value).cast("double")).otherwise((F.col(value) - low) / (high - low))).drop("_low", "_high")


def issue_gaps(papers: DataFrame) -> DataFrame:
    """``(journal, month, n, gap)``: papers of each issue and months since the journal's issue before.

    The first issue takes the gap of the second; a journal with one issue has null.
    """
    w = Window.partitionBy("journal").orderBy("month")
    counts = papers.filter("journal is not null").groupBy("journal", "month").agg(F.count("*").alias("n"))
    gap = (ordinal(F.col("month")) - ordinal(F.lag("month").over(w))).cast("int")
    counts = counts.withColumn("gap", gap)
    return counts.withColumn("gap", F.coalesce("gap", F.lead("gap").over(w)))


def smooth_issues(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(key, journal, month)`` with each issue's papers spread over the months since the issue before.

    The i-th paper of an issue (by month, doi, key) takes the month that holds the i-th place.
    Papers of a journal with a single issue keep their month.  Journal and issue
    are the window, so only one issue's rows are ordered together.
    """
    gaps = issue_gaps(papers).withColumn("width", F.coalesce("gap", F.lit(1)))
    places = gaps.select("journal", "month", F.posexplode(even_split(F.col("n"), F.col("width"))).alias("at", "places"), "width")
    upto = F.sum("places").over(Window.partitionBy("journal", "month").orderBy("at"))
    ranges = places.select(
        "journal", "month", from_ordinal(ordinal(F.col("month")) - F.col("width") + 1 + F.col("at")).alias("new_month"),
        (upto - F.col("places")).alias("low"), upto.alias("high"),
    )
    rank = F.row_number().over(Window.partitionBy("journal", "month").orderBy(F.col("doi").asc_nulls_first(), key)) - 1
    ranked = papers.filter("journal is not null").withColumn("rank", rank)
    return ranked.join(ranges, ["journal", "month"]).filter("rank >= low and rank < high").select(key, "journal", F.col("new_month").alias("month"))


def chord_distances(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distance of every point of a series to the line from its first to its last point.

    ``series`` has ``pos`` (0, 1, ...) and ``n``; the result adds ``distance`` and
    ``rank`` (largest first, earlier position on ties).
    """
    by = by or []
    whole = Window.partitionBy(*by, F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, size = F.first("n").over(whole), F.last("n").over(whole), F.count("*").over(whole)
    start = F.first("pos").over(whole)
    slope = (last - first) / F.when(size > 1, size - 1)
    distance = F.abs(F.col("n") - slope * (F.col("pos") - start) - first) / F.sqrt(1 + slope * slope)
    out = series.withColumn("distance", distance).withColumn("start", start).withColumn("size", size)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(F.desc_nulls_last(F.round("distance", 9)), "pos")))


def _breaks(n: np.ndarray, limit: int, least: float) -> list[int]:
    out, waiting = [], [(0, len(n) - 1)]
    while waiting:
        a, b = waiting.pop()
        size = b - a + 1
        if size <= 4:
            continue
        at = np.arange(size)
        slope = (n[b] - n[a]) / (size - 1)
        far = np.abs(n[a : b + 1] - slope * at - n[a]) / np.sqrt(1 + slope * slope)
        for i in np.lexsort((at, -np.round(far, 9)))[:5].tolist():
            if far[i] > least and i + 1 > limit and size - i > limit:
                out.append(a + i)
                waiting += [(a, a + i), (a + i, b)]
                break
    return sorted(set(out))


def segment_breaks(series: DataFrame, limit: int = 3, least: float = 10.0, by: list[str] | None = None) -> DataFrame:
    """``(*by, pos)``: break points of each series by recursive splitting at the point furthest from the chord.

    A segment of more than four points splits at the first of its five furthest
    points that lies more than ``least`` away and more than ``limit`` points from
    both ends.  A series has a row per month, so one group is small; many series run side by side.
    """
    by = by or []
    kinds = dict(series.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        found = pdf["pos"].to_numpy()[_breaks(pdf["n"].to_numpy(float), limit, least)]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(found) for c in by}, "pos": found})

    rows = series.select(*by, "pos", "n", F.lit(0).alias("_one"))
    return rows.groupBy(*(by or ["_one"])).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "pos int"]))


def without_january(series: DataFrame, month: str = "month") -> DataFrame:
    """The series less its Januaries, into which journals without a month put their papers."""
    return series.filter(F.col(month) % 100 != 1)


def time_line(series: DataFrame, limit: int = 3, least: float = 10.0, head: int = 12, tail: int = 6, remove_big: bool = False, combine: int = 0) -> DataFrame:
    """``(period, lo, hi)``: half-open periods of months between the breaks of a trimmed monthly series.

    ``remove_big`` leaves the Januaries out; ``combine`` adds up so many consecutive months, two or more, into one point
    named by its first month.
    """
    if remove_big:
        series = without_january(series)
    if combine > 1:
        series = bucket_months(series, combine).select(F.col("first_month").alias("month"), "n")
    numbered = stage(series.withColumn("at", (F.row_number().over(Window.orderBy("month")) - 1).cast("int")))
    total = numbered.count()
    inner = numbered.filter((F.col("at") >= head) & (F.col("at") < total - tail)).select((F.col("at") - head).cast("int").alias("pos"), "n")
    at = segment_breaks(inner, limit, least).select((F.col("pos") + head).cast("int").alias("at"))
    ends = numbered.filter((F.col("at") == 0) | (F.col("at") == max(0, total - tail - 1))).select("at")
    months = at.union(ends).distinct().join(numbered, "at").select("month")
    w = Window.orderBy("month")
    return months.select((F.row_number().over(w) - 1).cast("int").alias("period"), F.col("month").alias("lo"), F.lead("month").over(w).alias("hi")).filter("hi is not null")
