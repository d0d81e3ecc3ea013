"""Data frames behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators.series import standardise


def curve_with_breaks(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(label, month, n)``: the whole curve and, as a second group, its break points."""
    months = bounds.select(F.explode(F.array("lo", "hi")).alias("month")).distinct()
    return series.select(F.lit("curve").alias("label"), "month", "n").union(series.join(months, "month").select(F.lit("break"), "month", "n"))


def yearly_contrast(**series: DataFrame) -> DataFrame:
    """``(year, name, n, score)``: several yearly series, each standardised, joined by year and not by position."""
    out = None
    for name, s in sorted(series.items()):
        part = standardise(s.select("year", F.lit(name).alias("name"), F.col("n").cast("double").alias("n")), "n", "score")
        out = part if out is None else out.unionByName(part)
    return out


def node_size(nodes: DataFrame) -> DataFrame:
    """Adds the drawing size: 20 for each word of a community, 200 for a mix."""
    return nodes.withColumn("size", F.when(F.col("id").startswith("mix"), F.lit(200)).otherwise(F.col("score") * 20))


def subgraph_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes (id)``."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return edges


#: Codes of nodes without an event of their own in the coloured graph.
MIX_CODE, OTHER_CODE = 7, 8


def coloured_nodes(nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """``(id, group, score, code, size)``: evolution nodes with their event's code, 7 for a mix, 8 for a community without event."""
    named = codes.select(F.format_string("comm%d-%d", F.col("comm").cast("bigint"), "period").alias("id"), F.col("code"))
    code = F.when(F.col("id").startswith("mix"), MIX_CODE).otherwise(F.coalesce("code", F.lit(OTHER_CODE)))
    return node_size(nodes.join(named, "id", "left")).select("id", "group", "score", code.alias("code"), "size")


def coloured_edges(edges: DataFrame, coloured: DataFrame) -> DataFrame:
    """``(src, dst, weight, code)``: evolution edges with the code of their community's end."""
    codes = coloured.select("id", "code")
    end = F.when(F.col("src").startswith("mix"), F.col("dst")).otherwise(F.col("src"))
    return edges.withColumn("id", end).join(codes, "id").select("src", "dst", "weight", "code")


def lists_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, values)``: rows of each key and the sorted list of its different values."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(value)).alias("values"))


def covered_sets(sets: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, by)``: sets that lie within another one; sets meet on their rarest member only, equal sets by the smaller key.

    A set within another shares all its members with it, the rarest too.
    """
    rows = sets.select(key, F.array_distinct(column).alias("_v")).filter("size(_v) > 0")
    members = rows.select(key, F.explode("_v").alias("_m"))
    rare = members.join(members.groupBy("_m").agg(F.count("*").alias("_n")), "_m").groupBy(key).agg(F.min_by("_m", F.struct("_n", "_m")).alias("_m"))
    inner = rows.join(rare, key)
    outer = members.withColumnRenamed(key, "by").join(rows.select(F.col(key).alias("by"), F.col("_v").alias("_w")), "by")
    met = inner.join(outer, "_m").filter((F.col(key) != F.col("by")) & (F.size(F.array_except("_v", "_w")) == 0))
    return met.filter((F.size("_v") < F.size("_w")) | (F.col("by") < F.col(key))).select(key, "by")
