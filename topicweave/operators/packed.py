"""One row per value of a packed field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.packed import normal_term, split_packed


def explode_packed(df: DataFrame, key: str, column: str, persons: bool = False) -> DataFrame:
    """``(key, pos, item)``: one row per value of ``column``, ``pos`` from 0.

    Only the two named columns are read, so other columns, whatever their
    names, do no harm.  Null and empty fields give no row; a null key stays
    null.  Rows are not made distinct here: pass distinct rows if a record may
    come twice.  No shuffle.
    """
    items = split_packed(df[column], persons)
    # the outer form: for the inner one the optimiser adds a filter that splits every field again
    rows = df.select(df[key].alias("_k"), F.posexplode_outer(items).alias("_p", "_i")).filter("_i is not null")
    return rows.select(F.col("_k").alias(key), F.col("_p").cast("int").alias("pos"), F.col("_i").alias("item"))


def record_terms(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, terms)``: the normalised terms of each record as an array.

    One row per input row; repeated terms stay, empty ones go.
    """
    terms = F.filter(F.transform(split_packed(df[column]), normal_term), lambda t: t != "")
    return df.select(df[key].alias(key), terms.alias("terms"))
