"""Synonym and stop-word dictionaries from several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.text import abbreviation_parts, ascii_only


def merge_synonyms(*tables: DataFrame) -> DataFrame:
    """``(word, synonyms)``: the union of dictionaries ``(word, synonyms array)``; a word without any keeps an empty list."""
    out = None
    for t in tables:
        rows = t.select(F.lower(F.trim("word")).alias("word"), F.explode_outer("synonyms").alias("s"))
        out = rows if out is None else out.unionByName(rows)
    out = out.filter("word is not null and word <> ''").select("word", F.nullif(F.lower(F.trim("s")), F.lit("")).alias("s"))
    return out.groupBy("word").agg(F.array_sort(F.collect_set("s")).alias("synonyms"))


def stop_words(rows: DataFrame, column: str) -> DataFrame:
    """``(word)``: lower-cased, trimmed, ASCII only, each once; full names with abbreviations count as two terms."""
    terms = rows.filter(F.col(column).isNotNull()).select(F.explode(abbreviation_parts(F.col(column))).alias("word"))
    return terms.select(F.lower(F.trim("word")).alias("word")).filter(ascii_only(F.col("word")) & (F.col("word") != "")).distinct()


def split_terms(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, pos, term)``: a text cut at commas and brackets, trimmed of blanks, commas and hyphens."""
    parts = F.filter(F.transform(F.split(column, "[,()]+"), lambda x: F.btrim(x, F.lit(" ,-"))), lambda x: x != "")
    return rows.select(key, F.posexplode(parts).alias("pos", "term"))


def three_line_records(lines: DataFrame) -> DataFrame:
    """``(record, word, html)`` from numbered lines ``(line, value)``: a key, its page, a line to skip; with a column ``file``, in each file."""
    by = ["file"] if "file" in lines.columns else []
    at = lines.withColumn("record", F.floor(F.col("line") / 3).cast("bigint")).withColumn("part", F.col("line") % 3)
    return at.groupBy(*by, "record").agg(F.max(F.when(F.col("part") == 0, F.trim("value"))).alias("word"), F.max(F.when(F.col("part") == 1, F.col("value"))).alias("html"))


# ---- further layouts --------------------------------------------------------------


def keyed_lines(lines: DataFrame, column: str = "value", separator: str = ",") -> DataFrame:
    """``(word, synonyms)`` of lines ``word,synonym,synonym``; a line without synonyms has an empty list."""
    parts = F.split(column, separator)
    return lines.filter(F.col(column) != "").select(parts[0].alias("word"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))).alias("synonyms"))


def listed_columns(rows: DataFrame, word: str, *columns: str, separator: str = ", ") -> DataFrame:
    """``(word, synonyms)`` of a table whose columns hold quoted lists; null columns add nothing."""
    one = lambda c: F.coalesce(F.split(F.btrim(F.col(c), F.lit('"')), separator), F.array().cast("array<string>"))
    return rows.select(F.col(word).alias("word"), F.filter(F.concat(*map(one, columns)), lambda s: s != "").alias("synonyms"))


def delimited_terms(lines: DataFrame, separator: str, column: str = "value") -> DataFrame:
    """``(word)``: the pieces of every line; empty ones are left out."""
    return lines.select(F.explode(F.split(column, separator)).alias("word")).filter("word <> ''")


def nested_terms(documents: DataFrame, column: str, path: str, field: str = "c", skip: int = 0, edges: str = " ") -> DataFrame:
    """``(pos, word)``: a field of all objects in the list at ``path`` of a JSON document but the first ``skip``.

    ``path`` is a JSON path such as ``$['document.xml'][0].c[1].c``; ``edges`` are trimmed.  Documents without the path give no row.
    """
    found = F.from_json(F.get_json_object(column, path), f"array<struct<`{field}`: string>>")
    rows = documents.select(F.posexplode(found).alias("pos", "_o")).filter(F.col("pos") >= skip)
    return rows.select("pos", F.btrim(F.col(f"_o.{field}"), F.lit(edges)).alias("word")).filter("word is not null and word <> ''")


def patched(words: DataFrame, column: str, remove: list[str], add: list[str]) -> DataFrame:
    """The words less some known to be wrong, and with some put in their place."""
    kept = words.filter(~F.col(column).isin(*remove)) if remove else words
    if not add:
        return kept.select(column)
    more = words.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, add))).alias(column))
    return kept.select(column).unionByName(more)


def inverted_index(phrases: DataFrame, phrase: str) -> DataFrame:
    """``(word, phrases)``: for each component word the sorted phrases of ``_``-joined words it is in."""
    rows = phrases.select(F.col(phrase).alias("_p")).distinct().select("_p", F.explode(F.array_distinct(F.split("_p", "_"))).alias("word")).filter("word <> ''")
    return rows.groupBy("word").agg(F.array_sort(F.collect_list("_p")).alias("phrases"))


def phrases_of(tokens: DataFrame, token: str, index: DataFrame) -> DataFrame:
    """``tokens`` with the ``phrases`` each may be part of; an empty list for words in none."""
    joined = tokens.join(index.select(F.col("word").alias(token), "phrases"), token, "left")
    return joined.withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))


def without_stop_words(text: Column, stop: Column) -> Column:
    """A raw text less the words, compared in lower case, that stand in the array ``stop``; blanks are made single."""
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.array_contains(stop, F.lower(w))), " ")
