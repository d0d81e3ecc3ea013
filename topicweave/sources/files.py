"""Readers and writers of the pipeline's file layouts."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from topicweave.plans.stage import scratch

PAPER = T.StructType([T.StructField(c, T.StringType()) for c in ("Authors", "Author Full Names", "Article Title", "Author Keywords", "Keywords Plus", "Abstract")] + [T.StructField("Publication Year", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("Publication Date", "Source Title", "DOI")])


def read_papers(spark: SparkSession, *paths: str, index: bool = False) -> DataFrame:
    """Papers of several CSV files with a header; missing columns are null, blank lines are skipped, and so is a leading number with ``index``."""
    out = None
    for path in paths:
        schema = T.StructType([T.StructField("index", T.LongType()), *PAPER.fields]) if index else PAPER
        part = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).schema(schema).csv(path).select(*(f"`{c}`" for c in PAPER.fieldNames()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_bare_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file without header; empty cells are null."""
    return spark.read.option("escape", '"').schema(schema).csv(path)


def read_excel(spark: SparkSession, *paths: str) -> DataFrame:
    """Papers of spreadsheets; needs a pandas Excel engine on the driver, as Spark has no such source."""
    import pandas as pd

    frames = [pd.read_excel(p, usecols=lambda c: c in PAPER.fieldNames()) for p in paths]
    return spark.createDataFrame(pd.concat(frames, ignore_index=True).astype(object).where(lambda d: d.notna(), None), PAPER)


def write_csv(df: DataFrame, path: str, index: bool = False) -> None:
    """CSV with a header; lists are joined by ``;``.  ``index`` adds a leading number."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if isinstance(t.dataType, T.ArrayType) else F.col(c) for c, t in zip(df.columns, df.schema)]
    out = df.select(*flat)
    if index:
        out = out.select(F.monotonically_increasing_id().alias("index"), *out.columns)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ragged(df: DataFrame, column: str, path: str) -> None:
    """One comma-joined line per list; a plain value is a line of its own."""
    c = F.col(column)
    line = F.array_join(c.cast("array<string>"), ",") if isinstance(df.schema[column].dataType, T.ArrayType) else c.cast("string")
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """``(members)``: lists of a ragged file, one per line."""
    return spark.read.text(path).filter("value <> ''").select(F.split("value", ",").alias("members"))


def read_json_value(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(value)``: a file that holds one JSON value, read with an explicit schema."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value"))


def write_json_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object with an entry per row.  For small results: the object is one row."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value")))))
    df.agg(F.to_json(entries).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_three_line(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files, lines numbered from 0 in each.

    A file is read in splits: their lines are counted first, and a line's number is its place in its split
    after all lines of the splits before.  Blank lines count.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    # rows of one split come in order, and their numbers rise with it
    first = lines.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = first.withColumn("_before", F.coalesce(upto, F.lit(0)))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line"), "value")


_KINDS = {"string": "string", "double": "double", "float": "float", "bigint": "long", "int": "int", "boolean": "boolean"}


def _text(c: Column) -> Column:
    """A value as the text of an XML element."""
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _attribute(name: str, value: Column) -> Column:
    """`` name="value"``; a null value reads None."""
    c = _text(F.coalesce(value.cast("string"), F.lit("None")))
    for raw, code in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return F.concat(F.lit(f" {name}=\""), c, F.lit('"'))


def _element(tag: str, attributes: dict[str, Column], *inner: Column) -> Column:
    """An element with its attributes and what is in it, nulls left out."""
    return F.concat(F.lit(f"<{tag}"), *(_attribute(n, c) for n, c in attributes.items()), F.lit(">"), F.concat_ws("", *inner), F.lit(f"</{tag}>"))


def _names(tag: str, **attributes: str) -> str:
    """One of the document's few elements about its columns."""
    return ET.tostring(ET.Element(tag, {n.replace("_", "."): v for n, v in attributes.items()}), encoding="unicode")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, id: str = "id", src: str = "src", dst: str = "dst") -> None:
    """GraphML of an evolution graph of any size: executors write the elements, in order of their ids."""
    keys, bodies = [], []
    for df, kind, attrs in ((nodes, "node", {"id": id}), (edges, "edge", {"source": src, "target": dst})):
        inner = []
        for c, t in df.dtypes:
            if c not in attrs.values():
                inner.append(F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<data key="d{len(keys)}">'), _text(F.col(f"`{c}`").cast("string")), F.lit("</data>"))))
                keys.append(_names("key", id=f"d{len(keys)}", **{"for": kind, "attr_name": c, "attr_type": _KINDS.get(t, "string")}))
        bodies.append(df.orderBy(*attrs.values()).select(_element(kind, {a: F.col(c) for a, c in attrs.items()}, *inner).alias("value")))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(keys) + '<graph edgedefault="undirected">\n'
    _put(nodes.sparkSession, path, head, *bodies, "</graph></graphml>")


def _put(spark: SparkSession, path: str, *pieces: str | DataFrame) -> None:
    """Writes a document of texts and tables of one text column, by the file system of its path; tables are written in parts first and never come to the driver's Python."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(b'<?xml version="1.0" encoding="utf-8"?>\n'))
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            folder = scratch(spark)
            piece.write.option("compression", "none").text(folder)
            parts = jvm.org.apache.hadoop.fs.Path(folder)
            fs = parts.getFileSystem(conf)
            for name in sorted(f.getPath().getName() for f in fs.listStatus(parts)):
                if name.startswith("part-"):
                    part = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                    finally:
                        part.close()
            fs.delete(parts, True)
    finally:
        out.close()


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, id: str = "id", src: str = "src", dst: str = "dst") -> None:
    """GEXF of an evolution graph of any size, written like :func:`write_graphml`; edges are numbered in order, with gaps between parts."""
    names = [c for c in nodes.columns if c != id]
    types = dict(nodes.dtypes)
    attributes = "".join(_names("attribute", id=str(i), title=c, type=_KINDS.get(types[c], "string")) for i, c in enumerate(names))
    values = [F.when(F.col(f"`{c}`").isNotNull(), _element("attvalue", {"for": F.lit(i), "value": F.col(f"`{c}`")})) for i, c in enumerate(names)]
    label = F.col("label" if "label" in names else id)
    body = nodes.orderBy(id).select(_element("node", {"id": F.col(id), "label": label}, F.lit("<attvalues>"), *values, F.lit("</attvalues>")).alias("value"))
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    links = edges.orderBy(src, dst).withColumn("_n", F.monotonically_increasing_id()).select(_element("edge", {"id": F.col("_n"), "source": F.col(src), "target": F.col(dst), "weight": weight}).alias("value"))
    head = f'<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected" mode="static"><attributes class="node">{attributes}</attributes><nodes>\n'
    _put(nodes.sparkSession, path, head, body, "</nodes><edges>\n", links, "</edges></graph></gexf>")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` with their attributes as ``map<string, string>`` by attribute name."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path)
    names = keys.agg(F.map_from_entries(F.collect_list(F.struct("_id", F.col("`_attr.name`")))).alias("names"))
    data = "data array<struct<_VALUE string, _key string>>"

    def rows(tag: str, ids: dict[str, str]) -> DataFrame:
        schema = ", ".join([*(f"{c} string" for c in ids), data])
        df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).crossJoin(F.broadcast(names))  # one row by construction
        entries = F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.col("names")[d["_key"]], d["_VALUE"]))
        return df.select(*(F.col(c).alias(n) for c, n in ids.items()), F.map_from_entries(entries).alias("attributes"))

    return rows("node", {"_id": "id"}), rows("edge", {"_source": "src", "_target": "dst"})
