"""Communities over time: links between periods, their words, and life-cycle events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def link_by_overlap(members: DataFrame, mixes: DataFrame, link_without_overlap: bool = True) -> DataFrame:
    """``(side, period, comm, mix_period, mix, overlap)``: the mix that shares most words with each community.

    ``members`` is ``(period, comm, word)``; ``mixes`` is ``(mix_period, mix, word)``
    where mix period ``p`` covers the periods ``p`` and ``p + 1``.  A community of
    period ``p`` is old in mix period ``p`` and new in ``p - 1``.  Ties go to the lowest mix;
    without any overlap the lowest mix is taken, or no row given if ``link_without_overlap`` is off.
    """
    distinct = members.select("period", "comm", "word").distinct()
    sides = F.array(F.struct(F.lit("old").alias("side"), F.col("period").alias("mix_period")), F.struct(F.lit("new").alias("side"), (F.col("period") - 1).alias("mix_period")))
    placed = distinct.select("period", "comm", "word", F.explode(sides).alias("_s")).select("_s.side", "_s.mix_period", "period", "comm", "word")
    lowest = mixes.groupBy("mix_period").agg(F.min("mix").alias("lowest"))
    keys = ["side", "period", "comm", "mix_period"]
    counts = placed.join(mixes.select("mix_period", "mix", "word").distinct(), ["mix_period", "word"]).groupBy(*keys, "mix").agg(F.count("*").alias("overlap"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct("mix", "overlap"), F.struct(-F.col("overlap"), F.col("mix"))).alias("_b")).select(*keys, "_b.mix", "_b.overlap")
    if not link_without_overlap:
        return best
    every = placed.select(*keys).distinct().join(lowest, "mix_period")
    return every.join(best, keys, "left").select(*keys, F.coalesce("mix", "lowest").alias("mix"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def mix_links(links: DataFrame, mixes: DataFrame) -> DataFrame:
    """``(mix_period, mix, old, new)``: for every mix the sorted lists of its old and new communities, empty ones too."""
    lists = links.groupBy("mix_period", "mix").agg(
        F.array_sort(F.collect_set(F.when(F.col("side") == "old", F.col("comm")))).alias("old"), F.array_sort(F.collect_set(F.when(F.col("side") == "new", F.col("comm")))).alias("new")
    )
    empty = F.array().cast(lists.schema["old"].dataType)
    every = mixes.select("mix_period", "mix").distinct().join(lists, ["mix_period", "mix"], "left")
    return every.select("mix_period", "mix", F.coalesce("old", empty).alias("old"), F.coalesce("new", empty).alias("new"))


def lifecycle(lists: DataFrame) -> DataFrame:
    """``(period, comm, event, n)`` from the mixes' old and new communities.

    inherit: one old and one new, both; divide: one old and several new, the old one;
    merge: several old and one new, the new one.  New communities without old ones have no past, old
    ones without new ones no future: no past only is new_born, no future only is die_out,
    both is isolate.  ``n`` counts how often an event is given to a community.
    """
    o, n = F.size("old"), F.size("new")
    at = lambda comms, shift, event: F.transform(comms, lambda c: F.struct((F.col("mix_period") + shift).alias("period"), c.alias("comm"), F.lit(event).alias("event")))
    none = F.array().cast("array<struct<period:int,comm:bigint,event:string>>")
    pick = lambda test, value: F.when(test, value).otherwise(F.array())
    rows = lists.select(
        "mix_period",
        F.concat(
            pick((o == 1) & (n == 1), F.concat(at("old", 0, "inherit"), at("new", 1, "inherit"))),
            pick((o == 1) & (n > 1), at("old", 0, "divide")),
            pick((o > 1) & (n == 1), at("new", 1, "merge")),
            pick(o == 0, at("new", 1, "no_past")),
            pick(n == 0, at("old", 0, "no_future")),
        ).alias("_e"),
    )
    events = rows.select(F.explode("_e").alias("_e")).select("_e.period", "_e.comm", "_e.event")
    plain = events.filter(F.col("event").isin("inherit", "divide", "merge")).groupBy("period", "comm", "event").agg(F.count("*").alias("n"))
    ends = events.filter(F.col("event").isin("no_past", "no_future")).groupBy("period", "comm").agg(F.max(F.col("event") == "no_past").alias("p"), F.max(F.col("event") == "no_future").alias("q"))
    kind = F.when(F.col("p") & F.col("q"), "isolate").when(F.col("p"), "new_born").otherwise("die_out")
    return plain.unionByName(ends.select("period", "comm", kind.alias("event"), F.lit(1).cast("bigint").alias("n")))


def best_word_links(links: DataFrame, members: DataFrame, similarity: DataFrame) -> DataFrame:
    """``(mix_period, mix, comm, word, best, similarity)``: for each word of a new community the most similar word of the mix's old ones.

    ``similarity`` is ``(a, b, similarity)`` with both directions; pairs without a row, or not above 0, count as none.
    """
    words = links.join(members.select("period", "comm", "word").distinct(), ["period", "comm"]).select("side", "mix_period", "mix", "comm", "word")
    new = words.filter("side = 'new'").select("mix_period", "mix", "comm", "word")
    old = words.filter("side = 'old'").select("mix_period", "mix", F.col("word").alias("b")).distinct()
    # equi-join on the similar pairs first: no words x words product
    close = new.join(similarity.filter("similarity > 0").select(F.col("a").alias("word"), "b", "similarity"), "word").join(old, ["mix_period", "mix", "b"])
    keys = ["mix_period", "mix", "comm", "word"]
    best = close.groupBy(*keys).agg(F.min_by(F.struct(F.col("b").alias("best"), "similarity"), F.struct(-F.round("similarity", 9), F.col("b"))).alias("_b"))
    both = old.select("mix_period", "mix").distinct()
    return new.join(both, ["mix_period", "mix"], "left_semi").join(best, keys, "left").select(*keys, F.coalesce("_b.best", F.lit("")).alias("best"), F.coalesce("_b.similarity", F.lit(0.0)).alias("similarity"))


def evolution_nodes(members: DataFrame, links: DataFrame, lists: DataFrame) -> DataFrame:
    """``(id, label, group, score)`` of communities and mixes; ``score`` is the number of words, a mix counts its communities."""
    comms = members.groupBy("period", "comm").agg(F.count_distinct("word").alias("score"))
    comms = comms.select(F.format_string("comm%d-%d", "comm", "period").alias("id"), F.col("period").cast("double").alias("group"), "score")
    mix = lists.select(F.format_string("mix%d-%.1f", "mix", F.col("mix_period") + F.lit(0.5)).alias("id"), (F.col("mix_period") + 0.5).alias("group"), (F.size("old") + F.size("new")).cast("bigint").alias("score"))
    return comms.unionByName(mix).select("id", F.col("id").alias("label"), "group", "score")


def evolution_edges(links: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: communities to their mix, weighted by shared words."""
    comm, mix = F.format_string("comm%d-%d", "comm", "period"), F.format_string("mix%d-%.1f", "mix", F.col("mix_period") + F.lit(0.5))
    old = F.col("side") == "old"
    return links.select(F.when(old, comm).otherwise(mix).alias("src"), F.when(old, mix).otherwise(comm).alias("dst"), F.col("overlap").cast("bigint").alias("weight"))


def parse_node_id(ids: DataFrame, column: str) -> DataFrame:
    """Adds ``kind, number, period`` of ids such as ``comm3-7`` and ``mix2-7.5``."""
    c = F.col(column)
    return ids.withColumn("kind", F.regexp_extract(c, "^([a-z]+)", 1)).withColumn("number", F.regexp_extract(c, r"^[a-z]+(\d+)-", 1).cast("int")).withColumn("period", F.floor(F.split_part(c, F.lit("-"), F.lit(2)).cast("double")).cast("int"))


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one written last."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


#: Codes of the events in the coloured graph, a later one wins.
EVENT_CODES = {"new_born": 1, "die_out": 2, "inherit": 3, "divide": 4, "merge": 5, "isolate": 6}


def event_codes(events: DataFrame) -> DataFrame:
    """``(period, comm, code)``: the highest event code of each community."""
    code = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    return events.groupBy("period", "comm").agg(F.max(code[F.col("event")]).alias("code"))


def pair_relevance(members: DataFrame, least: float = 0.0) -> DataFrame:
    """``(period, comm, next_comm, shared, relevance)``: communities of two periods in a row that share words.

    ``relevance`` is the shared words by all words of both.  Pairs meet on a shared word, so
    communities without one are never paired.
    """
    words = members.select("period", "comm", "word").distinct()
    size = words.groupBy("period", "comm").agg(F.count("*").alias("size"))
    later = words.select((F.col("period") - 1).alias("period"), F.col("comm").alias("next_comm"), "word")
    shared = words.join(later, ["period", "word"]).groupBy("period", "comm", "next_comm").agg(F.count("*").alias("shared"))
    later_size = size.select((F.col("period") - 1).alias("period"), F.col("comm").alias("next_comm"), F.col("size").alias("next_size"))
    out = shared.join(size, ["period", "comm"]).join(later_size, ["period", "next_comm"])
    return out.withColumn("relevance", F.col("shared") / (F.col("size") + F.col("next_size") - F.col("shared"))).filter(F.col("relevance") > least).select("period", "comm", "next_comm", "shared", "relevance")
