"""Tokens of the corpus: counts, filters, windows, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicweave.functions.text import sentences
from topicweave.operators.groups import with_stats


def token_rows(papers: DataFrame, key: str = "paper_id", column: str = "title_abstract") -> DataFrame:
    """``(key, sent, pos, token)``: the tokens of a ``;``-joined text with ``#`` between sentences."""
    out = papers.select(F.col(key), F.posexplode(sentences(F.col(column))).alias("sent", "_s"))
    return out.select(key, "sent", F.posexplode("_s").alias("pos", "token"))


def frequent_words(tokens: DataFrame, most: int = 100) -> DataFrame:
    """``(token, n)``: the most frequent tokens, ties by token.  A top-k, ``most`` rows."""
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def without_words(tokens: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """Tokens that aren't among ``words`` (compared trimmed and in lower case)."""
    stop = words.select(F.lower(F.trim(word)).alias("token")).filter("token is not null").distinct()
    return tokens.join(stop, "token", "left_anti")


def vocabulary(tokens: DataFrame, least: int = 4) -> DataFrame:
    """``(token, n)`` of the tokens that occur ``least`` times or more."""
    return tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def window_pairs(tokens: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``(*keys, token, other, gap)``: each token with each of the ``size`` that follow it in its sentence."""
    w = Window.partitionBy(*keys).orderBy("pos")
    ahead = F.array(*[F.struct(F.lead("token", i).over(w).alias("other"), F.lit(i).alias("gap")) for i in range(1, size + 1)])
    rows = tokens.select(*keys, "token", ahead.alias("_a"))
    return rows.select(*keys, "token", F.explode("_a").alias("_x")).select(*keys, "token", F.col("_x.other").alias("other"), F.col("_x.gap").alias("gap")).filter("other is not null")


def skip_grams(tokens: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``(centre, context, n)``: how often each word stands within ``size`` places of another, both ways."""
    pairs = window_pairs(tokens, keys, size)
    both = pairs.select(F.col("token").alias("centre"), F.col("other").alias("context")).union(pairs.select("other", "token"))
    return both.groupBy("centre", "context").agg(F.count("*").alias("n"))


def kept_by_subsampling(counts: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """Adds ``keep``: the probability ``min(1, sqrt(threshold / share))`` of keeping an occurrence of a word."""
    share = F.col("n") / F.col("_all")
    return with_stats(counts, [], _all=F.sum("n")).withColumn("keep", F.least(F.lit(1.0), F.sqrt(threshold / share))).drop("_all")


def ranked_phrases(papers: DataFrame, key: str, column: str, most: int = 3) -> DataFrame:
    """``(key, phrase, score, rank)``: the best one- and two-word phrases of a text by TF-IDF; an approximation of ranking by a language model."""
    tokens = token_rows(papers, key, column)
    pairs = tokens.withColumn("next", F.lead("token").over(Window.partitionBy(key, "sent").orderBy("pos")))
    phrases = pairs.select(key, "token").union(pairs.filter("next is not null").select(key, F.concat_ws("_", "token", "next"))).toDF(key, "phrase")
    counts = phrases.groupBy(key, "phrase").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("phrase").agg(F.count("*").alias("df"))
    total = papers.select(F.count_distinct(key).alias("docs"))
    scored = counts.join(idf, "phrase").crossJoin(F.broadcast(total)).withColumn("score", F.col("tf") * F.log((F.col("docs") + 1) / (F.col("df") + 1)))  # one row by construction
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "phrase"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "phrase", "score", "rank")


def negative_weights(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """Adds ``weight``: the share of a word among draws of negative samples, counts to the ``power``."""
    p = F.pow("n", F.lit(power))
    return with_stats(counts, [], _all=F.sum(p)).withColumn("weight", p / F.col("_all")).drop("_all")


def sentence_lengths(tokens: DataFrame, key: str = "paper_id", seed: int = 3) -> DataFrame:
    """``(key, sent, before, after)``: tokens of each sentence before and after sub-sampling; draws come from hashes of the place, so they repeat."""
    keep = kept_by_subsampling(tokens.groupBy("token").agg(F.count("*").alias("n"))).select("token", "keep")
    draw = hash_share(*(F.col(c).cast("string") for c in (key, "sent", "pos")), F.lit(str(seed)))
    return tokens.join(keep, "token").groupBy(key, "sent").agg(F.count("*").alias("before"), F.count_if(draw < F.col("keep")).alias("after"))


def negative_draws(pairs: DataFrame, weights: DataFrame, times: int = 2, seed: int = 9) -> DataFrame:
    """``(centre, context, turn, negative)``: words drawn by ``weight`` for each pair, ``times`` each.

    A draw is a number in 0..1 from a hash of pair and turn, so it repeats.  The words lie on that line by hash bucket and name; their
    ends are sums over the buckets, then within one.  Draws and words meet in one of 4,096 slices of the line.
    """
    share = with_stats(weights.select("token", "weight"), [], _all=F.sum("weight")).select("token", (F.col("weight") / F.col("_all")).alias("p"), F.substring(F.md5("token"), 1, 2).alias("_b"))
    sums = share.groupBy("_b").agg(F.sum("p").alias("_s"))  # 256 rows at most
    base = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_base"))
    upto = F.sum("p").over(Window.partitionBy("_b").orderBy("token").rowsBetween(Window.unboundedPreceding, 0))
    line = share.withColumn("_upto", upto).join(F.broadcast(base), "_b").select("token", (F.col("_base") + F.col("_upto") - F.col("p")).alias("lo"), (F.col("_base") + F.col("_upto")).alias("hi"))
    at = lambda c: F.least(F.floor(c * 4096), F.lit(4095)).cast("int")
    line = line.select("token", "lo", "hi", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))).alias("_slice"))
    turns = pairs.select("centre", "context", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn"))
    drawn = turns.withColumn("_u", hash_share("centre", "context", F.col("turn").cast("string"), F.lit(str(seed))))
    met = drawn.withColumn("_slice", at(F.col("_u"))).join(line, "_slice").filter("_u >= lo and _u < hi")
    return met.select("centre", "context", "turn", F.col("token").alias("negative"))


def hash_share(*parts) -> Column:
    """A number in 0..1, the same whenever the parts are."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def long_lengths(lengths: DataFrame, most: int = 40, key: str = "paper_id") -> DataFrame:
    """``(place, kind, tokens)``: lengths before and after sub-sampling of the first ``most`` sentences, one row each; a report."""
    first = lengths.orderBy(key, "sent").limit(most).withColumn("place", F.row_number().over(Window.orderBy(key, "sent")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("tokens")) for k in ("before", "after")))
    return first.select("place", F.explode(kinds).alias("_k")).select("place", "_k.kind", "_k.tokens")
