"""A corpus mixed from several sources to target weights, by min-cost flow over membership patterns."""

from __future__ import annotations

import base64
import os
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicweave.plans.stage import stage

#: Where the vocabulary of a public byte-level tokenizer lies; read on the driver only.
VOCABULARY = os.environ.get("TOPICWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: A vocabulary file of more bytes than this isn't sent to the executors.
_MOST_BYTES = 64 << 20
#: Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict[int, tiktoken.Encoding] = {}


def _encoder(vocabulary: bytes) -> tiktoken.Encoding:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def token_counts(documents: DataFrame, key: str, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc, tokens, *keep)``: the size of each text in tokens of a public tokenizer; 0 for null texts.

    ``vocabulary`` is a file of ranks on the driver; its content goes to the executors.
    """
    if os.path.getsize(vocabulary) > _MOST_BYTES:
        raise ValueError(f"{vocabulary} has more than {_MOST_BYTES} bytes")
    with open(vocabulary, "rb") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *batch.columns[2:]], ["doc", "tokens", *keep])

    rows = documents.select(documents[key].cast("bigint").alias("doc"), documents[text].alias("_text"), *(documents[c] for c in keep))
    kinds = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(count, f"doc bigint, tokens bigint{kinds}")


def normal_source(c: Column) -> Column:
    """Sources are equal if they agree ignoring case and outer blanks; empty ones are none."""
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))


class Flow:
    """Flow of least cost from membership patterns to sources.

    A pattern's tokens may be used in further layers, each dearer than all before.
    Layers are opened from the cheapest on; within one, tokens go along augmenting paths that
    move what other patterns gave before.  What the open layers give is never taken back, so
    the flow is the largest at every stage, and its cost the least.  A path
    runs over sources only: a step from ``s`` to ``t`` takes a pattern that gives to ``s`` and belongs to ``t`` too.
    """

    def __init__(self, patterns: list[tuple[tuple[str, ...], int]], quota: dict[str, int]):
        self.patterns, self.room = patterns, dict(quota)
        self.given: dict[tuple[int, str], int] = defaultdict(int)
        self.movable: dict[tuple[str, str], dict[int, None]] = defaultdict(dict)  # ordered sets

    def _give(self, p: int, s: str, amount: int) -> None:
        self.given[p, s] += amount
        for t in self.patterns[p][0]:
            if t != s:
                if self.given[p, s]:
                    self.movable[s, t][p] = None
                else:
                    self.movable[s, t].pop(p, None)

    def _path(self, p: int) -> list[tuple[str, int | None]] | None:
        """Sources from one of the pattern's to one with room, each with the pattern moved from it to the next."""
        via: dict[str, tuple[str, int] | None] = {s: None for s in self.patterns[p][0]}
        waiting = deque(via)
        while waiting:
            s = waiting.popleft()
            if self.room[s] > 0:
                path: list[tuple[str, int | None]] = [(s, None)]
                while (step := via[path[0][0]]) is not None:
                    path.insert(0, step)
                return path
            for t in self.room:
                if t not in via and self.movable[s, t]:
                    via[t] = (s, next(iter(self.movable[s, t])))
                    waiting.append(t)
        return None

    def add(self, p: int, tokens: int) -> int:
        """Sends up to so many tokens of a pattern; gives how many found a place."""
        left = tokens
        while left > 0 and (path := self._path(p)) is not None:
            amount = min([left, self.room[path[-1][0]], *(self.given[q, s] for s, q in path if q is not None)])
            self._give(p, path[0][0], amount)
            for (s, q), (t, _) in zip(path, path[1:]):
                self._give(q, s, -amount)
                self._give(q, t, amount)
            self.room[path[-1][0]] -= amount
            left -= amount
        return tokens - left


def plan_mixture(patterns: list[tuple[tuple[str, ...], int]], quota: dict[str, int], repeat: dict[str, int]) -> tuple[list[tuple], dict[str, int]]:
    """``(ranges, reached)`` of one recipe.

    ``patterns`` holds ``(sources, tokens)``: all documents that belong to exactly these of the
    recipe's sources.  A document is used no more often than the strictest of its sources
    allows.  Ranges are ``(pattern number, source, low, high)`` over the pattern's tokens in selection
    order, one for each layer touched; ``reached`` are the tokens of every source.
    """
    layers = [min(repeat[s] for s in sources) if tokens else 0 for sources, tokens in patterns]
    flow, used = Flow(patterns, quota), [0] * len(patterns)
    open_ = [p for p in sorted(range(len(patterns)), key=lambda p: (len(patterns[p][0]), p)) if layers[p] > 0]
    layer = 0
    while open_ and any(r > 0 for r in flow.room.values()):
        still = []
        for p in open_:
            sent = flow.add(p, patterns[p][1])
            used[p] += sent
            # a pattern that finds no way now finds none later
            if sent == patterns[p][1] and layers[p] > layer + 1:
                still.append(p)
        open_, layer = still, layer + 1
    ranges, reached = [], {s: quota[s] - flow.room[s] for s in quota}
    for p, (sources, tokens) in enumerate(patterns):
        low = 0
        for s in sources:
            high = low + flow.given.get((p, s), 0)
            while low < high:
                end = min(high, (low // tokens + 1) * tokens)
                ranges.append((p, s, low % tokens, (end - 1) % tokens + 1))
                low = end
    return ranges, reached


_PLAN = "recipe string, name string, mine array<string>, low bigint, high bigint, quota bigint, reached bigint"


def _planned(total: int):
    """The plan of one recipe, from its targets and the sizes of its patterns."""

    def one(targets: pd.DataFrame, supply: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _PLAN.split(", ")]
        if not len(targets):
            return pd.DataFrame(columns=columns)
        recipe = targets["recipe"].iloc[0]
        rows = targets.sort_values("name")
        quota = {n: -int(-(w * b * total) // 1) for n, w, b in zip(rows["name"], rows["weight"], rows["budget_share"])}
        repeat = dict(zip(rows["name"], rows["max_repeat"].astype(int)))
        patterns = sorted((tuple(m), int(t)) for m, t in zip(supply["mine"], supply["tokens"]))
        ranges, reached = plan_mixture(patterns, quota, repeat)
        out = [(recipe, s, list(patterns[p][0]), low, high, None, None) for p, s, low, high in ranges]
        out += [(recipe, s, None, None, None, quota[s], reached[s]) for s in quota]
        return pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("low", "high", "quota", "reached")})

    return one


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 17, buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``(selection, report)`` of a corpus for each recipe.

    ``sized`` has ``doc`` (bigint), ``tokens`` (bigint) and ``sources`` (array of normalised
    source names; a document may belong to several).  ``targets`` has ``recipe, source, weight,
    max_repeat, budget_share``.

    - report ``(recipe, source, target_tokens, available_tokens, short)``, one row per target:
      ``short`` if the source can't fill its quota even with all repeats.
    - selection ``(recipe, source, doc, tokens, uses)``: the documents taken.  Within a pattern they
      come in an order drawn with ``seed``, so the actual size of a source is off by one
      document at the ends of its ranges.

    Documents are first added up by the recipe's sources they belong to, one
    number for each combination that occurs.  Each recipe's combinations, and nothing else, are one task's work.
    Positions within a combination are sums over ``buckets`` hash buckets, then over
    its full patterns in a bucket, then within these, so no task orders a whole combination.

    A null weight, share or repeat counts as 0; targets without recipe or source are left out,
    rows that repeat a recipe and source are added up (weights) at the strictest repeat.
    """
    clean = targets.select("recipe", "source", normal_source(F.col("source")).alias("name"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"), F.coalesce("budget_share", F.lit(0.0)).alias("budget_share"))
    wanted = clean.distinct().filter("recipe is not null and name is not null")
    wanted = stage(wanted.groupBy("recipe", "name").agg(F.min("source").alias("source"), F.sum("weight").alias("weight"), F.min("max_repeat").alias("max_repeat"), F.max("budget_share").alias("budget_share")))
    pattern = F.sort_array(F.array_distinct(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isNotNull())))
    docs = sized.filter("doc is not null").select("doc", F.coalesce("tokens", F.lit(0)).alias("tokens"), pattern.alias("pattern"))
    bucket = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(buckets)).cast("int")
    summed = stage(docs.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("tokens").alias("size")))
    total = summed.agg(F.sum("size")).first()[0] or 0
    patterns = summed.groupBy("pattern").agg(F.sum("size").alias("tokens"))
    parts = patterns.select("pattern", F.explode("pattern").alias("name")).join(wanted.select("recipe", "name"), "name")
    mine = stage(parts.groupBy("pattern", "recipe").agg(F.sort_array(F.collect_set("name")).alias("mine")))
    supply = mine.join(patterns, "pattern").groupBy("recipe", "mine").agg(F.sum("tokens").alias("tokens"))
    plan = stage(wanted.groupBy("recipe").cogroup(supply.groupBy("recipe")).applyInPandas(_planned(total), _PLAN))
    named = wanted.select("recipe", "name", "source")
    reported = plan.filter("quota is not null").join(named, ["recipe", "name"]).select("recipe", "source", F.col("quota").alias("target_tokens"), F.col("reached").alias("available_tokens"), (F.col("reached") < F.col("quota")).alias("short"))
    chosen = plan.filter("quota is null").join(named, ["recipe", "name"]).select("recipe", "mine", "source", "low", "high")
    spread = mine.join(summed, "pattern")
    before = lambda size, by, order: F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["recipe", "mine", "bucket"]
    base = spread.groupBy(*key).agg(F.sum("size").alias("size")).withColumn("base", before("size", key[:2], ["bucket"])).drop("size")
    offsets = spread.withColumn("inner", before("size", key, ["pattern"])).join(base, key).select("pattern", *key, (F.col("base") + F.col("inner")).alias("offset"))
    placed = docs.filter("tokens > 0").withColumn("bucket", bucket)
    placed = placed.withColumn("inside", before("tokens", ["pattern", "bucket"], [F.xxhash64("doc", F.lit(seed + 1)), "doc"]))
    placed = placed.join(offsets, ["pattern", "bucket"]).withColumn("at", F.col("offset") + F.col("inside"))
    met = placed.join(chosen, ["recipe", "mine"]).filter("at >= low and at < high")
    selection = met.groupBy("recipe", "source", "doc").agg(F.first("tokens").alias("tokens"), F.count("*").cast("int").alias("uses"))
    return selection, reported


def merged_copies(sized: DataFrame) -> DataFrame:
    """``(doc, tokens, sources)`` with the copies of one text as a single document of all their sources.

    ``sized`` has ``doc, tokens, source, digest``; documents without digest (null texts) stay apart.
    """
    digest = F.coalesce("digest", F.concat(F.lit("doc "), F.col("doc").cast("string")))
    return sized.groupBy(digest.alias("digest")).agg(F.min("doc").alias("doc"), F.first("tokens").alias("tokens"), F.collect_set(normal_source(F.col("source"))).alias("sources")).drop("digest")
