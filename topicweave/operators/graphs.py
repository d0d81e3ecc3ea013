"""Weighted undirected graphs as two tables; every operator carries ``graph_id``.

Edges are ``(graph_id, src, dst, weight)`` with ``src <= dst``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicweave.operators.groups import with_stats
from topicweave.plans.stage import stage


def canonical(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Undirected edges with summed weights; ``pairs`` may hold a ``weight``, else each row counts 1."""
    weight = F.sum("weight") if "weight" in pairs.columns else F.count("*")
    return pairs.groupBy(*by, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(weight.cast("double").alias("weight"))


def union_graphs(edges: DataFrame) -> DataFrame:
    """One graph of several: the weights of equal edges added up."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def with_distance(edges: DataFrame) -> DataFrame:
    return edges.withColumn("distance", 1 / F.col("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, other, weight)``: each edge from both ends; a loop once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")))).otherwise(
        F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    )
    return edges.select("graph_id", F.explode(ends).alias("_e"), "weight").select("graph_id", "_e.node", "_e.other", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, degree, weighted, centrality)``; a loop counts twice, a single node has centrality 1."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"), "weight")
    out = ends.groupBy("graph_id", "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"))
    n = F.col("_n")
    return with_stats(out, ["graph_id"], _n=F.count("*")).withColumn("centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(1.0))).drop("_n")


def core_words(members: DataFrame, scores: DataFrame, score: str, least: float, strict: bool = True) -> DataFrame:
    """``(graph_id, comm, node, score)``: the members that pass a threshold, or the best one where none does; ties by node."""
    joined = members.join(scores.select("graph_id", "node", F.col(score).alias("score")), ["graph_id", "node"])
    passes = F.coalesce(F.col("score") > least if strict else F.col("score") >= least, F.lit(False))
    marked = joined.withColumn("_ok", passes)
    low = -F.round("score", 9)
    best = F.min_by("node", F.struct(low.isNull().alias("none"), low.alias("low"), "node"))
    told = with_stats(marked, ["graph_id", "comm"], _any=F.max("_ok"), _best=best)
    return told.filter(F.col("_ok") | (~F.col("_any") & (F.col("node") == F.col("_best")))).select("graph_id", "comm", "node", "score")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in one community, with ``comm``."""
    side = lambda c: members.select("graph_id", F.col("node").alias(c), F.col("comm").alias(f"comm_{c}"))
    both = edges.join(side("src"), ["graph_id", "src"]).join(side("dst"), ["graph_id", "dst"]).filter("comm_src = comm_dst")
    return both.select("graph_id", F.col("comm_src").alias("comm"), "src", "dst", "weight")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph less some nodes and their edges."""
    gone = nodes.select("graph_id", "node").distinct()
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node", end), ["graph_id", end], "left_anti")
    return edges.select("graph_id", "src", "dst", "weight")


def triangles(edges: DataFrame) -> DataFrame:
    """``(graph_id, a, b, c)``, a < b < c.

    Edges point from the end of lower degree to the other, so that a hub has few
    outgoing ones and the number of paths stays near that of edges to the power 1.5.
    """
    plain = edges.filter("src < dst").select("graph_id", "src", "dst")
    d = degrees(edges.filter("src < dst")).select("graph_id", "node", "degree")
    ranked = plain.join(d.select("graph_id", F.col("node").alias("src"), F.col("degree").alias("ds")), ["graph_id", "src"]).join(d.select("graph_id", F.col("node").alias("dst"), F.col("degree").alias("dd")), ["graph_id", "dst"])
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    out = stage(ranked.select("graph_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")))
    paths = out.select("graph_id", "u", F.col("v").alias("x")).join(out.select("graph_id", "u", F.col("v").alias("y")), ["graph_id", "u"]).filter("x < y")
    closed = paths.join(plain.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y")), ["graph_id", "x", "y"])
    s = F.array_sort(F.array("u", "x", "y"))
    return closed.select("graph_id", s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(graph_id, node, comp)``: connected components named by their smallest node.

    Large-star and small-star rounds: the number of rounds grows with the
    logarithm of the longest path.  Nodes without edges come in by ``nodes``.
    """
    all_nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    if nodes is not None:
        all_nodes = all_nodes.union(nodes.select("graph_id", "node"))
    links = stage(edges.filter("src < dst").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    before = None
    while True:
        both = links.union(links.select("graph_id", "b", "a"))
        low = both.groupBy("graph_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, ["graph_id", "a"]).filter("b > a").select("graph_id", F.col("m").alias("a"), "b").filter("a < b").distinct()
        low2 = large.groupBy("graph_id", "b").agg(F.min("a").alias("m"))
        small = large.join(low2, ["graph_id", "b"]).select("graph_id", F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y").distinct()
        links = stage(small.select("graph_id", F.col("x").alias("a"), F.col("y").alias("b")))
        sign = links.agg(F.count("*"), F.sum(F.xxhash64("graph_id", "a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    roots = links.groupBy("graph_id", F.col("b").alias("node")).agg(F.min("a").alias("comp"))
    return all_nodes.distinct().join(roots, ["graph_id", "node"], "left").withColumn("comp", F.coalesce("comp", "node"))


def k_core(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, core)``: the largest k for which the node is in the k-core.  Loops don't count.

    Starts from the degrees; in each round a node takes the largest h such that h of its
    neighbours have h or more.  The values only fall, and where they stop are the core numbers; the rounds
    go on until then, half as many as a bare path has nodes in the worst case.
    """
    near = stage(symmetric(edges.filter("src <> dst")).select("graph_id", "node", "other").distinct())
    core = stage(near.groupBy("graph_id", "node").agg(F.count("*").cast("int").alias("core")))
    while True:
        seen = near.join(core.select("graph_id", F.col("node").alias("other"), F.col("core").alias("c")), ["graph_id", "other"])
        # counts by value first: a hub's list is as long as its number of different values
        counts = seen.groupBy("graph_id", "node", "c").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("graph_id", "node").orderBy(F.desc("c")))
        h = counts.withColumn("h", F.least("c", above)).groupBy("graph_id", "node").agg(F.max("h").cast("int").alias("h"))
        new = stage(core.join(h, ["graph_id", "node"]).select("graph_id", "node", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")))
        core = new.select("graph_id", "node", "core")
        if new.filter("moved").isEmpty():
            return core


def main_core(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, comm)``: the core of the largest k as one community, then the connected components of the rest."""
    core = with_stats(k_core(edges), ["graph_id"], _top=F.max("core"))
    inner = stage(core.filter("core = _top").select("graph_id", "node"))
    rest = components(without_nodes(edges, inner), nodes_of(edges).join(inner, ["graph_id", "node"], "left_anti"))
    return inner.withColumn("comm", F.lit("core")).unionByName(rest.select("graph_id", "node", F.concat(F.lit("rest:"), "comp").alias("comm")))


def nodes_of(edges: DataFrame) -> DataFrame:
    """``(graph_id, node)``, each once."""
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def eliminate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph_id, node, comp)``: the connected components left without some nodes; a node that loses all its neighbours stays as one of its own."""
    gone = nodes.select("graph_id", "node").distinct()
    return components(without_nodes(edges, gone), nodes_of(edges).join(gone, ["graph_id", "node"], "left_anti"))


def two_step_pairs(edges: DataFrame, block: int = 1024) -> DataFrame:
    """``(graph_id, a, b)``, a < b: nodes with a neighbour in common, each pair once.

    The neighbours of a hub are cut into blocks of about ``block``, and two blocks meet under a key of their own,
    so that no task pairs them all.
    """
    near = symmetric(edges.filter("src <> dst")).select("graph_id", F.col("node").alias("hub"), F.col("other").alias("node")).distinct()
    size = near.groupBy("graph_id", "hub").agg(F.count("*").alias("size")).filter("size > 1")
    groups = F.ceil(F.col("size") / block).cast("int")
    placed = near.join(size, ["graph_id", "hub"]).withColumn("groups", groups).withColumn("g", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda j: F.struct(F.least("g", j).alias("x"), F.greatest("g", j).alias("y")))
    placed = placed.select("graph_id", "hub", "node", "g", F.explode(cells).alias("_c")).select("graph_id", "hub", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), "g", "node")
    keys = ["graph_id", "hub", "x", "y"]
    met = placed.select(*keys, F.col("g").alias("ga"), F.col("node").alias("a")).join(placed.select(*keys, F.col("g").alias("gb"), F.col("node").alias("b")), keys)
    return met.filter("a < b and (x = y or ga <> gb)").select("graph_id", "a", "b").distinct()


def neighbour_jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(graph_id, a, b, similarity)`` of word pairs: 1 if equal; shared neighbours by all neighbours if adjacent; half of that two steps apart; else 0."""
    near = symmetric(edges.filter("src <> dst")).select("graph_id", "node", "other")
    size = near.groupBy("graph_id", "node").agg(F.count("*").alias("n"))
    wanted = pairs.select("graph_id", "a", "b").distinct()
    side = lambda c: size.select("graph_id", F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    of_a = wanted.join(near.select("graph_id", F.col("node").alias("a"), F.col("other").alias("z")), ["graph_id", "a"])
    shared = of_a.join(near.select("graph_id", F.col("node").alias("b"), F.col("other").alias("z")), ["graph_id", "b", "z"]).groupBy("graph_id", "a", "b").agg(F.count("*").alias("both"))
    touch = wanted.join(near.select("graph_id", F.col("node").alias("a"), F.col("other").alias("b")), ["graph_id", "a", "b"]).withColumn("adjacent", F.lit(True))
    keys = ["graph_id", "a", "b"]
    out = wanted.join(side("a"), ["graph_id", "a"], "left").join(side("b"), ["graph_id", "b"], "left").join(shared, keys, "left").join(touch, keys, "left")
    both = F.coalesce("both", F.lit(0))
    jaccard = both / (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0)) - both)
    similarity = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("adjacent"), jaccard).when(both > 0, jaccard / 2).otherwise(0.0)
    return out.select(*keys, similarity.alias("similarity"))


def cosine(a, b):
    """Cosine of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def metric_cosines(metrics: DataFrame, names: list[str]) -> DataFrame:
    """``(graph_id, metric, other, similarity)``: cosine between the columns of a metric table, from one aggregate of all products."""
    pairs = [(a, b) for a in names for b in names]
    sums = metrics.groupBy("graph_id").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    parts = F.array(*[F.struct(F.lit(a).alias("metric"), F.lit(b).alias("other"), (F.col(f"`{a}*{b}`") / F.sqrt(F.col(f"`{a}*{a}`") * F.col(f"`{b}*{b}`"))).alias("similarity")) for a, b in pairs])
    return sums.select("graph_id", F.explode(parts).alias("_p")).select("graph_id", "_p.metric", "_p.other", "_p.similarity")


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)`` with bins numbered from 0; values at ``high`` fall in the last bin, values outside in none."""
    at = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return values.filter(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def propagate_labels(edges: DataFrame, rounds: int = 12, seed: int = 7) -> DataFrame:
    """``(graph_id, node, comm)``: weighted label propagation until no node has a better label.

    All nodes look at their neighbours' labels at once.  Ties go to the own label, then to the smallest.
    In the first ``rounds`` a half of the nodes, drawn anew each time, moves; after them only those
    whose draw is the lowest among the neighbours that want to move.  No two of these are
    neighbours, so each such round adds to the weight of the edges within communities, and the loop ends.
    """
    near = stage(symmetric(edges.filter("src <> dst")))
    labels = stage(near.select("graph_id", "node").distinct().withColumn("comm", F.col("node")))
    i = 0
    while True:
        votes = near.join(labels.select("graph_id", F.col("node").alias("other"), "comm"), ["graph_id", "other"]).groupBy("graph_id", "node", "comm").agg(F.sum("weight").alias("w"))
        own = labels.withColumnRenamed("comm", "own")
        best = votes.join(own, ["graph_id", "node"]).groupBy("graph_id", "node", "own").agg(F.min_by("comm", F.struct(-F.round("w", 9), F.col("comm") != F.col("own"), F.col("comm"))).alias("new"))
        draw = F.xxhash64("graph_id", "node", F.lit(seed), F.lit(i))
        wants = stage(best.filter(F.col("new") != F.col("own")).select("graph_id", "node", "new", draw.alias("draw")))
        if wants.isEmpty():
            return labels
        if i < rounds:
            turn = wants.filter(F.pmod("draw", F.lit(2)) == 0)
        else:
            rivals = near.select("graph_id", "node", "other").join(wants.select("graph_id", F.col("node").alias("other"), F.col("draw").alias("theirs")), ["graph_id", "other"])
            lower = wants.join(rivals, ["graph_id", "node"]).filter(F.struct("theirs", "other") < F.struct("draw", "node"))
            turn = wants.join(lower.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
        labels = stage(labels.join(turn.select("graph_id", "node", "new"), ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("new", "comm").alias("comm")))
        i += 1


def percolate_cliques(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, comm, kind)``: triangles that share edges, then edges among the rest, then single nodes."""
    found = stage(triangles(edges))
    name = F.concat_ws("\u0001", "a", "b", "c")
    sides = F.array(F.concat_ws("\u0001", "a", "b"), F.concat_ws("\u0001", "a", "c"), F.concat_ws("\u0001", "b", "c"))
    by_side = found.select("graph_id", name.alias("t"), F.explode(sides).alias("side"))
    # triangles of one side are joined to the side's first, so a side with many of them makes a star
    first = by_side.groupBy("graph_id", "side").agg(F.min("t").alias("src"))
    links = by_side.join(first, ["graph_id", "side"]).select("graph_id", "src", F.col("t").alias("dst"), F.lit(1.0).alias("weight"))
    comps = components(links)
    triads = comps.select("graph_id", F.explode(F.split("node", "\u0001")).alias("node"), F.concat(F.lit("3:"), "comp").alias("comm")).distinct().withColumn("kind", F.lit(3))
    used = stage(triads.select("graph_id", "node").distinct())
    rest = without_nodes(edges.filter("src < dst"), used)
    pairs = components(rest).select("graph_id", "node", F.concat(F.lit("2:"), "comp").alias("comm")).withColumn("kind", F.lit(2))
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    single = nodes.join(used.union(pairs.select("graph_id", "node")), ["graph_id", "node"], "left_anti")
    return triads.unionByName(pairs).unionByName(single.select("graph_id", "node", F.concat(F.lit("1:"), "node").alias("comm"), F.lit(1).alias("kind")))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(graph_id, modularity)`` of a partition ``(graph_id, node, comm)``, by weight."""
    whole = edges.groupBy("graph_id").agg(F.sum("weight").alias("m"))
    inner = induced(edges, members).groupBy("graph_id", "comm").agg(F.sum("weight").alias("inside"))
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"), "weight").join(members.select("graph_id", "node", "comm"), ["graph_id", "node"]).groupBy("graph_id", "comm").agg(F.sum("weight").alias("ends"))
    share = F.col("ends") / (2 * F.col("m"))
    parts = ends.join(inner, ["graph_id", "comm"], "left").join(whole, "graph_id").withColumn("q", F.coalesce("inside", F.lit(0.0)) / F.col("m") - share * share)
    return parts.groupBy("graph_id").agg(F.sum("q").alias("modularity"))
