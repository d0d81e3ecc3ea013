"""Queries of the graph algorithms over the communities' word graphs, with the SQL that gives the same rows.

Algorithms that draw at random have no such SQL; the ``*_checks`` queries hold what is sure of their results against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators import embeddings, graphs, kernels
from topicweave.operators.groups import with_stats
from topicweave.plans import queries as base
from topicweave.plans.queries import COMM_GRAPH, query
from topicweave.plans.stage import stage

ED = f"{COMM_GRAPH}, ed AS (SELECT graph_id, src AS a, dst AS b FROM g UNION SELECT graph_id, dst, src FROM g), nd AS (SELECT DISTINCT graph_id, a AS node FROM ed)"
CC = f"""{ED}, cl(graph_id, node, comp) AS (SELECT graph_id, node, node FROM nd UNION SELECT cl.graph_id, ed.b, cl.comp FROM cl JOIN ed ON ed.graph_id = cl.graph_id AND ed.a = cl.node),
  cc AS (SELECT graph_id, node, min(comp) AS comp FROM cl GROUP BY graph_id, node)"""
CUT = f"""{CC}, rv(graph_id, v, node) AS (SELECT graph_id, a, min(b) FROM ed GROUP BY ALL UNION SELECT r.graph_id, r.v, ed.b FROM rv r JOIN ed ON ed.graph_id = r.graph_id AND ed.a = r.node WHERE ed.b <> r.v),
  cut AS (SELECT DISTINCT graph_id, a AS node FROM ed WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.graph_id = ed.graph_id AND rv.v = ed.a AND rv.node = ed.b))"""
BRIDGE = f"""{CC}, rb(graph_id, s, d, node) AS (SELECT graph_id, src, dst, src FROM g UNION SELECT r.graph_id, r.s, r.d, ed.b FROM rb r JOIN ed ON ed.graph_id = r.graph_id AND ed.a = r.node WHERE NOT (ed.a = r.s AND ed.b = r.d) AND NOT (ed.a = r.d AND ed.b = r.s)),
  br AS (SELECT graph_id, src, dst FROM g WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.graph_id = g.graph_id AND rb.s = src AND rb.d = dst AND rb.node = dst)),
  e2 AS (SELECT * FROM ed WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.graph_id = ed.graph_id AND src = least(a, b) AND dst = greatest(a, b))),
  tl(graph_id, node, c) AS (SELECT graph_id, node, node FROM nd UNION SELECT t.graph_id, e2.b, t.c FROM tl t JOIN e2 ON e2.graph_id = t.graph_id AND e2.a = t.node),
  two AS (SELECT graph_id, node, min(c) AS two FROM tl GROUP BY graph_id, node)"""
THREE = f"""{BRIDGE}, ge AS (SELECT g.*, comp, row_number() OVER () AS e FROM g JOIN cc ON cc.graph_id = g.graph_id AND cc.node = g.src),
  ee AS (SELECT graph_id, src AS a, dst AS b, e FROM ge UNION ALL SELECT graph_id, dst, src, e FROM ge), pr AS (SELECT x.graph_id, x.comp, x.e AS e1, y.e AS e2 FROM ge x JOIN ge y ON x.graph_id = y.graph_id AND x.comp = y.comp AND x.e < y.e),
  r3(graph_id, e1, e2, s, node) AS (SELECT pr.graph_id, e1, e2, node, node FROM pr JOIN cc USING (graph_id, comp)
    UNION SELECT r.graph_id, r.e1, r.e2, r.s, ee.b FROM r3 r JOIN ee ON ee.graph_id = r.graph_id AND ee.a = r.node WHERE ee.e <> r.e1 AND ee.e <> r.e2),
  pn AS (SELECT graph_id, comp, count(*) AS n FROM pr GROUP BY ALL), rn AS (SELECT graph_id, s, node, count(*) AS n FROM r3 GROUP BY ALL),
  same AS (SELECT rn.graph_id, s, rn.node FROM rn JOIN cc ON cc.graph_id = rn.graph_id AND cc.node = rn.s JOIN pn ON pn.graph_id = rn.graph_id AND pn.comp = cc.comp AND pn.n = rn.n
    JOIN two x ON x.graph_id = rn.graph_id AND x.node = rn.s JOIN two y ON y.graph_id = rn.graph_id AND y.node = rn.node AND x.two = y.two UNION SELECT graph_id, node, node FROM nd),
  three AS (SELECT graph_id, s AS node, min(node) AS three FROM same GROUP BY graph_id, s)"""
CORE = f"""{CC}, kc(graph_id, node, core, i) AS (SELECT graph_id, a, count(*), 0 FROM ed GROUP BY ALL
  UNION ALL SELECT graph_id, node, CAST(least(max(own), max(h)) AS BIGINT), max(i) + 1 FROM (SELECT ed.graph_id, ed.a AS node, y.core AS own, x.i, least(x.core, row_number() OVER (PARTITION BY ed.graph_id, ed.a ORDER BY x.core DESC)) AS h
    FROM ed JOIN kc x ON x.graph_id = ed.graph_id AND x.node = ed.b JOIN kc y ON y.graph_id = ed.graph_id AND y.node = ed.a WHERE x.i < 40) GROUP BY graph_id, node),
  core AS (SELECT graph_id, node, core FROM kc WHERE i = 40)"""
# parts named by their smallest node and their number in the component
NAMED = "SELECT p.graph_id, p.node, part || '#' || (dense_rank() OVER (PARTITION BY p.graph_id, comp ORDER BY part) - 1) AS comm FROM {parts} p JOIN cc ON cc.graph_id = p.graph_id AND cc.node = p.node"


def _graph(spark, folder) -> DataFrame:
    return base._community_graph(spark, folder)


@query(f"WITH RECURSIVE {CORE} SELECT graph_id, node, CAST(core AS INTEGER) AS core FROM core")
def kcore(spark, folder):
    return graphs.k_core(_graph(spark, folder))


@query(f"""WITH RECURSIVE {CORE}, top AS (SELECT graph_id, node FROM (SELECT *, max(core) OVER (PARTITION BY graph_id) AS m FROM core) WHERE core = m),
  re AS (SELECT * FROM ed WHERE (graph_id, a) NOT IN (SELECT (graph_id, node) FROM top) AND (graph_id, b) NOT IN (SELECT (graph_id, node) FROM top)),
  rl(graph_id, node, c) AS (SELECT graph_id, node, node FROM nd WHERE (graph_id, node) NOT IN (SELECT (graph_id, node) FROM top) UNION SELECT r.graph_id, re.b, r.c FROM rl r JOIN re ON re.graph_id = r.graph_id AND re.a = r.node)
  SELECT graph_id, node, 'core' AS comm FROM top UNION ALL SELECT graph_id, node, 'rest:' || min(c) FROM rl GROUP BY graph_id, node""")  # fmt: skip
def k_core(spark, folder):
    """The main core as one community and the components of the rest."""
    return kernels.communities(_graph(spark, folder), "k_core")


METRICS = f"""{CC}, sz AS (SELECT graph_id, count(*) AS n FROM nd GROUP BY 1), dg AS (SELECT graph_id, a AS node, count(*) AS deg FROM ed GROUP BY ALL),
  dl(graph_id, s, node, d) AS (SELECT graph_id, node, node, 0 FROM nd UNION SELECT x.graph_id, x.s, ed.b, x.d + 1 FROM dl x JOIN ed ON ed.graph_id = x.graph_id AND ed.a = x.node WHERE x.d < 25),
  ds AS (SELECT graph_id, s, node, min(d) AS d FROM dl GROUP BY ALL),
  sp(graph_id, s, node, d) AS (SELECT graph_id, node, node, 0 FROM nd UNION ALL SELECT x.graph_id, x.s, ed.b, x.d + 1 FROM sp x JOIN ed ON ed.graph_id = x.graph_id AND ed.a = x.node JOIN ds ON ds.graph_id = x.graph_id AND ds.s = x.s AND ds.node = ed.b AND ds.d = x.d + 1),
  sg AS (SELECT graph_id, s, node, d, count(*) AS k FROM sp GROUP BY ALL),
  bt AS (SELECT x.graph_id, x.node, sum(CAST(x.k AS DOUBLE) * y.k / z.k) AS b FROM sg x JOIN sg y ON y.graph_id = x.graph_id AND y.s = x.node JOIN sg z ON z.graph_id = x.graph_id AND z.s = x.s AND z.node = y.node AND z.d = x.d + y.d
    WHERE x.s < y.node AND x.node <> x.s AND x.node <> y.node GROUP BY ALL),
  cs AS (SELECT graph_id, s AS node, count(*) - 1 AS r, sum(d) AS far FROM ds GROUP BY graph_id, s),
  ev(graph_id, node, x, i, moved) AS (SELECT graph_id, node, 1.0::DOUBLE / n, 0, 1e9::DOUBLE FROM nd JOIN sz USING (graph_id)
    UNION ALL SELECT graph_id, node, y / l, i + 1, sum(abs(y / l - x)) OVER (PARTITION BY graph_id) FROM (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY graph_id)) AS l FROM
      (SELECT u.graph_id, u.node, any_value(u.x) AS x, any_value(u.x) + sum(v.x) AS y, any_value(u.i) AS i FROM ev u JOIN sz ON sz.graph_id = u.graph_id JOIN ed ON ed.graph_id = u.graph_id AND ed.a = u.node JOIN ev v ON v.graph_id = u.graph_id AND v.node = ed.b
       WHERE u.i < 1000 AND u.moved >= sz.n * 1e-6 GROUP BY u.graph_id, u.node))),
  eg AS (SELECT graph_id, node, arg_max(x, i) AS x FROM ev GROUP BY ALL),
  mt AS (SELECT nd.graph_id, nd.node, deg / (n - 1) AS degree, CASE WHEN n > 2 THEN coalesce(b, 0) * 2 / ((n - 1) * (n - 2)) ELSE 0 END AS betweenness, CASE WHEN r > 0 THEN r / (n - 1) * r / far ELSE 0 END AS closeness, x AS eigenvector
    FROM nd JOIN sz USING (graph_id) JOIN dg USING (graph_id, node) JOIN cs USING (graph_id, node) JOIN eg USING (graph_id, node) LEFT JOIN bt USING (graph_id, node)),
  ms AS (SELECT *, degree + closeness + eigenvector AS centrality FROM mt)"""
NAMES = ["degree", "betweenness", "closeness", "eigenvector", "centrality"]


def _metrics(edges: DataFrame) -> DataFrame:
    sized = with_stats(graphs.nodes_of(edges), ["graph_id"], total=F.count("*")).select("graph_id", "node", "total")
    own = kernels.run_kernel(edges, lambda names, g: list(zip(names, map(float, kernels.betweenness(g)), map(float, kernels.closeness(g, len(g))), [len(g)] * len(g))), "node string, betweenness double, closeness double, size int")
    eigen = kernels.run_kernel(edges, lambda names, g: list(zip(names, map(float, kernels.eigenvector(g)))), "node string, eigenvector double", by_component=False)
    degree = graphs.degrees(edges).select("graph_id", "node", F.col("centrality").alias("degree"))
    n, k = F.col("total"), F.col("size")
    joined = degree.join(own, ["graph_id", "node"]).join(eigen, ["graph_id", "node"]).join(sized, ["graph_id", "node"])
    # closeness of the component, scaled to the whole graph; betweenness as a share of all pairs
    close = F.when(k > 1, F.col("closeness") * (k - 1) / (n - 1)).otherwise(0.0)
    out = joined.select("graph_id", "node", "degree", F.when(n > 2, F.col("betweenness") * 2 / ((n - 1) * (n - 2))).otherwise(0.0).alias("betweenness"), close.alias("closeness"), "eigenvector")
    return out.withColumn("centrality", F.col("degree") + F.col("closeness") + F.col("eigenvector"))


@query(f"WITH RECURSIVE {METRICS} SELECT graph_id, node, {', '.join(f'round({c}, 5) AS {c}' for c in NAMES)} FROM ms")
def combined_centrality(spark, folder):
    m = _metrics(_graph(spark, folder))
    return m.select("graph_id", "node", *(F.round(c, 5).alias(c) for c in NAMES))


@query(f"WITH RECURSIVE {METRICS}, un AS (UNPIVOT ms ON {', '.join(NAMES)} INTO NAME metric VALUE v) SELECT p.graph_id, p.metric, q.metric AS other, round(sum(p.v * q.v) / sqrt(sum(p.v * p.v) * sum(q.v * q.v)), 2) AS similarity FROM un p JOIN un q ON p.graph_id = q.graph_id AND p.node = q.node GROUP BY ALL")
def metric_cosine_matrix(spark, folder):
    return graphs.metric_cosines(_metrics(_graph(spark, folder)), NAMES).withColumn("similarity", F.round("similarity", 2))


@query(f"WITH RECURSIVE {CUT} SELECT graph_id, node FROM cut")
def articulation(spark, folder):
    return kernels.run_kernel(_graph(spark, folder), lambda names, g: [(names[v],) for v in sorted(kernels._search(g)[4])], "node string")


@query(f"WITH RECURSIVE {BRIDGE} SELECT graph_id, src, dst FROM br")
def bridges(spark, folder):
    return kernels.run_kernel(_graph(spark, folder), lambda names, g: [(names[a], names[b]) for a, b in sorted(kernels._search(g)[5])], "src string, dst string")


@query(f"""WITH RECURSIVE {CUT}, ke AS (SELECT * FROM ed WHERE (graph_id, a) NOT IN (SELECT (graph_id, node) FROM cut) AND (graph_id, b) NOT IN (SELECT (graph_id, node) FROM cut)),
  kl(graph_id, node, c) AS (SELECT graph_id, node, node FROM nd WHERE (graph_id, node) NOT IN (SELECT (graph_id, node) FROM cut) UNION SELECT k.graph_id, ke.b, k.c FROM kl k JOIN ke ON ke.graph_id = k.graph_id AND ke.a = k.node)
  SELECT graph_id, node, min(c) AS comp FROM kl GROUP BY graph_id, node""")  # fmt: skip
def eliminate_nodes(spark, folder):
    """Components that are left without the cut nodes, single nodes among them."""
    return graphs.eliminate(_graph(spark, folder), articulation(spark, folder))


@query(f"""WITH RECURSIVE {CC}, rs(graph_id, v, s, node) AS (SELECT graph_id, a, b, b FROM ed UNION SELECT r.graph_id, r.v, r.s, ed.b FROM rs r JOIN ed ON ed.graph_id = r.graph_id AND ed.a = r.node WHERE ed.b <> r.v),
  rel AS (SELECT DISTINCT r.graph_id, least(v, s) AS s1, greatest(v, s) AS d1, least(v, r.node) AS s2, greatest(v, r.node) AS d2 FROM rs r JOIN ed ON ed.graph_id = r.graph_id AND ed.a = r.v AND ed.b = r.node),
  bl(graph_id, s, d, c) AS (SELECT graph_id, src, dst, src || chr(1) || dst FROM g UNION SELECT b.graph_id, s2, d2, b.c FROM bl b JOIN rel ON rel.graph_id = b.graph_id AND s1 = b.s AND d1 = b.d),
  bb AS (SELECT graph_id, s, d, min(c) AS c FROM bl GROUP BY ALL), bn AS (SELECT DISTINCT graph_id, c, unnest([s, d]) AS node FROM bb), bs AS (SELECT graph_id, c, list_sort(list(node)) AS nodes FROM bn GROUP BY ALL),
  bk AS (SELECT bs.*, row_number() OVER (PARTITION BY bs.graph_id, comp ORDER BY nodes) - 1 AS k FROM bs JOIN cc ON cc.graph_id = bs.graph_id AND cc.node = nodes[1])
  SELECT graph_id, unnest(nodes) AS node, nodes[1] || '#' || k AS comm FROM bk""")  # fmt: skip
def components_bicomponents(spark, folder):
    return kernels.communities(_graph(spark, folder), "bicomponents")


@query(f"WITH RECURSIVE {BRIDGE}, parts AS (SELECT graph_id, node, two AS part FROM two) {NAMED.format(parts='parts')}")
def components_two_edge(spark, folder):
    return kernels.communities(_graph(spark, folder), "two_edge")


@query(f"WITH RECURSIVE {THREE}, parts AS (SELECT graph_id, node, three AS part FROM three) {NAMED.format(parts='parts')}")
def components_three_edge(spark, folder):
    return kernels.communities(_graph(spark, folder), "three_edge")


@query(f"WITH RECURSIVE {THREE} SELECT cc.graph_id, cc.node, comp AS one, two, three FROM cc JOIN two USING (graph_id, node) JOIN three USING (graph_id, node)")
def connectivity_levels(spark, folder):
    """Of every node its 1-, 2- and 3-edge-connected component."""

    def levels(names, g):
        two, three = ({v: names[p[0]] for p in parts for v in p} for parts in (kernels.two_edge(g), kernels.three_edge(g)))
        return [(names[v], names[0], two[v], three[v]) for v in range(len(g))]

    return kernels.run_kernel(_graph(spark, folder), levels, "node string, one string, two string, three string")


@query(f"""WITH RECURSIVE {CC}, bp(graph_id, comp, node, x, i) AS (SELECT graph_id, comp, comp, {{'d': 0.0::DOUBLE, 'p': [comp]}}, 0 FROM cc WHERE node = comp
  UNION ALL SELECT graph_id, comp, node, min(x), max(i) + 1 FROM (SELECT * FROM bp WHERE i < 25 UNION ALL SELECT b.graph_id, b.comp, ed.b, {{'d': round(b.x.d + 1 / weight, 12), 'p': list_append(b.x.p, ed.b)}}, i FROM bp b JOIN ed ON ed.graph_id = b.graph_id AND ed.a = b.node
    JOIN g ON g.graph_id = ed.graph_id AND src = least(ed.a, ed.b) AND dst = greatest(ed.a, ed.b) WHERE i < 25) GROUP BY graph_id, comp, node)
  SELECT graph_id, comp AS src, node AS dst, CAST(len(x.p) - 1 AS INTEGER) AS steps, round(1 / x.d, 6) AS score FROM bp WHERE i = 25 AND node <> comp""")  # fmt: skip
def weighted_path_best(spark, folder):
    """Best paths from the first node of each component to all others, with their score."""

    def paths(names, g):
        return [(names[0], names[t], len(path) - 1, round(1 / d, 6)) for t, (d, _, path) in sorted(kernels.best_paths(g, 0, set()).items()) if t]

    return kernels.run_kernel(_graph(spark, folder), paths, "src string, dst string, steps int, score double")


@query(f"""WITH RECURSIVE {CC}, tr AS (SELECT x.graph_id, x.src AS a, x.dst AS b, y.dst AS c, x.src || chr(1) || x.dst || chr(1) || y.dst AS t FROM g x JOIN g y ON y.graph_id = x.graph_id AND y.src = x.dst JOIN g z ON z.graph_id = x.graph_id AND z.src = x.src AND z.dst = y.dst),
  sd AS (SELECT graph_id, t, unnest([a || chr(1) || b, a || chr(1) || c, b || chr(1) || c]) AS side FROM tr),
  tl(graph_id, t, c) AS (SELECT graph_id, t, t FROM tr UNION SELECT x.graph_id, q.t, x.c FROM tl x JOIN sd p ON p.graph_id = x.graph_id AND p.t = x.t JOIN sd q ON q.graph_id = p.graph_id AND q.side = p.side),
  tc AS (SELECT graph_id, t, min(c) AS comp FROM tl GROUP BY ALL), k3 AS (SELECT DISTINCT tr.graph_id, unnest([a, b, c]) AS node, '3:' || comp AS comm FROM tr JOIN tc USING (graph_id, t)),
  re AS (SELECT * FROM ed WHERE (graph_id, a) NOT IN (SELECT (graph_id, node) FROM k3) AND (graph_id, b) NOT IN (SELECT (graph_id, node) FROM k3)),
  rl(graph_id, node, c) AS (SELECT DISTINCT graph_id, a, a FROM re UNION SELECT r.graph_id, re.b, r.c FROM rl r JOIN re ON re.graph_id = r.graph_id AND re.a = r.node), k2 AS (SELECT graph_id, node, '2:' || min(c) AS comm FROM rl GROUP BY graph_id, node)
  SELECT *, 3 AS kind FROM k3 UNION ALL SELECT *, 2 FROM k2 UNION ALL SELECT graph_id, node, '1:' || node, 1 FROM nd WHERE (graph_id, node) NOT IN (SELECT (graph_id, node) FROM k3) AND (graph_id, node) NOT IN (SELECT (graph_id, node) FROM k2)""")  # fmt: skip
def k_clique(spark, folder):
    return graphs.percolate_cliques(_graph(spark, folder))


def _named(name: str) -> None:
    def run(spark, folder):
        return kernels.communities(_graph(spark, folder), name)

    run.__name__ = name
    query()(run)


for _name in ("louvain", "lpa", "fluid", "islpa", "slpa", "gn", "cnm", "bigclam"):
    _named(_name)


@query()
def two_connect_louvain(spark, folder):
    return kernels.contracted_communities(_graph(spark, folder))


PARTITIONS = ("louvain", "lpa", "fluid", "islpa", "slpa", "gn", "cnm", "two_connect_louvain")
MODULARITY = """mg AS (SELECT graph_id, sum(weight) AS m FROM g GROUP BY 1), mi AS (SELECT g.graph_id, x.part, sum(weight) AS w FROM g JOIN {p} x ON x.graph_id = g.graph_id AND x.node = src JOIN {p} y ON y.graph_id = g.graph_id AND y.node = dst WHERE x.part = y.part GROUP BY ALL),
  md AS (SELECT e.graph_id, part, sum(weight) AS w FROM (SELECT graph_id, src AS node, weight FROM g UNION ALL SELECT graph_id, dst, weight FROM g) e JOIN {p} p ON p.graph_id = e.graph_id AND p.node = e.node GROUP BY ALL),
  mq AS (SELECT md.graph_id, sum(coalesce(mi.w, 0) / m - (md.w / (2 * m)) * (md.w / (2 * m))) AS q FROM md JOIN mg USING (graph_id) LEFT JOIN mi USING (graph_id, part) GROUP BY md.graph_id)"""


@query(f"WITH RECURSIVE {CC}, parts AS (SELECT graph_id, node, comp AS part FROM cc), {MODULARITY.format(p='parts')} SELECT graph_id, round(q, 6) AS modularity FROM mq")
def component_modularity(spark, folder):
    edges = _graph(spark, folder)
    return graphs.modularity(edges, graphs.components(edges).withColumnRenamed("comp", "comm")).withColumn("modularity", F.round("modularity", 6))


@query(f"WITH {ED} SELECT algorithm, graph_id, count(*) AS nodes, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS doubled FROM nd, unnest([{', '.join(repr(x) for x in PARTITIONS)}]) u(algorithm) GROUP BY ALL")
def partition_checks(spark, folder):
    """Every algorithm puts each node into one community: nodes, those in none, those in several."""
    edges = stage(_graph(spark, folder))
    nodes, comps = graphs.nodes_of(edges), stage(graphs.components(edges))
    out = None
    for name in PARTITIONS:
        found = kernels.contracted_communities(edges) if name == "two_connect_louvain" else kernels.communities(edges, name, comps)
        times = nodes.join(found.groupBy("graph_id", "node").agg(F.count("*").alias("n")), ["graph_id", "node"], "full").groupBy("graph_id")
        part = times.agg(F.count("*").alias("nodes"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("doubled")).select(F.lit(name).alias("algorithm"), "graph_id", "nodes", "missing", "doubled")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {ED} SELECT algorithm, graph_id, true AS at_least FROM (SELECT DISTINCT graph_id FROM nd), unnest(['louvain', 'cnm']) u(algorithm)")
def modularity_checks(spark, folder):
    """Communities by modularity reach at least that of the connected components."""
    edges = stage(_graph(spark, folder))
    plain = graphs.modularity(edges, graphs.components(edges).withColumnRenamed("comp", "comm")).withColumnRenamed("modularity", "least")
    out = None
    for name in ("louvain", "cnm"):
        part = graphs.modularity(edges, kernels.communities(edges, name)).join(plain, "graph_id").select(F.lit(name).alias("algorithm"), "graph_id", (F.col("modularity") >= F.col("least") - 1e-9).alias("at_least"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH RECURSIVE {CC}, n AS (SELECT graph_id, count(DISTINCT comp) + 1 AS communities FROM cc GROUP BY 1) SELECT graph_id, communities, 0::BIGINT AS across FROM n")
def split_checks(spark, folder):
    """The first split makes one community more than there are components, none of them across components."""
    edges = stage(_graph(spark, folder))
    both = kernels.communities(edges, "gn").join(graphs.components(edges), ["graph_id", "node"]).groupBy("graph_id", "comm").agg(F.count_distinct("comp").alias("comps"))
    return both.groupBy("graph_id").agg(F.count("*").alias("communities"), F.count_if(F.col("comps") > 1).alias("across"))


@query(f"WITH {ED} SELECT graph_id, count(*) AS nodes, CAST(0 AS BIGINT) AS unstable FROM nd GROUP BY 1")
def label_checks(spark, folder):
    """After label propagation no node has a neighbours' label of more weight than its own."""
    edges = stage(_graph(spark, folder))
    labels = stage(graphs.propagate_labels(edges))
    votes = graphs.symmetric(edges).join(labels.select("graph_id", F.col("node").alias("other"), "comm"), ["graph_id", "other"]).groupBy("graph_id", "node", "comm").agg(F.sum("weight").alias("w"))
    own = votes.join(labels.withColumnRenamed("comm", "own"), ["graph_id", "node"]).groupBy("graph_id", "node").agg(F.max("w").alias("top"), F.coalesce(F.max(F.when(F.col("comm") == F.col("own"), F.col("w"))), F.lit(0.0)).alias("mine"))
    return own.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("mine") < F.col("top") - 1e-9).alias("unstable"))


@query()
def node2vec_walks(spark, folder):
    return embeddings.walks(_graph(spark, folder), length=20, per_node=50)


@query(f"WITH {ED} SELECT graph_id, 50 * count(*) AS walks, 20 * 50 * count(*) AS steps, CAST(0 AS BIGINT) AS off_edges FROM nd GROUP BY 1")
def walk_checks(spark, folder):
    """50 walks of 20 nodes from every node, each step along an edge."""
    edges = stage(_graph(spark, folder))
    walked = stage(embeddings.walks(edges, length=20, per_node=50))
    sizes = walked.groupBy("graph_id").agg(F.count_distinct("walk").alias("walks"), F.sum(F.size("nodes")).alias("steps"))
    steps = walked.select("graph_id", F.explode(F.zip_with(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes")), lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))).alias("_s"))
    used = steps.groupBy("graph_id", "_s.src", "_s.dst").agg(F.count("*").alias("n"))
    off = used.join(edges.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti").groupBy("graph_id").agg(F.sum("n").alias("off"))
    return sizes.join(off, "graph_id", "left").select("graph_id", "walks", "steps", F.coalesce("off", F.lit(0)).alias("off_edges"))


LINK = f"""{CC}, mb AS (SELECT DISTINCT period, comm, word FROM community), u AS (SELECT src, dst FROM g GROUP BY ALL), nb AS (SELECT src AS a, dst AS b FROM u UNION SELECT dst, src FROM u), ns AS (SELECT a, count(*) AS n FROM nb GROUP BY a),
  sh AS (SELECT x.a, y.a AS b, count(*) AS k FROM nb x JOIN nb y ON x.b = y.b GROUP BY ALL), pr AS (SELECT a, b, true AS near FROM nb UNION ALL SELECT a, b, false FROM sh WHERE a <> b AND (a, b) NOT IN (SELECT (a, b) FROM nb)),
  sm AS (SELECT pr.a, pr.b, coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)) / CASE WHEN near THEN 1 ELSE 2 END AS s FROM pr LEFT JOIN sh USING (a, b) JOIN ns x ON x.a = pr.a JOIN ns y ON y.a = pr.b UNION ALL SELECT a, a, 1.0 FROM ns),
  mx AS (SELECT graph_id AS mp, comp AS mix, node AS word FROM cc), lo AS (SELECT mp, min(mix) AS lowest FROM mx GROUP BY 1),
  sd AS (SELECT 'old' AS side, period, comm, word, period AS mp FROM mb UNION ALL SELECT 'new', period, comm, word, period - 1 FROM mb), ov AS (SELECT side, period, comm, mp, mix, count(*) AS n FROM sd JOIN mx USING (mp, word) GROUP BY ALL),
  bs AS (SELECT side, period, comm, mp, arg_min(mix, {{'n': -n, 'm': mix}}) AS mix FROM ov GROUP BY ALL), ln AS (SELECT e.side, e.period, e.comm, e.mp, coalesce(bs.mix, lowest) AS mix FROM (SELECT DISTINCT side, period, comm, mp FROM sd) e JOIN lo USING (mp) LEFT JOIN bs USING (side, period, comm, mp)),
  wd AS (SELECT ln.side, ln.mp, ln.mix, ln.comm, word FROM ln JOIN mb USING (period, comm)), od AS (SELECT DISTINCT mp, mix, word AS b FROM wd WHERE side = 'old'), nw AS (SELECT mp, mix, comm, word FROM wd WHERE side = 'new' AND (mp, mix) IN (SELECT (mp, mix) FROM od)),
  cd AS (SELECT nw.mp, nw.mix, nw.comm, nw.word, arg_min({{'b': od.b, 's': s}}, {{'s': -round(s, 9), 'b': od.b}}) AS x FROM nw JOIN sm ON sm.a = nw.word AND s > 0 JOIN od ON od.mp = nw.mp AND od.mix = nw.mix AND od.b = sm.b GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LINK} SELECT nw.mp AS mix_period, nw.mix, nw.comm, nw.word, coalesce(x.b, '') AS best, round(coalesce(x.s, 0), 6) AS similarity FROM nw LEFT JOIN cd USING (mp, mix, comm, word)")
def word_link_best(spark, folder):
    """Words of neighbouring communities linked by their shared neighbours in the graph of all periods."""
    from topicweave.operators import lineage
    from topicweave.sources.tables import table

    members = table(spark, folder, "community").select("period", "comm", "word").distinct()
    edges = stage(graphs.union_graphs(_graph(spark, folder)).withColumn("graph_id", F.lit(0)).select("graph_id", "src", "dst", "weight"))
    mixes = graphs.components(_graph(spark, folder)).select(F.col("graph_id").alias("mix_period"), F.col("comp").alias("mix"), F.col("node").alias("word"))
    pairs = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(graphs.two_step_pairs(edges)).distinct()
    similar = stage(graphs.neighbour_jaccard(edges, pairs).select("a", "b", "similarity"))
    both = similar.union(similar.select("b", "a", "similarity")).union(graphs.nodes_of(edges).select("node", "node", F.lit(1.0)))
    return lineage.best_word_links(lineage.link_by_overlap(members, mixes), members, both).withColumn("similarity", F.round("similarity", 6))
