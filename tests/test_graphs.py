import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicweave.operators import embeddings, graphs, kernels


def frame(spark, edges, graph=0):
    return spark.createDataFrame([(graph, min(a, b), max(a, b), 1.0) for a, b in edges], "graph_id int, src string, dst string, weight double")


def pieces(n, edges):
    s = kernels.Sets(n)
    for a, b in edges:
        s.join(a, b)
    return s.groups()


random_graph = st.integers(2, 8).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.sampled_from([(a, b) for a in range(n) for b in range(a + 1, n)]), min_size=1)))


def adjacency(n, edges):
    g = [{} for _ in range(n)]
    for a, b in edges:
        g[a][b] = g[b][a] = 1.0
    return g


@settings(max_examples=150, deadline=None)
@given(random_graph)
def test_cuts_and_edge_components(case):
    n, edges = case
    g = adjacency(n, edges)
    base = len(pieces(n, edges))
    *_, blocks, cuts, bridges = kernels._search(g)
    assert set(bridges) == {e for e in edges if len(pieces(n, edges - {e})) > base}
    without = lambda v: len(pieces(n, {e for e in edges if v not in e})) - 1
    assert cuts == {v for v in range(n) if without(v) > base and any(v in e for e in edges)}
    inside = [{e for e in edges if set(e) <= set(b)} for b in blocks]
    assert sum(map(len, inside)) == len(edges)

    def apart(k):
        return {(a, b) for a in range(n) for b in range(a + 1, n) for c in itertools.combinations(edges, k) if not any({a, b} <= set(p) for p in pieces(n, edges - set(c)))}

    one, two = apart(1) | apart(0), set()
    two = one | apart(2)
    together = lambda parts: {(a, b) for p in parts for a in p for b in p if a < b}
    every = {(a, b) for a in range(n) for b in range(a + 1, n)}
    assert together(kernels.two_edge(g)) == every - one
    assert together(kernels.three_edge(g)) == every - two


@settings(max_examples=40, deadline=None)
@given(random_graph, st.sampled_from([n for n in kernels.PARTS if n not in ("bigclam",)]))
def test_communities_cover_all_nodes(case, name):
    n, edges = case
    nodes = max(pieces(n, edges), key=len)
    at = {v: i for i, v in enumerate(nodes)}
    g = adjacency(len(nodes), {(at[a], at[b]) for a, b in edges if a in at})
    parts = kernels.parts_of(name)(g)
    assert {v for p in parts for v in p} == set(range(len(nodes)))
    if name not in ("k_clique", "bicomponents"):
        assert sum(map(len, parts)) == len(nodes)


def test_louvain_and_cnm_on_two_cliques():
    edges = {(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)} | {(3, 4)}
    for name in ("louvain", "cnm", "gn"):
        assert kernels.parts_of(name)(adjacency(8, edges)) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_centralities_of_a_path():
    g = adjacency(4, {(0, 1), (1, 2), (2, 3)})
    assert kernels.betweenness(g) == [0, 2, 2, 0]
    assert np.allclose(kernels.closeness(g, 4), [0.5, 0.75, 0.75, 0.5])
    assert np.allclose(kernels.eigenvector(g)[0] / kernels.eigenvector(g)[1], 0.618, atol=1e-3)


def test_contraction_prefers_direct_and_keyword_free_paths():
    g = [{1: 1.0, 2: 1.0}, {0: 1.0, 2: 1.0}, {0: 1.0, 1: 1.0}]
    assert kernels.contract_to(g, [0, 1]) == [(0, 1, 1.0)]
    assert kernels.contract_to(adjacency(3, {(0, 1), (1, 2)}), [0, 1, 2]) == [(0, 1, 1.0), (1, 2, 1.0)]


def rings(count, size):
    """Rings side by side."""
    return [(f"r{k}n{i:02}", f"r{k}n{(i + 1) % size:02}") for k in range(count) for i in range(size)]


def test_modularity_is_that_of_the_whole_graph(spark):
    df = frame(spark, rings(6, 12))
    for name in ("louvain", "cnm"):
        found = kernels.communities(df, name).collect()
        # alone a ring falls into three, beside five others it is one community
        assert len({r.comm for r in found}) == 6 and len(found) == 72
    assert len(kernels.louvain(adjacency(12, {(i, (i + 1) % 12) for i in range(12)}))) == 3


def test_only_the_first_component_to_come_apart_is_split(spark):
    df = frame(spark, [("a", "b"), ("b", "c"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "t")])
    found = {}
    for r in kernels.communities(df, "gn").collect():
        found.setdefault(r.comm, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [["a", "b", "c"], ["p", "q"], ["r", "s", "t"]] or sorted(map(sorted, found.values())) == [["a", "b", "c"], ["p", "q", "r"], ["s", "t"]]


def test_every_name_of_the_dispatcher(spark):
    df = frame(spark, list(itertools.combinations("abcd", 2)) + [("d", "e"), ("e", "f"), ("x", "y")])
    nodes = set("abcdefxy")
    for name in kernels.PARTS:
        found = kernels.communities(df, name).collect()
        assert {r.node for r in found} == nodes, name
    core = {r.node: r.comm for r in kernels.communities(df, "k_core").collect()}
    assert {v for v, c in core.items() if c == "core"} == set("abcd") and core["e"] == core["f"] != core["x"] == core["y"]
    with pytest.raises(ValueError):
        kernels.communities(df, "no such")


def test_core_and_rest_of_one_graph():
    g = adjacency(6, {(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5)})
    assert kernels.core_and_rest(g) == [[0, 1, 2], [3, 4, 5]]
    assert kernels.cliques_of_three(g) == [[0, 1, 2], [3, 4, 5]]
    assert kernels.colour_labels(adjacency(6, {(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)})) == [[0, 1, 2], [3, 4, 5]]


@pytest.mark.parametrize("first,second", [("louvain", "louvain"), ("k_core", "lpa"), ("islpa", "cnm"), ("k_clique", "slpa")])
def test_contracted_partition(spark, first, second):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5), (7, 8)]
    parts = kernels.contracted_parts(frame(spark, [(str(a), str(b)) for a, b in edges]), first, second)
    found = [(r.node, r.comm) for r in parts["communities"].collect()]
    assert sorted(v for v, _ in found) == list("01234578")
    if first == "louvain":
        assert {r.node for r in parts["cut_nodes"].collect()} >= {"4"}
    assert all(c == min(v for v, d in found if d == c) for _, c in found)


def test_largest_block_of_the_whole_graph_is_divided(spark):
    df = frame(spark, rings(1, 12) + list(itertools.combinations(["x1", "x2", "x3"], 2)))
    parts = kernels.contracted_parts(df)
    supers = {}
    for r in parts["supers"].collect():
        supers.setdefault(r["super"], set()).add(r.node)
    assert {"x1", "x2", "x3"} in supers.values() and len(supers) > 2


def test_what_is_left_without_some_nodes(spark):
    df = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")])
    gone = spark.createDataFrame([(0, "b"), (0, "x"), (0, "none")], "graph_id int, node string")
    assert {r.node: r.comp for r in graphs.eliminate(df, gone).collect()} == {"a": "a", "c": "c", "d": "c", "y": "y"}


@pytest.mark.parametrize("block", [1024, 2])
def test_pairs_two_steps_apart(spark, rows, block):
    edges = [("hub", f"n{i}") for i in range(7)] + [("n0", "n1"), ("n6", "z")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = sorted((a, b) for a in near for b in near if a < b and near[a] & near[b])
    assert rows(graphs.two_step_pairs(frame(spark, edges), block), "a", "b") == want


def test_core_of_a_long_path(spark, rows):
    df = frame(spark, [(f"{i:02}", f"{i + 1:02}") for i in range(24)])
    assert set(rows(graphs.k_core(df), "core")) == {(1,)}


def test_modularity(spark):
    df = frame(spark, list(itertools.combinations("abc", 2)) + list(itertools.combinations("xyz", 2)))
    members = spark.createDataFrame([(0, v, "1" if v in "abc" else "2") for v in "abcxyz"], "graph_id int, node string, comm string")
    assert graphs.modularity(df, members).first().modularity == pytest.approx(0.5)


@pytest.mark.parametrize("edges,want", [([("a", "b"), ("c", "d"), ("b", "e")], {"a": "a", "b": "a", "e": "a", "c": "c", "d": "c"}), ([(f"{i:03}", f"{i + 1:03}") for i in range(40)], {f"{i:03}": "000" for i in range(41)})])
def test_components(spark, edges, want):
    assert {r.node: r.comp for r in graphs.components(frame(spark, edges)).collect()} == want


def test_core_triangles_cliques(spark, rows):
    k4 = list(itertools.combinations("abcd", 2))
    df = frame(spark, k4 + [("d", "e"), ("x", "y")])
    assert dict(rows(graphs.k_core(df), "node", "core")) == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1, "x": 1, "y": 1}
    assert rows(graphs.triangles(df), "a", "b", "c") == sorted(itertools.combinations("abcd", 3))
    kinds = dict(rows(graphs.percolate_cliques(df), "node", "kind"))
    assert kinds == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1, "x": 2, "y": 2}


def test_neighbour_jaccard(spark, rows):
    df = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")])
    pairs = spark.createDataFrame([(0, "a", "b"), (0, "b", "d"), (0, "a", "a"), (0, "a", "zz")], "graph_id int, a string, b string")
    got = {(a, b): s for a, b, s in rows(graphs.neighbour_jaccard(df, pairs), "a", "b", "similarity")}
    assert got == {("a", "b"): pytest.approx(1 / 3), ("b", "d"): pytest.approx(0.25), ("a", "a"): 1.0, ("a", "zz"): 0.0}


def test_core_words_fall_back_to_the_best(spark, rows):
    members = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (0, 1, "c"), (0, 1, "d")], "graph_id int, comm int, node string")
    scores = spark.createDataFrame([(0, "a", 3.0), (0, "b", 1.0), (0, "c", None), (0, "d", None)], "graph_id int, node string, z double")
    assert rows(graphs.core_words(members, scores, "z", 2.5), "comm", "node") == [(0, "a"), (1, "c")]


def test_cosine_edges_against_all_pairs(spark, rows):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist(), "u") for i, x in enumerate(v)] + [(99, None, "u")], "id long, e array<double>, x string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] > 0.5)
    assert sorted((r.src, r.dst) for r in embeddings.cosine_edges(df, "id", "e", 0.5, block=16).collect()) == want


def test_empty_graph(spark):
    empty = frame(spark, [("a", "b")]).limit(0)
    assert graphs.components(empty).count() == graphs.triangles(empty).count() == graphs.k_core(empty).count() == 0


def test_label_propagation_ends_stable(spark):
    pairs = [(f"a{k}", f"b{k}") for k in range(12)] + [("p", "q"), ("q", "r"), ("p", "r"), ("r", "s"), ("s", "t"), ("t", "u"), ("s", "u")]
    df = frame(spark, pairs)
    for rounds in (12, 0):
        comm = {r.node: r.comm for r in graphs.propagate_labels(df, rounds).collect()}
        assert all(comm[f"a{k}"] == comm[f"b{k}"] for k in range(12))
        near = graphs.symmetric(df).collect()
        for v in comm:
            seen = [comm[r.other] for r in near if r.node == v]
            assert seen.count(comm[v]) == max(map(seen.count, seen))


def test_cosine_edges_within_each_graph(spark, rows):
    vectors = [(g, f"w{k}", [1.0, k / 10]) for g in (1, 2) for k in range(5)] + [(2, "z", [-1.0, 0.0])]
    df = spark.createDataFrame(vectors, "graph_id int, word string, vector array<double>")
    want = [(g, f"w{a}", f"w{b}") for g in (1, 2) for a in range(5) for b in range(a + 1, 5)]
    for block in (2048, 2):
        assert rows(embeddings.cosine_edges(df, "word", "vector", 0.3, block, by="graph_id"), "graph_id", "src", "dst") == want


def test_bigclam_has_a_column_for_every_node():
    k = 30
    edges = {e for i in range(k) for a in [3 * i] for e in [(a, a + 1), (a, a + 2), (a + 1, a + 2), tuple(sorted((a + 2, (a + 3) % (3 * k))))]}
    parts = kernels.parts_of("bigclam")(adjacency(3 * k, edges))
    assert {v for p in parts for v in p} == set(range(3 * k))
    assert len(set(map(tuple, parts))) > 24


def test_phrases_are_scored_with_the_vectors_at_hand_as_by_joins(spark, rows):
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("zero", [0.0, 0.0])], "word string, vector array<double>")
    phrases = spark.createDataFrame([(1, "a_b"), (1, "a_b"), (1, "a_a"), (1, "b_c"), (1, "c_none"), (1, "none"), (1, "zero_zero"), (2, "a_b"), (3, "a_b"), (3, "c_c"), (3, "a_c"), (4, "zero")], "paper_id long, phrase string")
    keywords = spark.createDataFrame([(1, "a"), (1, "a"), (1, "none"), (2, "none"), (3, "a"), (3, "b"), (4, "a")], "paper_id long, word string")
    plain = lambda df: rows(df.select("paper_id", "phrase", F.round("similarity", 9).alias("s")))
    every = embeddings._joined_phrases(phrases, keywords, vectors, "paper_id", 9)
    assert plain(embeddings._sent_phrases(phrases, keywords, vectors, "paper_id", 9)) == plain(every) and every.count() == 9
    got = embeddings.closest_phrases(phrases, keywords, vectors, "paper_id", 2).select("paper_id", "rank", "phrase")
    assert rows(got) == [(1, 1, "a_a"), (1, 2, "a_b"), (3, 1, "a_c"), (3, 2, "a_b"), (4, 1, "zero")]
    assert embeddings.closest_phrases(phrases, keywords, vectors.limit(0), "paper_id", 2).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_nearest_words_need_few_of_the_pairs(spark, rows, block):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(3)
    values = [(f"w{k}", [float(x) for x in draw.integers(-1, 2, 4)]) for k in range(60)]  # many ties, some without length
    vectors = spark.createDataFrame(values, "word string, vector array<double>")
    every, few = embeddings.cosine_edges(vectors, "word", "vector", -0.5, block), embeddings.cosine_edges(vectors, "word", "vector", -0.5, block, most=3)
    plain = lambda edges: rows(embeddings.nearest(vectors, edges, 3).select("word", "other", "rank", F.round("weight", 9)))
    assert plain(few) == plain(every)
    assert few.count() < every.count()
