"""Sequential graph algorithms on one connected component, and their distributed runner.

A kernel takes the nodes' names and a list of weighted neighbours, and gives
rows.  Components run as separate groups, so graphs and components are
spread over the cluster; one component is the unit that an algorithm of this kind needs whole.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators.graphs import components, main_core, percolate_cliques, propagate_labels
from topicweave.operators.groups import with_stats
from topicweave.plans.stage import spread, stage

Graph = list[dict[int, float]]


def build(src, dst, weight) -> tuple[list[str], Graph]:
    names = sorted({*src, *dst})
    index = {v: i for i, v in enumerate(names)}
    g: Graph = [{} for _ in names]
    for a, b, w in zip(src, dst, weight):
        i, j = index[a], index[b]
        g[i][j] = g[i].get(j, 0.0) + w
        if i != j:
            g[j][i] = g[j].get(i, 0.0) + w
    return names, g


def run_kernel(edges: DataFrame, kernel: Callable[..., list[tuple]], schema: str, by_component: bool = True, told: str | None = None, comps: DataFrame | None = None) -> DataFrame:
    """Rows ``(graph_id, *schema)`` of a kernel on each component (or graph).

    ``told`` names a column of the edges, one value for a component, that goes to the kernel as third argument;
    ``comps`` are the components, if they are known already.
    """
    kind = edges.schema["graph_id"].dataType.simpleString()
    full = f"graph_id {kind}, {schema}"
    columns = [c.split()[0] for c in full.split(", ")]
    keys = ["graph_id"]
    rows = edges.select("graph_id", "src", "dst", F.col("weight").cast("double").alias("weight"), *([told] if told else []))
    if by_component:
        comps = components(edges) if comps is None else comps
        rows = rows.join(comps.select("graph_id", F.col("node").alias("src"), "comp"), ["graph_id", "src"])
        keys.append("comp")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, g = build(pdf["src"], pdf["dst"], pdf["weight"])
        out = kernel(names, g, pdf[told].iloc[0]) if told else kernel(names, g)
        return pd.DataFrame([(pdf["graph_id"].iloc[0], *r) for r in out], columns=columns)

    return spread(rows, *keys).groupBy(*keys).applyInPandas(one, full)


# ---- connectivity ------------------------------------------------------------


def _search(g: Graph) -> tuple[list[int], list[int], list[int], list[list[int]], set[int], list[tuple[int, int]]]:
    """Depth-first search: discovery, low points, parents, biconnected node sets, cut nodes, bridges.  Loops don't matter."""
    n = len(g)
    seen, low, parent = [-1] * n, [0] * n, [-1] * n
    blocks, cuts, bridges, stack, clock = [], set(), [], [], 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        children = 0
        stack.append(root)
        path = [(root, iter(sorted(g[root])))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if w == v:
                    continue
                if seen[w] < 0:
                    parent[w] = v
                    seen[w] = low[w] = clock
                    clock += 1
                    children += v == root
                    stack.append(w)
                    path.append((w, iter(sorted(g[w]))))
                    break
                if w != parent[v]:
                    low[v] = min(low[v], seen[w])
            else:
                path.pop()
                if path:
                    u = path[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > seen[u]:
                        bridges.append((min(u, v), max(u, v)))
                    if low[v] >= seen[u]:
                        block = [u]
                        while True:
                            w = stack.pop()
                            block.append(w)
                            if w == v:
                                break
                        blocks.append(sorted(block))
                        if u != root:
                            cuts.add(u)
        if children > 1:
            cuts.add(root)
        if not children:
            blocks.append([root])
        stack.clear()
    return seen, low, parent, blocks, cuts, bridges


class Sets:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[int]]:
        out = defaultdict(list)
        for i in range(len(self.up)):
            out[self.find(i)].append(i)
        return sorted(out.values())


def biconnected(g: Graph) -> list[list[int]]:
    return sorted(_search(g)[3])


def two_edge(g: Graph) -> list[list[int]]:
    gone, sets = set(_search(g)[5]), Sets(len(g))
    for a in range(len(g)):
        for b in g[a]:
            if a < b and (a, b) not in gone:
                sets.join(a, b)
    return sets.groups()


def three_edge(g: Graph, seed: int = 5) -> list[list[int]]:
    """Nodes that no two edges separate.

    Every edge outside the search tree gets a random number, and a tree edge the exclusive or
    of those that pass over it; edges of equal number cut the graph in pairs, and with all of them taken out its
    parts lie in a ring.  The ends that face each other within a part belong together.
    """
    seen, _, parent, _, _, bridges = _search(g)
    rng, n = np.random.default_rng(seed), len(g)
    order = sorted(range(n), key=lambda v: seen[v])
    mark, number = [0] * n, {}
    for a in range(n):
        for b in g[a]:
            if a < b and parent[a] != b and parent[b] != a:
                r = int(rng.integers(1, 1 << 62)) << 1 | 1
                number[a, b] = r
                mark[a] ^= r
                mark[b] ^= r
    for v in reversed(order):
        if parent[v] >= 0:
            number[min(v, parent[v]), max(v, parent[v])] = mark[v]
            mark[parent[v]] ^= mark[v]
    classes = defaultdict(list)
    for e, r in number.items():
        classes[r].append(e)
    # the tree edges of a class lie on one path from the root down, and one other edge at most belongs to it
    sets, gone = Sets(n), set(bridges)
    children = [[] for _ in range(n)]
    for v in range(n):
        if parent[v] >= 0:
            children[parent[v]].append(v)
    last = dict(zip(order, range(n)))
    for v in reversed(order):  # the last place in the search of each subtree
        for c in children[v]:
            last[v] = max(last[v], last[c])
    under = lambda v, top: seen[top] <= seen[v] <= last[top]
    for r, es in classes.items():
        if not r:
            continue
        if len(es) == 1:
            if es[0] not in gone:
                sets.join(*es[0])
            continue
        # tree edges of the class from the top down, each as (upper end, lower end)
        tree = sorted(((a, b) if parent[b] == a else (b, a) for a, b in es if parent[a] == b or parent[b] == a), key=lambda e: seen[e[1]])
        back = [e for e in es if not (parent[e[0]] == e[1] or parent[e[1]] == e[0])]
        for (_, low), (up, _) in zip(tree, tree[1:]):
            sets.join(low, up)
        if back:  # it closes the cycle: one end below the lowest tree edge, the other above the highest
            inner, outer = back[0] if under(back[0][0], tree[-1][1]) else back[0][::-1]
            sets.join(tree[-1][1], inner)
            sets.join(tree[0][0], outer)
        else:  # all that passes over one of them passes over all
            sets.join(tree[-1][1], tree[0][0])
    return sets.groups()


# ---- paths and centrality ------------------------------------------------------


def hops(g: Graph, s: int) -> dict[int, int]:
    d, queue = {s: 0}, deque([s])
    while queue:
        v = queue.popleft()
        for w in g[v]:
            if w not in d:
                d[w] = d[v] + 1
                queue.append(w)
    return d


def betweenness(g: Graph, by_edge: bool = False):
    """Brandes' sums over all shortest paths, unweighted; halves for undirected graphs."""
    node, edge = [0.0] * len(g), defaultdict(float)
    for s in range(len(g)):
        d, count, before, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sorted(g[v]):
                if w == v:
                    continue
                if w not in d:
                    d[w] = d[v] + 1
                    queue.append(w)
                if d[w] == d[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                c = count[v] / count[w] * (1 + share[w])
                edge[min(v, w), max(v, w)] += c / 2
                share[v] += c
            if w != s:
                node[w] += share[w] / 2
    return edge if by_edge else node


def closeness(g: Graph, total: int) -> list[float]:
    out = []
    for s in range(len(g)):
        d = hops(g, s)
        r, far = len(d) - 1, sum(d.values())
        out.append(r / (total - 1) * r / far if r and total > 1 else 0.0)
    return out


def eigenvector(g: Graph, most: int = 1000) -> list[float]:
    n = len(g)
    a = [(i, j) for i in range(n) for j in g[i]]
    i, j = (np.array(x, int) for x in zip(*a)) if a else (np.empty(0, int),) * 2
    x = np.full(n, 1 / n)
    for _ in range(most):
        y = x + np.bincount(i, x[j], n)
        y /= np.linalg.norm(y) or 1
        if np.abs(y - x).sum() < n * 1e-6:
            return y.tolist()
        x = y
    return x.tolist()


def best_paths(g: Graph, s: int, keys: set[int]) -> dict[int, tuple[float, int, tuple[int, ...]]]:
    """Shortest paths by distance 1 / weight; then fewest keywords on the way, then smallest nodes."""
    done, heap = {}, [(0.0, 0, (s,))]
    while heap:
        d, k, path = heapq.heappop(heap)
        v = path[-1]
        if v in done:
            continue
        done[v] = d, k, path
        for w, weight in g[v].items():
            if w not in done:
                heapq.heappush(heap, (round(d + 1 / weight, 12), k + (v in keys and v != s), (*path, w)))
    return done


def contract_to(g: Graph, keys: list[int]) -> list[tuple[int, int, float]]:
    """Edges between keywords whose best path has no other keyword inside; the weight is 1 / its length."""
    chosen, out = set(keys), []
    for s in sorted(chosen):
        for t, (d, inner, path) in sorted(best_paths(g, s, chosen).items()):
            if t in chosen and s < t and (not inner or len(path) == 2):
                out.append((s, t, 1 / d))
    return out


# ---- communities ----------------------------------------------------------------


def louvain(g: Graph, total: float | None = None) -> list[list[int]]:
    """Weighted modularity by local moves and aggregation; nodes in order, ties to the smallest community.

    ``total`` is the weight of all edges where ``g`` is a part of a larger graph: parts without edges
    between them never join, so each can be divided by itself with the whole graph's weight.
    """
    level = [dict(x) for x in g]
    groups = [[i] for i in range(len(g))]
    m = total or sum(w * (2 if i == j else 1) for i, x in enumerate(g) for j, w in x.items()) / 2
    if not m:
        return groups
    while True:
        n = len(level)
        strength = [sum(w for j, w in x.items() if j != i) + 2 * x.get(i, 0.0) for i, x in enumerate(level)]
        comm, total, moved = list(range(n)), strength[:], False
        for _ in range(100):
            changed = False
            for v in range(n):
                own = comm[v]
                link = defaultdict(float)
                for w, weight in level[v].items():
                    if w != v:
                        link[comm[w]] += weight
                total[own] -= strength[v]
                gain = lambda c: link.get(c, 0.0) - total[c] * strength[v] / (2 * m)
                best = min(sorted(link), key=lambda c: (-round(gain(c), 10), c != own, c), default=own)
                if best != own and gain(best) <= gain(own) + 1e-10:
                    best = own
                total[best] += strength[v]
                if best != own:
                    comm[v], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            return sorted(sorted(x) for x in groups)
        names = {c: k for k, c in enumerate(sorted(set(comm)))}
        merged: Graph = [{} for _ in names]
        for v, x in enumerate(level):
            for w, weight in x.items():
                a, b = names[comm[v]], names[comm[w]]
                if v == w:
                    merged[a][a] = merged[a].get(a, 0.0) + weight
                elif a == b:
                    merged[a][a] = merged[a].get(a, 0.0) + weight / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + weight
        joined = [[] for _ in names]
        for v, c in enumerate(comm):
            joined[names[c]] += groups[v]
        level, groups = merged, joined


def greedy_modularity(g: Graph, total: float | None = None) -> list[list[int]]:
    """Merges the two communities with the largest gain in modularity while there is one; ``total`` as for :func:`louvain`."""
    n = len(g)
    m = total or sum(w for i, x in enumerate(g) for j, w in x.items() if i < j) + sum(x.get(i, 0.0) for i, x in enumerate(g))
    if not m:
        return [[i] for i in range(n)]
    between = [{j: w / m for j, w in x.items() if j != i} for i, x in enumerate(g)]
    share = [(sum(w for j, w in x.items() if j != i) + 2 * x.get(i, 0.0)) / (2 * m) for i, x in enumerate(g)]
    parts = {i: [i] for i in range(n)}
    heap = [(-round(w - 2 * share[i] * share[j], 12), i, j) for i in range(n) for j, w in between[i].items() if i < j]
    heapq.heapify(heap)
    while heap:
        d, i, j = heapq.heappop(heap)
        if i not in parts or j not in parts or j not in between[i] or -round(between[i][j] - 2 * share[i] * share[j], 12) != d:
            continue
        if d >= 0:
            break
        parts[i] += parts.pop(j)
        share[i] += share[j]
        for k, w in between[j].items():
            between[k].pop(j, None)
            if k != i:
                between[i][k] = between[k][i] = between[i].get(k, 0.0) + w
        for k, w in between[i].items():
            if k in parts and k != i:
                a, b = min(i, k), max(i, k)
                heapq.heappush(heap, (-round(w - 2 * share[a] * share[b], 12), a, b))
    return sorted(sorted(x) for x in parts.values())


def first_split(g: Graph) -> tuple[list[list[int]], float, tuple[int, int]]:
    """Takes away the edge with the largest betweenness until a part comes off.

    Also gives the smallest of the taken edges' scores and its edge: of several graphs side by side,
    the one where this is largest comes apart first.
    """
    h = [dict(x) for x in g]

    def pieces():
        s = Sets(len(h))
        for a, x in enumerate(h):
            for b in x:
                s.join(a, b)
        return s.groups()

    start, least, at = len(pieces()), float("inf"), (0, 0)
    while len(out := pieces()) == start and any(b != a for a, x in enumerate(h) for b in x):
        scores = betweenness(h, True)
        a, b = min(scores, key=lambda e: (-round(scores[e], 9), e))
        if round(scores[a, b], 9) < least:
            least, at = round(scores[a, b], 9), (a, b)
        del h[a][b], h[b][a]
    return out, least, at


def spread_labels(g: Graph, seed: int = 7) -> list[list[int]]:
    """Asynchronous label propagation by weight: nodes in random order take a neighbour's label of the largest weight, until all have one."""
    rng, label = np.random.default_rng(seed), list(range(len(g)))
    changed = True
    while changed:
        changed = False
        for v in rng.permutation(len(g)).tolist():
            heard = defaultdict(float)
            for w, weight in g[v].items():
                if w != v:
                    heard[label[w]] += weight
            if heard and heard[label[v]] < max(heard.values()) - 1e-12:
                top = max(heard.values()) - 1e-12
                label[v], changed = int(rng.choice(sorted(c for c, x in heard.items() if x >= top))), True
    return _grouped(label)


def _grouped(label: list[int]) -> list[list[int]]:
    out = defaultdict(list)
    for v, c in enumerate(label):
        out[c].append(v)
    return sorted(out.values())


def colour_labels(g: Graph) -> list[list[int]]:
    """Semi-synchronous label propagation: nodes of one colour, no two of them neighbours, take their neighbours' most frequent label together.

    Ties prefer the own label, then the largest.  Colours go to nodes by falling degree, the smallest that is free.
    """
    near = [[w for w in x if w != v] for v, x in enumerate(g)]
    colour: dict[int, int] = {}
    for v in sorted(range(len(g)), key=lambda v: (-len(near[v]), v)):
        used = {colour[w] for w in near[v] if w in colour}
        colour[v] = next(c for c in range(len(g) + 1) if c not in used)
    classes = defaultdict(list)
    for v, c in colour.items():
        classes[c].append(v)
    label = list(range(len(g)))

    def most(v: int) -> set[int]:
        count = Counter(label[w] for w in near[v])
        top = max(count.values(), default=0)
        return {c for c, n in count.items() if n == top} or {label[v]}

    while not all(label[v] in most(v) for v in range(len(g))):
        for c in sorted(classes):
            for v, best in [(v, most(v)) for v in classes[c]]:
                if label[v] not in best:
                    label[v] = max(best)
    return _grouped(label)


def core_and_rest(g: Graph) -> list[list[int]]:
    """The core of the largest k, then the components of the rest."""
    near = [{w for w in x if w != v} for v, x in enumerate(g)]
    degree, core, k = [len(x) for x in near], [0] * len(g), 0
    heap = [(d, v) for v, d in enumerate(degree)]
    heapq.heapify(heap)
    done: set[int] = set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done or d != degree[v]:
            continue
        done.add(v)
        k = core[v] = max(k, d)
        for w in near[v] - done:
            degree[w] -= 1
            heapq.heappush(heap, (degree[w], w))
    inner = {v for v in range(len(g)) if core[v] == k}
    rest = Sets(len(g))
    for v in range(len(g)):
        for w in near[v]:
            if v not in inner and w not in inner:
                rest.join(v, w)
    return [sorted(inner), *(x for x in rest.groups() if x[0] not in inner)]


def cliques_of_three(g: Graph) -> list[list[int]]:
    """Triangles that share edges, then edges among the rest, then single nodes; overlapping."""
    near = [{w for w in x if w != v} for v, x in enumerate(g)]
    found = [(a, b, c) for a in range(len(g)) for b in near[a] if b > a for c in near[a] & near[b] if c > b]
    sets, first = Sets(len(found)), {}
    for i, (a, b, c) in enumerate(found):
        for side in ((a, b), (a, c), (b, c)):
            sets.join(first.setdefault(side, i), i)
    out = [sorted({v for i in group for v in found[i]}) for group in sets.groups()]
    used = {v for x in out for v in x}
    rest = Sets(len(g))
    for v in range(len(g)):
        for w in near[v]:
            if v not in used and w not in used:
                rest.join(v, w)
    return sorted(out) + [x for x in rest.groups() if x[0] not in used]


def fluid(g: Graph, seed: int = 3, rounds: int = 100) -> list[list[int]]:
    """Fluid communities: k densities spread over a connected graph; k = floor(1.7 ^ ln n)."""
    n = len(g)
    k = max(1, min(n, int(1.7 ** np.log(n)))) if n > 1 else 1
    rng = np.random.default_rng(seed)
    comm = {int(v): c for c, v in enumerate(rng.permutation(n)[:k])}
    size = Counter(comm.values())
    for _ in range(rounds):
        changed = False
        for v in rng.permutation(n).tolist():
            total = defaultdict(float)
            for w in [v, *g[v]]:
                if w in comm:
                    total[comm[w]] += 1 / size[comm[w]]
            if not total:
                continue
            top = max(total.values())
            best = [c for c in sorted(total) if total[c] > top - 1e-9]
            if comm.get(v) in best:
                continue
            if v in comm:
                if size[comm[v]] == 1:
                    continue
                size[comm[v]] -= 1
            comm[v] = best[0]
            size[best[0]] += 1
            changed = True
        if not changed:
            break
    out = defaultdict(list)
    for v in range(n):
        out[comm.get(v, -1 - v)].append(v)
    return sorted(out.values())


def speaker_listener(g: Graph, rounds: int = 30, share: float = 0.33, seed: int = 11) -> list[list[int]]:
    """SLPA: nodes collect labels their neighbours speak.

    A label new to a node starts with 1.5.  In the end a node draws one of its labels by their counts and keeps
    it if it has ``share`` of the rounds; nodes without one stand alone.
    """
    n, rng = len(g), np.random.default_rng(seed)
    memory: list[dict[int, float]] = [{v: 1.0} for v in range(n)]

    def spoken(v: int) -> int:
        labels = sorted(memory[v])
        p = np.array([memory[v][x] for x in labels])
        return labels[min(int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random(), "right")), len(labels) - 1)]

    for _ in range(rounds):
        for v in rng.permutation(n).tolist():
            heard = defaultdict(float)
            for w, weight in sorted(g[v].items()):
                if w != v:
                    heard[spoken(w)] += weight
            if heard:
                label = min(heard, key=lambda c: (-heard[c], c))
                memory[v][label] = memory[v].get(label, 0.5) + 1
    members = defaultdict(list)
    for v in range(n):
        label = spoken(v)
        members[label if memory[v][label] / (rounds + 1) >= share else -1 - v].append(v)
    return sorted(members.values())


def affiliation(g: Graph, steps: int = 1000, rate: float = 0.005, seed: int = 13) -> list[list[int]]:
    """BigCLAM: non-negative memberships F, a column for every node, with edge probability 1 - exp(-Fu Fv), by gradient steps node by node.

    A node's community holds those to which its edge probability is more than half of their highest one.
    """
    n = len(g)
    f = np.random.default_rng(seed).random((n, n))
    for u in range(n):
        near = [w for w in g[u] if w != u]
        fn = f[near]
        apart = f.sum(0) - f[u] - fn.sum(0)
        for _ in range(steps):
            x = np.clip(fn @ f[u], 1e-6, 30)
            new = np.maximum(0.001, f[u] + rate * ((1 / np.expm1(x)) @ fn - apart))
            if np.array_equal(new, f[u]):  # all further steps are the same
                break
            f[u] = new
    p = -np.expm1(-(f @ f.T))
    p /= p.max(1, keepdims=True)
    out = [np.flatnonzero(p[:, c] > 0.5).tolist() for c in range(n)]
    return sorted(x for x in out if x)


#: Algorithms on one connected graph, by name.
PARTS: dict[str, Callable[[Graph], list[list[int]]]] = {
    "louvain": louvain, "lpa": spread_labels, "fluid": fluid, "islpa": colour_labels, "slpa": speaker_listener, "gn": lambda g: first_split(g)[0], "cnm": greedy_modularity,
    "k_core": core_and_rest, "k_clique": cliques_of_three, "bigclam": affiliation, "bicomponents": biconnected, "two_edge": two_edge, "three_edge": three_edge,
}


def parts_of(name: str) -> Callable[[Graph], list[list[int]]]:
    """Community algorithm by name, for one connected graph."""
    if name not in PARTS:
        raise ValueError(f"no algorithm {name}; there are {', '.join(PARTS)}")
    return PARTS[name]


def communities(edges: DataFrame, name: str, comps: DataFrame | None = None) -> DataFrame:
    """``(graph_id, node, comm)`` of a named algorithm on each graph as a whole.

    Modularity is that of the whole graph, the first split divides one of its components only, the main core is that of
    the whole graph.  Everything else divides each connected component by itself, which gives the same as the whole would.
    """
    find = parts_of(name)
    if name == "lpa":
        return propagate_labels(edges)
    if name == "k_core":
        return main_core(edges)
    if name == "k_clique":
        return percolate_cliques(edges).select("graph_id", "node", "comm")
    if name == "gn":
        return _split_once(edges, comps)
    label = lambda names, parts: [(names[v], f"{names[part[0]]}#{k}") for k, part in enumerate(parts) for v in part]
    if name in ("louvain", "cnm"):
        whole = with_stats(edges, ["graph_id"], _total=F.sum("weight"))
        return run_kernel(whole, lambda names, g, total: label(names, find(g, float(total))), "node string, comm string", told="_total", comps=comps)
    return run_kernel(edges, lambda names, g: label(names, find(g)), "node string, comm string", comps=comps)


def _split_once(edges: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The first split: of all components the one that comes apart first is divided, the others stay."""

    def kernel(names: list[str], g: Graph) -> list[tuple]:
        parts, least, (a, b) = first_split(g)
        return [(names[v], names[0], names[part[0]], -1.0 if len(parts) < 2 else least, f"{names[a]}\u0001{names[b]}") for part in parts for v in part]

    found = stage(run_kernel(edges, kernel, "node string, comp string, part string, least double, edge string", comps=comps))
    first = found.filter("least >= 0").groupBy("graph_id").agg(F.min_by("comp", F.struct(-F.col("least"), F.col("edge"))).alias("first"))
    return found.join(first, "graph_id", "left").select("graph_id", "node", F.when(F.col("comp") == F.col("first"), F.col("part")).otherwise(F.col("comp")).alias("comm"))


def _contract(first: str):
    """Super-nodes of a component, their members, and the edges between them.

    The parts of the graph's largest biconnected component by ``first``, then all other biconnected components.
    Weights count neighbours only.  Names of super-nodes sort as these do: parts first, then by falling size.
    """

    def kernel(names: list[str], g: Graph, largest: bool) -> list[tuple]:
        blocks = sorted(biconnected(g), key=lambda b: (-len(b), b))
        parts: list[list[int]] = []
        at: dict[int, int] = {}
        if largest:
            big, blocks = blocks[0], blocks[1:]
            at = {v: i for i, v in enumerate(big)}
            sub = [{at[w]: 1.0 for w in g[v] if w in at and w != v} for v in big]
            parts = [[big[i] for i in p] for p in parts_of(first)(sub)]
        nodes = parts + blocks
        label = [f"{int(k >= len(parts))}|{10**9 - len(x) if k >= len(parts) else k:010}|{names[x[0]]}|{k:09}" for k, x in enumerate(nodes)]
        where = defaultdict(list)
        for k, members in enumerate(nodes):
            for v in members:
                where[v].append(k)
        inside = [set(x) for x in nodes]
        weight: dict[tuple[int, int], float] = {}
        for k, members in enumerate(nodes):
            own = sum(w in inside[k] for v in members for w in g[v] if w != v) / 2
            if own:
                weight[k, k] = own
        part_of = {v: k for k, members in enumerate(parts) for v in members}
        for v in at:  # edges that cross between parts of the largest
            for w in g[v]:
                if w in at and v < w and part_of[v] != part_of[w]:
                    e = tuple(sorted((part_of[v], part_of[w])))
                    weight[e] = weight.get(e, 0.0) + 1
        for v, held in where.items():
            count = {k: float(sum(w in inside[k] for w in g[v])) for k in held} if len(held) > 1 else {}
            for x, a in enumerate(held):
                for b in held[x + 1 :]:
                    if count[a] + count[b]:
                        weight[a, b] = max(count[a] + count[b], weight.get((a, b), 0.0))
        out = [("member", label[k], names[v], 0.0) for k, members in enumerate(nodes) for v in members]
        return out + [("edge", *sorted((label[a], label[b])), w) for (a, b), w in weight.items()]

    return kernel


def contracted_parts(edges: DataFrame, first: str = "louvain", second: str = "louvain") -> dict[str, DataFrame]:
    """Partition by biconnected components and a second pass over them, with its intermediate results.

    The largest biconnected component of a graph is divided by ``first``; its parts and the other
    biconnected components become nodes of a smaller graph; ``second`` divides that, and a cut node
    stays in the first community that holds it.

    - ``supers (graph_id, super, node)`` and ``edges (graph_id, src, dst, weight)``: the smaller graph
    - ``cut_nodes (graph_id, node)``: nodes in more than one super-node
    - ``communities (graph_id, node, comm)``: a partition; a community is named by its smallest node
    """
    parts_of(first), parts_of(second)
    edges = stage(edges)
    comps = stage(components(edges))
    sizes = run_kernel(edges, lambda names, g: [(names[0], max(map(len, biconnected(g))))], "comp string, size int", comps=comps)
    largest = sizes.groupBy("graph_id").agg(F.min_by("comp", F.struct(-F.col("size"), F.col("comp"))).alias("_largest"))
    of = comps.select("graph_id", F.col("node").alias("src"), F.col("comp").alias("_comp"))
    marked = edges.join(of, ["graph_id", "src"]).join(largest, "graph_id").withColumn("_big", F.col("_comp") == F.col("_largest"))
    made = stage(run_kernel(marked, _contract(first), "kind string, a string, b string, weight double", told="_big", comps=comps))
    supers = made.filter("kind = 'member'").select("graph_id", F.col("a").alias("super"), F.col("b").alias("node"))
    small = made.filter("kind = 'edge'").select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    named = communities(small, second).withColumnRenamed("node", "super")
    # communities in the order of their first super-node; a super-node without edges is one of its own
    placed = supers.join(named, ["graph_id", "super"], "left").withColumn("comm", F.coalesce("comm", "super"))
    order = placed.groupBy("graph_id", "comm").agg(F.min("super").alias("order"))
    once = stage(placed.join(order, ["graph_id", "comm"]).groupBy("graph_id", "node").agg(F.min(F.struct("order", "comm")).alias("_c")).select("graph_id", "node", F.col("_c.comm").alias("_comm")))
    least = once.groupBy("graph_id", "_comm").agg(F.min("node").alias("comm"))
    cut = supers.groupBy("graph_id", "node").agg(F.count("*").alias("n")).filter("n > 1").select("graph_id", "node")
    return {"supers": supers, "edges": small, "cut_nodes": cut, "communities": once.join(least, ["graph_id", "_comm"]).select("graph_id", "node", "comm")}


def contracted_communities(edges: DataFrame, first: str = "louvain", second: str = "louvain") -> DataFrame:
    """``(graph_id, node, comm)`` of :func:`contracted_parts`."""
    return contracted_parts(edges, first, second)["communities"]
