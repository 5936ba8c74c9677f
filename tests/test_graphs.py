"""Directed graphs, spanning forests and hierarchies against brute force."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from taxolark.operators import digraph, forest, relations, vocabulary
from taxolark.operators.stored import stored
from taxolark.plans import all_queries
from taxolark.plans.registry import edges


def made(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in [*range(n), None, 0]], "node long")
    return nodes, spark.createDataFrame(edges, "source long, target long, confidence double, bidirectional boolean")


def arcs(n, edges, least=0.5):
    out = defaultdict(set)
    for a, b, w, both in edges:
        if None in (a, b) or a == b or not (a < n and b < n) or w <= least:
            continue
        out[a].add(b)
        if both:
            out[b].add(a)
    return out


def reached(out, start):
    seen, todo = {start}, [start]
    while todo:
        for y in out[todo.pop()]:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def random_edges(seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.3, 0.6, 0.9]), rng.random() < 0.1) for _ in range(m)]
    return [*edges, edges[0], (None, 1, 0.9, False), (n + 5, 1, 0.9, True), (2, 2, 0.9, False)]


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 60), (2, 30, 90)])
def test_directed_clusters_and_components(spark, seed, n, m):
    edges = random_edges(seed, n, m)
    nodes, df = made(spark, n, edges)
    out = arcs(n, edges)
    # nodes in order take what they reach and no earlier one has
    taken = {}
    for i in range(n):
        if i not in taken:
            for j in reached(out, i):
                taken.setdefault(j, i)
    got = digraph.clusters(nodes, df)
    assert {r["node"]: r["cluster"] for r in got.collect()} == taken
    reach = {i: reached(out, i) for i in range(n)}
    strong = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
    rows = digraph.strong_components(nodes, df.where("confidence > 0.5")).collect()
    assert len(rows) == n and {r["node"]: r["component"] for r in rows} == strong


def test_directions_count(spark):
    """1 > 0 and 1 > 2: without directions one cluster of three, with them the first node alone."""
    nodes, df = made(spark, 3, [(1, 0, 0.9, False), (1, 2, 0.9, False)])
    assert {r["node"]: r["cluster"] for r in digraph.clusters(nodes, df).collect()} == {0: 0, 1: 1, 2: 1}
    nodes, both = made(spark, 3, [(1, 0, 0.9, True), (1, 2, 0.9, False)])
    assert {r["node"]: r["cluster"] for r in digraph.clusters(nodes, both).collect()} == {0: 0, 1: 0, 2: 0}


def test_long_chain_and_nothing(spark):
    order = list(range(64))
    random.Random(3).shuffle(order)
    nodes, df = made(spark, 64, [(a, b, 0.9, False) for a, b in zip(order, order[1:], strict=False)])
    want, low = {}, 64
    for x in order:
        low = min(low, x)
        want[x] = low
    assert {r["node"]: r["cluster"] for r in digraph.clusters(nodes, df).collect()} == want
    nodes, none = made(spark, 2, [])
    assert {r["node"]: r["cluster"] for r in digraph.clusters(nodes, none).collect()} == {0: 0, 1: 1}
    assert {r["node"]: r["component"] for r in digraph.strong_components(nodes, none).collect()} == {0: 0, 1: 1}


def between(n, out, starts):
    """Betweenness and closeness, one start after another."""
    b, met, far = defaultdict(float), defaultdict(int), defaultdict(int)
    for s in starts:
        hops, ways, order, todo = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in out[x]:
                if y not in hops:
                    hops[y] = hops[x] + 1
                    todo.append(y)
                if hops[y] == hops[x] + 1:
                    ways[y] += ways[x]
        share = defaultdict(float)
        for y in reversed(order):
            for x in order:
                if y in out[x] and hops[x] + 1 == hops[y]:
                    share[x] += ways[x] / ways[y] * (1 + share[y])
            if y != s:
                b[y] += share[y]
                met[y] += 1
                far[y] += hops[y]
    k = n / len(starts)
    return {i: (b[i] * k / ((n - 1) * (n - 2)), met[i] * k / (n - 1) * met[i] / far[i] if far[i] else 0.0) for i in range(n)}


def test_centrality(spark):
    n = 18
    edges = random_edges(7, n, 40)
    nodes, df = made(spark, n, edges)
    strong = df.where("confidence > 0.5")
    exact = between(n, arcs(n, edges), range(n))
    got = {r["node"]: (r["betweenness"], r["closeness"]) for r in digraph.centrality(nodes, strong).collect()}
    assert got == {i: pytest.approx(v) for i, v in exact.items()}
    starts = digraph.pivots(nodes, 9)
    drawn = [r["node"] for r in starts.collect()]
    assert len(drawn) == 9 and drawn == [r["node"] for r in digraph.pivots(nodes, 9).collect()]
    some = {r["node"]: (r["betweenness"], r["closeness"]) for r in digraph.centrality(nodes, strong, starts).collect()}
    assert some == {i: pytest.approx(v) for i, v in between(n, arcs(n, edges), drawn).items()}
    # an estimate from half of the nodes as starts is near on the whole
    assert sum(abs(some[i][0] - exact[i][0]) for i in range(n)) / n < 0.05


def kruskal(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for a, b, s in sorted({(min(a, b), max(a, b), s) for a, b, s in pairs if a is not None and s is not None and a != b}, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, s))
    return out


def test_spanning_forest(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(50), rng.randrange(50), rng.randrange(5) / 4) for _ in range(120)] + [(None, 1, 1.0), (3, 4, None), (1, 1, 1.0)]
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    tree = forest.spanning_forest(df)
    want = kruskal(pairs)
    assert sorted(map(tuple, tree.collect())) == sorted(want)
    steps = [(r["a"], r["b"], r["height"]) for r in forest.merges(tree).orderBy("step").collect()]
    assert steps == want
    nodes = spark.createDataFrame([(i,) for i in range(52)], "node long")
    for level in (0.25, 0.5, 1.0):
        out = defaultdict(set)
        for a, b, s in pairs:
            if None not in (a, b, s) and s >= level:
                out[a].add(b)
                out[b].add(a)
        got = {r["node"]: r["cluster"] for r in forest.cut(nodes, tree, level).collect()}
        assert got == {i: min(reached(out, i)) for i in range(52)}
    assert forest.spanning_forest(df.limit(0)).collect() == []


def test_hierarchy_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(1000)]
    circle = [(2000, 2002), (2001, 2000), (2002, 2001), (2003, 2001)]
    other = [(3000, 9999), (3001, 3000), (3001, 3000)]
    h = vocabulary.Hierarchy(spark.createDataFrame(chain + circle + other, "term_id long, parent_term_id long"))
    got = {r["term_id"]: (r["root_id"], r["depth"]) for r in h.reached.collect()}
    assert got == {**{i: (0, i) for i in range(1000)}, 3000: (3000, 0), 3001: (3000, 1)}
    assert sorted(r["term_id"] for r in h.circular.collect()) == [2000, 2001, 2002, 2003]
    assert [r["term_id"] for r in h.path(999).orderBy("place").collect()] == list(range(1000))
    assert h.descendants(990, 3).count() == 3 and h.depths().count() == 2


@pytest.mark.parametrize("name", ("data_quality", "degree_centrality", "forest_cuts", "graph_metrics", "graph_traversal_search", "hierarchical_clusters", "hybrid_search", "pagerank", "pattern_match", "rank_balanced", "rank_confidence", "rank_freshness", "rank_popularity"))
def test_queries_on_edges_count_pairs_in_bounded_tasks(spark, folder, monkeypatch, name):
    class Asked(Exception):
        pass

    def ask(*given):
        raise Asked(given)

    cooccurrence = vocabulary.cooccurrence
    monkeypatch.setattr(vocabulary, "cooccurrence", ask)
    with pytest.raises(Asked) as asked:
        all_queries()[name](spark, folder)
    monkeypatch.setattr(vocabulary, "PAIRS", 500)
    # all pairs that are counted, also those that are too few for an edge
    pairs = cooccurrence(*asked.value.args[0][:3], 1)
    sizes = [r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) > 5000 and max(sizes) < 1000


def test_parts_are_not_sent_whole_to_tasks_that_count_pairs(spark, folder):
    found = edges(spark, folder)
    assert len(found.collect()) > 0
    # the parts are small enough here for Spark to broadcast them of its own accord
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ("forest_cuts", "hierarchical_clusters"))
def test_labels_of_all_parts_are_not_sent_whole_to_tasks(spark, folder, monkeypatch, name):
    plans = []

    def seen(df):
        # what Spark plans before it knows any size, so by the size of files alone
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df)

    monkeypatch.setattr(relations, "stored", seen)
    all_queries()[name](spark, folder)
    # a round's labels: broadcasts of what is counted or grouped from edges are small, those of labels are not
    rounds = [p for p in plans if "next#" in p]
    assert rounds and not any("BroadcastHashJoin [component" in p for p in rounds)
