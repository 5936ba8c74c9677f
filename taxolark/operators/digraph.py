"""Directed graphs: who reaches whom, clusters that follow directions, strongly connected components, betweenness and closeness.

Edges are (source, target); where a table has a column ``bidirectional``, a true one
counts both ways. Null ends and loops have no effect, and neither have edges whose ends
are not among the nodes. All functions compute at once, in rounds over written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.operators.stored import drop, stored


def arcs(edges: DataFrame) -> DataFrame:
    """(source, target): distinct, without loops and null ends; bidirectional edges both ways."""
    one = edges.select("source", "target")
    if "bidirectional" in edges.columns:
        one = one.unionAll(edges.where("bidirectional").select(F.col("target"), F.col("source")))
    return one.where("source <> target").distinct()


def first_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which a node can be reached along the edges, itself included.

    Labels go one edge on in a round, and each takes its label's label as well: what
    reaches a node that reaches this one reaches this one. A round looks only at
    edges from nodes whose label has just changed.
    """
    own = nodes.select("node").where("node is not null").distinct()
    label = stored(own.select("node", F.col("node").alias("label"), F.lit(True).alias("moved")))
    links = stored(arcs(edges).join(own.withColumnRenamed("node", "target"), "target", "left_semi").join(own.withColumnRenamed("node", "source"), "source", "left_semi"))
    while not label.where("moved").isEmpty():
        sent = links.join(label.where("moved").select(F.col("node").alias("source"), "label"), "source").groupBy("target").agg(F.min("label").alias("low"))
        jump = label.select(F.col("node").alias("at"), F.col("label").alias("further"))
        joined = label.join(sent, F.col("node") == F.col("target"), "left").join(jump, F.col("label") == F.col("at"))
        low = F.least("label", "low", "further")
        new = stored(joined.select("node", low.alias("label"), (low < F.col("label")).alias("moved")))
        drop(label)
        label = new
    drop(links)
    return label.select("node", "label")


def clusters(nodes: DataFrame, edges: DataFrame, least_weight: float = 0.5) -> DataFrame:
    """(node, cluster): nodes in order take with them all that they reach over edges heavier than the weight and that no earlier one has.

    So a node's cluster is the first node that reaches it. Edges have a ``confidence``.
    """
    return first_reaching(nodes, edges.where(F.col("confidence") > least_weight)).withColumnRenamed("label", "cluster")


def cluster_figures(members: DataFrame, edges: DataFrame, least_weight: float = 0.5, least_size: int = 3, most: int = 50) -> DataFrame:
    """(cluster, size, cohesion) of clusters (node, cluster) of a size, largest first.

    The cohesion is the mean weight of the strong edges inside times their share of all
    possible ones, taken without direction.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_size)
    strong = edges.where(F.col("confidence") > least_weight)
    a, b = members.toDF("source", "cluster"), members.toDF("target", "other")
    inner = strong.join(a, "source").join(b, "target").where("cluster = other").groupBy("cluster").agg(F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("n"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    cohesion = F.coalesce(F.col("mean") * F.least(F.lit(1.0), F.col("n") / possible), F.lit(0.0))
    return sizes.join(inner, "cluster", "left").select("cluster", "size", F.round(cohesion, 6).alias("cohesion")).orderBy(F.desc("size"), "cluster").limit(most)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a node reaches and that reaches it.

    Nodes without an edge in or without one out are components of their own and are
    trimmed, again and again. Of the rest every node takes the first node that reaches
    it; the roots of these labels walk back along edges inside their label, and whom
    they meet is their component. What is left starts anew, without edges between labels.
    """
    rest = stored(nodes.select("node").where("node is not null").distinct())
    links = stored(arcs(edges).join(rest.withColumnRenamed("node", "target"), "target", "left_semi").join(rest.withColumnRenamed("node", "source"), "source", "left_semi"))
    done: list[DataFrame] = []
    while not rest.isEmpty():
        inner = rest.join(links.select(F.col("source").alias("node")).distinct(), "node", "left_semi").join(links.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
        inner = stored(inner)
        single = stored(rest.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")))
        done.append(single)
        if not single.isEmpty():
            rest, links = inner, _among(links, inner)
            continue
        label = stored(first_reaching(inner, links))
        a, b = label.toDF("source", "la"), label.toDF("target", "lb")
        links = stored(links.join(a, "source").join(b, "target").where("la = lb").select("source", "target"))
        # backwards from the roots, within a label: its root is its smallest node
        back = first_reaching(inner, links.select(F.col("target").alias("source"), F.col("source").alias("target")))
        met = stored(label.join(back.withColumnRenamed("label", "back"), "node").where("label = back").select("node", F.col("label").alias("component")))
        done.append(met)
        rest = stored(inner.join(met, "node", "left_anti"))
        links = _among(links, rest)
    out = rest.select("node", F.col("node").alias("component"))
    for d in done:
        out = out.unionAll(d)
    return out


def _among(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return stored(links.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi"))


def pivots(nodes: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(node): so many nodes drawn by a seeded hash, the same in every run; all if they are fewer."""
    return nodes.select("node").where("node is not null").distinct().orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(count)


def ways(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hops, ways): of every node that a start reaches the fewest edges and how many shortest ways there are.

    All starts go on together, an edge a round. Ways are doubles, as their number can be huge.
    """
    own = nodes.select("node").where("node is not null").distinct()
    links = stored(arcs(edges).join(own.withColumnRenamed("node", "target"), "target", "left_semi").join(own.withColumnRenamed("node", "source"), "source", "left_semi"))
    front = stored(starts.select(F.col("node").alias("start"), "node").join(own, "node", "left_semi").select("start", "node", F.lit(0).alias("hops"), F.lit(1.0).alias("ways")))
    met = front
    while not front.isEmpty():
        step = front.join(links, F.col("node") == F.col("source")).groupBy("start", F.col("target").alias("node")).agg((F.max("hops") + 1).alias("hops"), F.sum("ways").alias("ways"))
        front = stored(step.join(met.select("start", "node"), ["start", "node"], "left_anti"))
        met = met.unionAll(front)
    return met


def centrality(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(node, betweenness, closeness): exact with all nodes as starts, else estimated from these.

    Betweenness: over ordered pairs of other nodes the share of shortest ways through
    the node, divided by their number (n - 1)(n - 2). Closeness: the share of nodes that
    reach the node, times the nodes that do by the sum of their distances. From fewer
    starts, drawn by ``pivots``, both are scaled by nodes / starts. The shares are added
    up backwards, from the farthest nodes to the starts, for all starts at once.
    """
    own = nodes.select("node").where("node is not null").distinct()
    starts = stored((own if starts is None else starts.select("node").join(own, "node", "left_semi")).distinct())
    n, p = own.count(), max(1, starts.count())
    found = stored(ways(nodes, edges, starts))
    links = stored(arcs(edges))
    deepest = found.agg(F.max("hops")).first()[0] or 0
    given = stored(found.where(F.lit(False)).select("start", "node", F.lit(0.0).alias("share")))
    shares = []
    for hops in range(deepest, 0, -1):
        below = found.where(F.col("hops") == hops).join(given, ["start", "node"], "left").select("start", F.col("node").alias("target"), F.coalesce("share", F.lit(0.0)).alias("share"), F.col("ways").alias("w"))
        shares.append(below := stored(below))
        above = found.where(F.col("hops") == hops - 1).select("start", F.col("node").alias("source"), "ways")
        part = links.join(below, "target").join(above, ["start", "source"])
        given = stored(part.groupBy("start", F.col("source").alias("node")).agg(F.sum(F.col("ways") / F.col("w") * (1 + F.col("share"))).alias("share")))
    total = own.select("node", F.lit(0.0).alias("share"))
    for s in shares:
        total = total.unionAll(s.select(F.col("target").alias("node"), "share"))
    between = total.groupBy("node").agg((F.sum("share") * (n / p) / max(1, (n - 1) * (n - 2))).alias("betweenness"))
    near = found.where("hops > 0").groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.sum("hops").alias("far"))
    reach = F.col("met") * (n / p)
    close = near.select("node", (reach / max(1, n - 1) * (F.col("met") / F.col("far"))).alias("closeness"))
    return between.join(close, "node", "left").select("node", "betweenness", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))
