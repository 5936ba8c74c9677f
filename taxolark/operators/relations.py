"""Graphs of concepts: edges (source, target, relation, confidence) and what is computed over them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.functions import vector as vf
from taxolark.operators.stored import drop, kept, numbered, scope, stored

#: Words that name a part.
PARTS = ("part", "component", "element", "piece", "section")
#: How much a relation counts when a query is expanded, and when a search follows it.
EXPANSION = {"synonym": 1.0, "hyponym": 0.8, "hypernym": 0.8, "similar": 0.7, "meronym": 0.6, "holonym": 0.6, "related": 0.5, "association": 0.4, "antonym": 0.0}
FOLLOWED = {"synonym": 1.0, "similar": 0.9, "related": 0.8}
#: Words that place a text in a domain, in order.
DOMAINS = {
    "electronics": ("electronic", "computer", "tech"),
    "fashion": ("clothing", "apparel", "fashion"),
    "food": ("food", "beverage", "drink"),
    "home": ("home", "furniture", "decor"),
}


def weight(relation: Column, table: dict[str, float] = EXPANSION, other: float = 0.3) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), relation), F.lit(other))


def domain(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, words in DOMAINS.items():
        hit = F.rlike(low, F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def classify(source: Column, target: Column, similarity: Column) -> tuple[Column, Column]:
    """Relation and confidence of two texts; both null if they are not related."""
    s, t = F.lower(source), F.lower(target)
    inside = lambda a, b: F.exists(tf.words(b), lambda w: (F.length(w) > 3) & F.contains(a, w))
    part = lambda a: F.rlike(a, F.lit("|".join(PARTS)))
    cases = (
        ((similarity > 0.9) | (s == t), "synonym", 1.0),
        (inside(s, t), "hyponym", 0.9),
        (inside(t, s), "hypernym", 0.9),
        (part(s), "meronym", 0.8),
        (part(t), "holonym", 0.8),
        (similarity > 0.7, "similar", 1.0),
        (similarity > 0.5, "related", 0.8),
    )
    name = factor = None
    for when, relation, f in cases:
        name = F.when(when, relation) if name is None else name.when(when, relation)
        factor = F.when(when, f) if factor is None else factor.when(when, f)
    return name, similarity * factor


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at either end."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, degree_centrality, closeness): closeness in the approximation degree / nodes."""
    n = nodes.count()
    joined = nodes.select("node").join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return joined.withColumn("degree_centrality", F.round(F.col("degree") / max(1, n - 1), 6)).withColumn("closeness", F.round(F.col("degree") / max(1, n), 6))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, density."""
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(e).select(  # one row each
        "nodes", "edges", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("mean_degree"), F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2), 6).alias("density")
    )


def neighbourhood(edges: DataFrame, start, radius: int = 2, least: float = 0.3) -> DataFrame:
    """(node, hops): nodes within so many out-edges of a confidence, nearest way."""
    own = edges.where(F.col("confidence") >= least).select("source", "target").distinct()
    reached = own.sparkSession.createDataFrame([(start, 0)], f"node {own.schema['source'].dataType.simpleString()}, hops int")
    front = reached
    for i in range(1, radius + 1):
        step = front.join(own, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = step.join(reached, "node", "left_anti").withColumn("hops", F.lit(i))
        reached = reached.unionByName(front)
    return reached


def shortest_path(edges: DataFrame, start, end, hops: int = 5) -> DataFrame:
    """(path, hops, weight, score): the shortest way along out-edges; of equal ways the first by path."""
    v = f"v_{uuid.uuid4().hex}"
    edges.groupBy("source", "target").agg(F.max("confidence").alias("confidence")).createOrReplaceTempView(v)
    kind = edges.schema["source"].dataType.simpleString()
    found = edges.sparkSession.sql(
        f"""WITH RECURSIVE t(node, path, weight) MAX RECURSION LEVEL {hops + 2} AS (
              SELECT CAST(:a AS {kind}), array(CAST(:a AS {kind})), CAST(0 AS DOUBLE)
              UNION ALL
              SELECT e.target, concat(t.path, array(e.target)), t.weight + e.confidence FROM {v} e JOIN t ON e.source = t.node
              WHERE size(t.path) <= {hops} AND t.node <> :b AND NOT array_contains(t.path, e.target))
            SELECT path, size(path) - 1 AS hops, round(weight, 6) AS weight, round(weight / (size(path) - 1), 6) AS score FROM t WHERE node = :b ORDER BY hops, path LIMIT 1""",
        args={"a": start, "b": end},
    )
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, edges taken both ways; nodes without edges are their own; computes at once.

    Labels spread to neighbours and jump to their label's label until none changes, so
    the rounds grow with the logarithm of a path's length. Each round's labels are
    written, and the last but one's deleted. Edges to unknown or null nodes have no effect.
    Labels meet by shuffles, however well they compress: none goes whole to every task.
    """
    both = stored(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(edges.select("target", "source")).where("a <> b").distinct())
    label = stored(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        low = both.join(label.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        near = label.join(low, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = label.select(F.col("node").alias("at"), F.col("component").alias("next"))
        new = stored(near.join(jump.hint("merge"), F.col("component") == F.col("at")).select("node", "old", F.least("component", "next").alias("component")))
        still = new.where("old <> component").isEmpty()
        drop(label)
        label = new
        if still:
            drop(both)
            return label.select("node", "component")


def clusters(nodes: DataFrame, edges: DataFrame, least_weight: float = 0.5, least_size: int = 3, most: int = 50) -> DataFrame:
    """(component, size, cohesion): connected groups over strong edges; cohesion is mean weight times density."""
    strong = edges.where(F.col("confidence") > least_weight)
    label = components(nodes, strong)
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_size)
    inner = strong.join(label, F.col("source") == F.col("node")).groupBy("component").agg(F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("n"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    out = sizes.join(inner, "component").select("component", "size", F.round(F.col("mean") * F.least(F.lit(1.0), F.col("n") / possible), 6).alias("cohesion"))
    return out.orderBy(F.desc("size"), "component").limit(most)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds, which compute at once; ranks sum to 1, nodes without out-edges share theirs with all.

    Edges and each round's ranks are written, so that a round reads what it needs and no more.
    """
    links = stored(edges.select("source", "target"))
    n = nodes.count()
    out = links.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    rank = stored(nodes.join(out, F.col("node") == F.col("source"), "left").select("node", F.col("out"), F.lit(1.0 / max(1, n)).alias("rank")))
    for _ in range(rounds):
        given = links.join(rank.where("out is not null"), F.col("source") == F.col("node")).groupBy("target").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        idle = rank.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        joined = rank.select("node", "out").join(given, F.col("node") == F.col("target"), "left").crossJoin(F.broadcast(idle))  # idle is one row
        new = stored(joined.select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / n)).alias("rank")))
        drop(rank)
        rank = new
    drop(links)
    return rank.select("node", "rank")


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, centrality): the share of each node in the first eigenvector, edges taken both ways, after so many rounds of x + Ax, which compute at once.

    Values are scaled to a largest of 1; a node without edges has 0, and so have all if there are none.
    """
    one = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    both = stored(one.unionAll(one.select("b", "a")).distinct())
    known = both.select(F.col("a").alias("node")).distinct()
    value = stored(nodes.select("node").distinct().join(known.withColumn("linked", F.lit(1.0)), "node", "left").select("node", F.coalesce("linked", F.lit(0.0)).alias("x")))
    for _ in range(rounds):
        got = both.join(value, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("x").alias("got"))
        raw = stored(value.join(got, F.col("node") == F.col("a"), "left").select("node", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x")))
        top = raw.agg(F.max("x").alias("top"))
        new = stored(raw.crossJoin(F.broadcast(top)).select("node", F.when(F.col("top") > 0, F.col("x") / F.col("top")).otherwise(0.0).alias("x")))  # top is one row
        drop(value, raw)
        value = new
    drop(both)
    return value.select("node", F.col("x").alias("centrality"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(node, coefficient): the share of a node's pairs of neighbours that are linked, edges taken both ways.

    Edges point to the end of higher degree, so that no node has more out-edges than the
    square root of twice all edges, and a hub's neighbours are never paired.
    """
    one = stored(edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    degree = stored(one.unionAll(one.select("b", "a")).toDF("node", "next").groupBy("node").agg(F.count(F.lit(1)).alias("d")))
    da, db = degree.toDF("a", "da"), degree.toDF("b", "db")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = stored(one.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = out.join(out.withColumnRenamed("y", "z"), "x").where("y < z").select("x", F.col("y").alias("a"), F.col("z").alias("b"))  # a pair of neighbours, as edges have them
    corner = wedge.join(one, ["a", "b"]).select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    share = F.when(F.col("d") > 1, F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1) / 2)).otherwise(0.0)
    return degree.join(corner, "node", "left").select("node", F.round(share, 6).alias("coefficient"))


def expand(edges: DataFrame, seeds: Sequence, hops: int = 2, least_weight: float = 0.5, least_confidence: float = 0.6, most: int = 100) -> DataFrame:
    """(node, hops): entities reached from seeds over strong and certain relations."""
    good = edges.where((weight(F.col("relation")) > least_weight) & (F.col("confidence") > least_confidence)).select("source", "target").distinct()
    reached = good.sparkSession.createDataFrame([(s, 0) for s in seeds], f"node {good.schema['source'].dataType.simpleString()}, hops int")
    front = reached
    for i in range(1, hops + 1):
        step = front.join(good, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = step.join(reached, "node", "left_anti").withColumn("hops", F.lit(i))
        reached = reached.unionByName(front)
    return reached.orderBy("hops", "node").limit(most)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select("node").distinct()
    return edges.join(own, F.col("source") == F.col("node"), "left_semi").join(own, F.col("target") == F.col("node"), "left_semi")


def pattern(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """(n0, n1, ...): chains of edges with the given relations in order."""
    out = None
    for i, r in enumerate(relations):
        step = edges.where(F.col("relation") == r).select(F.col("source").alias(f"n{i}"), F.col("target").alias(f"n{i + 1}"))
        out = step if out is None else out.join(step, f"n{i}")
    return out


#: Rows of a block of either side, of which each pair of blocks is multiplied at once; rows of them whose products leave together; bytes of a task's blocks.
BLOCK, TILE, HELD = 2048, 256, 32_000_000


def similarity_edges(left: DataFrame, right: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """(source, target, confidence): pairs of (id, v) of two tables by cosine at least the threshold, the best few of each source if asked.

    Both sides are dealt into blocks of bounded size along a fixed axis. Two blocks meet
    only if their ranges of cosines with that axis can hold vectors of the threshold:
    the angle between two vectors is at least the difference of their angles with it.
    With a threshold of -1 or less the result is the whole product. The test is of the
    exact cosine, the confidence is rounded. Null and zero vectors are near nothing, and
    neither are vectors of unlike lengths; a row isn't paired with its own id; repeated
    rows are paired each. The blocks are written at once, a row each; tasks read a few of
    either side and multiply them pair by pair, so that vectors aren't shuffled to meet,
    and the pairs are not kept.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    a = _packed(left, cores, "x")
    b = a.withColumnRenamed("x", "y") if right is left else _packed(right, cores, "y")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    b = b.toDF("od", "olo", "ohi", "y").hint("shuffle_replicate_nl")
    met = a.join(b, (F.col("d") == F.col("od")) & (F.col("lo") - F.col("ohi") <= reach) & (F.col("olo") - F.col("hi") <= reach)).select("x", "y")
    kinds = ", ".join(f"{n} {t.schema['id'].dataType.simpleString()}" for n, t in (("source", left), ("target", right)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All products of two blocks, some rows of the one at once; of each source the best few, if no more are asked for."""
        for whole in batches:
            for r in range(whole.num_rows):
                (sources, *u), (targets, *v) = (whole.column(n).slice(r, 1).flatten().flatten() for n in ("x", "y"))
                u, v = (w.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(w), -1) / norm.to_numpy(zero_copy_only=False)[:, None] for w, norm in (u, v))
                for at in range(0, len(u), TILE):
                    cosine = u[at : at + TILE] @ v.T
                    i, j = np.nonzero(cosine >= threshold)
                    if most is not None and len(j) > most * len(cosine):
                        kth = -np.partition(-cosine, most, axis=1)[:, most] if cosine.shape[1] > most else np.full(len(cosine), -np.inf)
                        near = cosine[i, j] >= kth[i] - 1e-6  # an own id may be among them, and confidences are rounded
                        i, j = i[near], j[near]
                    found = cosine[i, j] * 1e6
                    found = np.trunc(found + np.copysign(0.5, found)) / 1e6
                    yield pa.RecordBatch.from_arrays([sources.take(pa.array(at + i)), targets.take(pa.array(j)), pa.array(found)], names=["source", "target", "confidence"])

    found = met.mapInArrow(products, f"{kinds}, confidence double").where(F.col("source") != F.col("target"))
    if most is None:
        return found
    best = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("place")


def _packed(rows: DataFrame, cores: int, name: str) -> DataFrame:
    """(d, lo, hi, ``name`` array<struct<id, v, norm>>): blocks of vectors of one length in a row each, a task's worth of them in a file.

    Vectors are written as given, once more than these blocks, and those copies go.
    """
    with scope():
        placed = _placed(rows)
        figures = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v").cast("long") * 8), F.lit(0)).alias("bytes")).first()
        size = max(1, min(BLOCK, figures["n"] // (2 * math.isqrt(cores) + 2)))  # fewer rows than BLOCK if there are so few that all cores are wanted
        parts = max(1 + figures["bytes"] // HELD, min(-(-figures["n"] // size), 2 * math.isqrt(cores) + 2))
        dealt = placed.select("id", "v", "norm", "angle", F.size("v").alias("d"), F.floor((F.col("place") - 1) / size).cast("int").alias("block"))
        blocks = dealt.repartitionByRange(parts, "block").groupBy("block", "d")
        return kept(stored(blocks.agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.collect_list(F.struct("id", "v", "norm")).alias(name)).drop("block")))


def _placed(rows: DataFrame) -> DataFrame:
    """(id, v, norm, angle, place): vectors with their norm, their angle to the axis of ones of alternating signs, and their number along it."""
    v = F.col("v").cast("array<double>")
    side = F.aggregate(F.transform(v, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    cosine = side / (norm * F.sqrt(F.size("v").cast("double")))
    usable = rows.where(F.col("id").isNotNull()).select("id", "v", norm.alias("norm"), cosine.alias("c")).where("norm > 0")
    angled = usable.select("id", "v", "norm", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c")))).alias("angle"))
    return numbered(angled, [F.col("angle"), F.col("id"), F.xxhash64("v")])  # as repeated ids may have unlike vectors
