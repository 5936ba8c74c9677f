"""Spanning forests: the few pairs that tell how nodes hang together at every level of similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.operators.relations import components
from taxolark.operators.stored import drop, stored


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(a, b, score): a maximum spanning forest of pairs (a, b, score); computes at once.

    In a round every component takes its best pair to another one, of equally good ones
    the first by (a, b), and components joined by a pair become one: their number at
    least halves. Pairs count without direction and of several the best; null ends, null
    scores and loops have no effect. The order of pairs has no ties, so there is one result.
    """
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a <> b and score is not null")
    # ca and cb: the components of both ends
    live = stored(one.groupBy("a", "b").agg(F.max("score").alias("score")).withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    taken: list[DataFrame] = []
    while not live.isEmpty():
        rank = F.struct(-F.col("score"), "a", "b")
        sides = live.select(F.col("ca").alias("c"), "ca", "cb", "a", "b", "score").unionAll(live.select(F.col("cb").alias("c"), "ca", "cb", "a", "b", "score"))
        best = sides.groupBy("c").agg(F.min_by(F.struct("a", "b", "score", "ca", "cb"), rank).alias("e")).select("e.*").distinct()
        best = stored(best)
        taken.append(best)
        ends = best.select(F.col("ca").alias("node")).unionAll(best.select(F.col("cb").alias("node"))).distinct()
        root = stored(components(ends, best.select(F.col("ca").alias("source"), F.col("cb").alias("target"))))
        left, right = root.toDF("ca", "ra"), root.toDF("cb", "rb")
        # every component of a live pair has taken one, so all are known
        after = stored(live.join(left, "ca").join(right, "cb").where("ra <> rb").select("a", "b", "score", F.col("ra").alias("ca"), F.col("rb").alias("cb")))
        drop(live, root)
        live = after
    out = live.select("a", "b", "score")
    for t in taken:
        out = out.unionAll(t.select("a", "b", "score"))
    return out


def merges(forest: DataFrame) -> DataFrame:
    """(step, a, b, height) of a forest's pairs: the dendrogram of single linkage, the highest similarity first, ties by pair."""
    from taxolark.operators.stored import numbered

    return numbered(forest, [F.desc("score"), F.asc("a"), F.asc("b")], "step").select("step", "a", "b", F.col("score").alias("height"))


def cut(nodes: DataFrame, forest: DataFrame, level: float) -> DataFrame:
    """(node, cluster): clusters by single linkage of pairs at least the level, named by their smallest node; computes at once.

    Only the forest is read: two nodes are linked by pairs of a level if and only if they
    are by the forest's pairs of that level. Nodes without pairs are their own clusters.
    """
    own = forest.where(F.col("score") >= level).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return components(nodes.select("node").distinct(), own).withColumnRenamed("component", "cluster")
