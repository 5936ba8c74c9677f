"""Connected components by contraction, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.llm.tables import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """``edges`` (a long, b long) to (node, component): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to
    their roots by doubling, and replaces both ends of each edge by their roots.
    The largest node of a component always loses its label, and usually most do,
    so the edges shrink quickly; the rounds' pointers are then followed in order.
    Aggregates combine before they shuffle and all joins are plain equi-joins, which
    adaptive execution can split, so a hub needs no task of its own. Nodes without
    edges are not returned; null ends and loops are ignored; no edges give no rows.
    """
    live = shelf.put(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(live.select("b", "a"))
        low = ends.groupBy("node").agg(F.min("other").alias("other"))
        up = shelf.put(low.select("node", F.least("node", "other").alias("root")))
        while True:
            jump = up.select(F.col("node").alias("at"), F.col("root").alias("next"))
            moved = shelf.put(up.join(jump, up["root"] == jump["at"]).select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            still = moved.where("moved").isEmpty()
            shelf.drop(up)
            up = moved
            if still:
                break
        maps.append(up)
        left = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rooted = live.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        after = shelf.put(rooted.where("a < b").distinct())
        shelf.drop(live)
        live = after
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("root").alias("component"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("component"), "root")
        out = out.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return out
