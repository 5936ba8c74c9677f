"""Leader clustering: items in order, each joins the first leader near enough or leads a new cluster.

The result depends on the order. Only pairs near enough to matter enter the walk. Which
items lead is settled in rounds: an item leads if no earlier near item can, and follows
as soon as one leads. A round settles nearly all; what is left are chains of near items.
Each group of those that hang together is cut by rank into stretches of a bounded number
of pairs, and walked stretch by stretch, all groups at once and each in one task: leaders
of earlier stretches have had their effect before a stretch is walked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.operators.relations import components
from taxolark.operators.stored import running, stored

#: Rounds before groups are walked, and pairs of a stretch that a task walks.
ROUNDS, WALK = 2, 500_000


def _walk(pairs: pd.DataFrame) -> pd.DataFrame:
    """Which items of a group lead; ``pairs`` (before, node, rank_before, rank_node) hold all of the group's."""
    earlier: dict = {}
    rank = dict(zip(pairs["before"], pairs["rank_before"], strict=True)) | dict(zip(pairs["node"], pairs["rank_node"], strict=True))
    for a, b in zip(pairs["before"], pairs["node"], strict=True):
        earlier.setdefault(b, []).append(a)
    leads: dict = {}
    for n in sorted(rank, key=rank.__getitem__):
        leads[n] = not any(leads[a] for a in earlier.get(n, ()))
    return pd.DataFrame({"node": list(leads), "leads": list(leads.values())})


def settle(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, leads) of items (id, rank): ``pairs`` (a, b) with a ranked before b are the items near enough; computes at once.

    Every item is settled, however long chains are. Ranks are distinct; nodes and pairs
    without rows are settled likewise; a pair with an unknown or null item has no effect.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    open_ = stored(nodes.select(F.col("id").alias("node"), F.col("rank").cast("double").alias("rank")))
    known = open_.select(F.col("node").alias("before"))
    earlier = stored(pairs.select(F.col("a").alias("before"), F.col("b").alias("node")).distinct().join(known, "before", "left_semi"))
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        waiting = earlier.join(open_.select("node"), "node", "left_semi")
        known = done[-1] if done else None
        for more in done[:-1]:
            known = known.unionAll(more)
        state = waiting.withColumn("leads", F.lit(None).cast("boolean")) if known is None else waiting.join(known.withColumnRenamed("node", "before"), "before", "left")
        per = state.groupBy("node").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_or(F.col("leads").isNull()).alias("waits"))
        now = open_.join(per, "node", "left").select("node", "rank", F.when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True).alias("leads"))
        now = stored(now)
        done.append(now.where("leads is not null").select("node", "leads"))
        open_ = now.where("leads is null").select("node", "rank")
    if not open_.isEmpty():
        done += _walked(open_, earlier, kind)
        open_ = open_.limit(0)
    out = open_.select("node", F.lit(None).cast("boolean").alias("leads"))
    for d in done:
        out = out.unionAll(d)
    return out


def _walked(open_: DataFrame, earlier: DataFrame, kind: str) -> list[DataFrame]:
    """(node, leads) of all open items (node, rank), which wait for each other only, in parts."""
    inner = stored(earlier.join(open_.withColumnRenamed("rank", "rank_node"), "node").join(open_.select(F.col("node").alias("before"), F.col("rank").alias("rank_before")), "before"))
    label = components(open_.select("node"), inner.select(F.col("before").alias("source"), F.col("node").alias("target")))
    counts = inner.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    items = open_.join(label, "node").join(counts, "node", "left").select("node", "rank", "component", F.coalesce("n", F.lit(0)).alias("n"))
    placed = running(items, "component", [F.col("rank")], F.col("n"))
    placed = stored(placed.select("node", "component", F.floor((F.col("upto") - F.col("n")) / WALK).cast("int").alias("stretch")))
    last = placed.agg(F.max("stretch")).first()[0]
    out: list[DataFrame] = []
    for i in range(last + 1):
        own = placed.where(F.col("stretch") == i)
        if out:  # leaders of earlier stretches
            heads = out[0].where("leads").select(F.col("node").alias("before"))
            for known in out[1:]:
                heads = heads.unionAll(known.where("leads").select("node"))
            led = inner.join(own, "node").join(heads, "before", "left_semi").select("node").distinct()
            own = own.join(led, "node", "left_anti")
        own = stored(own)
        free = inner.join(own.select("node", "component"), "node").join(own.select(F.col("node").alias("before")), "before", "left_semi")
        walked = free.groupBy("component").applyInPandas(_walk, f"node {kind}, leads boolean")
        settled = own.join(walked, "node", "left").select("node", F.coalesce("leads", F.lit(True)).alias("leads"))
        led = placed.where(F.col("stretch") == i).join(own, "node", "left_anti").select("node", F.lit(False).alias("leads"))
        out.append(stored(settled.unionAll(led)))
    return out


def leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader) of items (id), in order of id: ``pairs`` (a, b, ...) with a before b are the items near enough; a leader leads itself; computes at once.

    An item follows its first leader by id. No rows give no rows.
    """
    found = settle(nodes.select("id", F.col("id").alias("rank")).distinct(), pairs)
    lead = found.where("leads").select(F.col("node").alias("l"))
    follows = pairs.select(F.col("a").alias("before"), F.col("b").alias("node")).join(lead, F.col("before") == F.col("l")).groupBy("node").agg(F.min("before").alias("leader"))
    return nodes.select("id").join(lead, F.col("id") == F.col("l"), "left").join(follows, F.col("id") == F.col("node"), "left").select("id", F.when(F.col("l").isNotNull(), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def clusters(members: DataFrame, least: int) -> DataFrame:
    """(leader, size) of clusters that are large enough; members of smaller ones stay used up."""
    return members.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)


def concepts(entities: DataFrame, pairs: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """(leader, size, confidence, kind): concept clusters of entities (id, kind); the kind is the most frequent, ties by name."""
    members = leaders(entities.select("id"), pairs).join(entities, "id")
    kinds = members.groupBy("leader", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = kinds.groupBy("leader").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"), F.sum("n").alias("size"))
    found = top.where(F.col("size") >= least)
    return found.select("leader", "size", F.round(F.least(F.lit(1.0), F.col("size") / 10), 6).alias("confidence"), F.concat("kind", F.lit("_group")).alias("kind")).orderBy("leader").limit(most)
