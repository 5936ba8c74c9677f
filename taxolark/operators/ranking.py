"""Ranking of search results, recommendations, and measures of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf

#: Weights of similarity, popularity, freshness, confidence and domain, and whether the boost is added.
STRATEGIES = {
    "similarity": ((1.0, 0.0, 0.0, 0.0, 0.0), False),
    "popularity": ((0.7, 0.3, 0.0, 0.0, 0.0), True),
    "freshness": ((0.6, 0.0, 0.3, 0.0, 0.1), False),
    "confidence": ((0.5, 0.1, 0.0, 0.3, 0.1), True),
    "balanced": ((0.4, 0.2, 0.1, 0.2, 0.1), True),
}


def final_score(strategy: str, similarity: Column, relations: Column, confidence: Column, domain: Column, boost: Column) -> Column:
    """Popularity is relations / 10, at most 1; freshness counts half; the boost is a fifth of a relation's weight."""
    (a, b, c, d, e), boosted = STRATEGIES[strategy]
    score = a * similarity + b * F.least(F.lit(1.0), relations / 10) + c * F.lit(0.5) + d * confidence + e * domain
    return score + 0.2 * boost if boosted else score


def rank(results: DataFrame, relations: DataFrame, strategy: str) -> DataFrame:
    """Results (id, similarity, confidence, domain, boost) with ``score``; ``relations`` (source, ...) give popularity."""
    n = relations.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("relations"))
    joined = results.join(n, "id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    score = final_score(strategy, F.col("similarity"), F.col("relations"), F.col("confidence"), F.col("domain"), F.col("boost"))
    return joined.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id")


def hybrid(near: DataFrame, edges: DataFrame, weights: Column, threshold: float = 0.5, seeds: int = 10) -> DataFrame:
    """(id, score, way): near results (id, score), and those that the best few lead to over certain edges; near ones first."""
    top = F.broadcast(near.orderBy(F.desc("score"), "id").limit(seeds))
    led = top.join(edges.where("confidence > 0.5"), F.col("id") == F.col("source")).select(F.col("target").alias("id"), (F.col("score") * weights * F.col("confidence")).alias("score")).where(F.col("score") > threshold)
    both = near.select("id", "score", F.lit(0).alias("way")).unionByName(led.select("id", "score", F.lit(1).alias("way")))
    first = Window.partitionBy("id").orderBy("way", F.desc("score"))
    return both.withColumn("place", F.row_number().over(first)).where("place = 1").select("id", F.round("score", 6).alias("score"), "way")


def playbook(results: DataFrame) -> DataFrame:
    """Results (id, match, evidence, last_seen): exact before alias before candidate, then evidence, then how lately seen."""
    place = F.when(F.col("match") == "exact", 0).when(F.col("match") == "alias", 1).otherwise(2)
    return results.withColumn("match_rank", place).orderBy("match_rank", F.desc("evidence"), F.desc("last_seen"), "id")


def recommend(interactions: DataFrame, near: DataFrame, recent: int = 10, each: int = 5, least: float = 0.6, most: int = 10) -> DataFrame:
    """(user, id, score, place): neighbours of a user's last interactions that they haven't met.

    ``interactions`` (user, id, at), ``near`` (source, target, confidence). What an
    earlier interaction brings comes first, and stays with the score it came with.
    """
    last = Window.partitionBy("user").orderBy(F.desc("at"), "id")
    seeds = interactions.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= recent).select("user", F.col("id").alias("source"), "nth")
    best = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    close = near.where(F.col("confidence") >= least).withColumn("k", F.row_number().over(best)).where(F.col("k") <= each)
    offers = seeds.join(close, "source").select("user", F.col("target").alias("id"), F.col("confidence").alias("score"), "nth", "k")
    fresh = offers.join(interactions.select("user", "id").distinct(), ["user", "id"], "left_anti")
    first = Window.partitionBy("user", "id").orderBy("nth", "k")
    once = fresh.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    order = Window.partitionBy("user").orderBy("nth", "k", "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("user", "id", "score", "place")


def diversify(results: DataFrame, text: str = "text", near: float = 0.8, drop: float = 0.9, cost: float = 0.3) -> DataFrame:
    """Results (id, text, score), best first: one too like a better one that stays is left out, one like such loses score.

    Results are held in order of score, then id, against those before them that stay:
    word Jaccard above ``drop`` leaves a result out, above ``near`` it costs that share
    of the score for each. Of equal sets of words only the first can stay. All results
    are read; only pairs of texts that share rare words are compared. Texts without
    words, null ones too, are like no other. No rows give no rows.
    """
    from taxolark.operators import greedy
    from taxolark.operators.stored import numbered, stored

    words = F.array_sort(F.array_distinct(tf.words(F.lower(F.coalesce(F.col(text), F.lit(""))))))
    own = results.select("id", F.col(text).alias("text"), "score", words.alias("words"))
    first = own.groupBy("words", F.when(F.size("words") == 0, F.col("id")).alias("alone")).agg(F.min_by(F.struct("id", "text", "score"), F.struct(-F.col("score"), F.col("id"))).alias("r")).select("words", "r.*")
    ranked = stored(numbered(first, [F.desc("score"), F.col("id")], "rank"))
    pairs = stored(_alike(ranked, near))
    stays = greedy.settle(ranked.select(F.col("rank").alias("id"), "rank"), pairs.where(F.col("sim") > drop)).where("leads").select(F.col("node").alias("rank"))
    kept = ranked.join(stays, "rank", "left_semi")
    worse = pairs.join(stays.withColumnRenamed("rank", "a"), "a").groupBy(F.col("b").alias("rank")).agg(F.product(1 - cost * F.col("sim")).alias("factor"))
    return kept.join(worse, "rank", "left").select("id", "text", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6).alias("score")).orderBy(F.desc("score"), "id")


def _alike(ranked: DataFrame, near: float) -> DataFrame:
    """(a, b, sim): ranks a < b of word sets (rank, words) with Jaccard above ``near``, looked up by the rarest words only."""
    word = ranked.select("rank", F.size("words").alias("size"), F.explode("words").alias("w"))
    spread = word.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("rank").orderBy("df", "w")
    prefix = word.join(spread, "w").withColumn("nth", F.row_number().over(rare)).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * near) + 1)
    x, y = prefix.select("w", F.col("rank").alias("a"), F.col("size").alias("sa")), prefix.select("w", F.col("rank").alias("b"), F.col("size").alias("sb"))
    met = x.join(y, "w").where((F.col("a") < F.col("b")) & (F.least("sa", "sb") > F.greatest("sa", "sb") * near)).select("a", "b").distinct()
    both = met.join(ranked.select(F.col("rank").alias("a"), F.col("words").alias("wa")), "a").join(ranked.select(F.col("rank").alias("b"), F.col("words").alias("wb")), "b")
    sim = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return both.select("a", "b", sim.alias("sim")).where(F.col("sim") > near)


# --- measures of ranked lists: (query, place, relevant) ------------------------------------


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("place") <= k).groupBy("query").agg(F.round(F.sum(F.col("relevant").cast("double")) / k, 6).alias("precision"))


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``relevant``: (query, n), the number of relevant items there are."""
    hit = ranked.where(F.col("place") <= k).groupBy("query").agg(F.sum(F.col("relevant").cast("double")).alias("hits"))
    return relevant.join(hit, "query", "left").select("query", F.round(F.coalesce("hits", F.lit(0.0)) / F.col("n"), 6).alias("recall"))


def mrr(ranked: DataFrame) -> DataFrame:
    """One row: the mean of 1 / place of the first relevant result, 0 where there is none."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant") == 1, F.col("place"))).alias("first"))
    return first.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """(query, ndcg) of the first k places; 0 without relevant results."""
    top = ranked.where(F.col("place") <= k)
    ideal = Window.partitionBy("query").orderBy(F.desc("relevant"), "place")
    gain = top.withColumn("best", F.row_number().over(ideal))
    summed = gain.groupBy("query").agg(F.sum(F.col("relevant") / F.log2(F.col("place") + 1)).alias("dcg"), F.sum(F.col("relevant") / F.log2(F.col("best") + 1)).alias("idcg"))
    return summed.select("query", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))
