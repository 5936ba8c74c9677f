"""Semantic candidates, enrichment and the search strategies built from vectors and relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.functions import vector as vf
from taxolark.operators import relations
from taxolark.operators.stored import stored


def candidate_text(term: Column, normalized: Column, contexts: Column) -> Column:
    """What is embedded of a candidate: term, normalized term if it differs, three contexts at most."""
    other = F.when(normalized != term, normalized)
    return tf.clean_for_embedding(F.concat_ws(" | ", term, other, F.slice(contexts, 1, 3)))


def result_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """'key: value' of each column that isn't blank."""
    return F.concat_ws(" ", *[F.when(F.trim(df[c]) != "", F.concat(F.lit(f"{c}: "), df[c])) for c in columns])


def search_candidates(candidates: DataFrame, query: str, domain: str | None = None, limit: int = 50) -> DataFrame:
    """Candidates (term, normalized_term, domain, score, frequency) that contain the query, of one domain if asked."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("term"), q) | F.contains(F.lower("normalized_term"), q)
    found = candidates.where(hit if domain is None else hit & (F.col("domain") == domain))
    return found.orderBy(F.desc("score"), F.desc("frequency"), "term").limit(limit)


#: Terms of either side of a relation whose links a task forms.
TERMS = 512


def link_by_term(candidates: DataFrame, pairs: DataFrame, key: str = "term_id") -> DataFrame:
    """(source, target, relation, strength): relations between terms (from_term, to_term, relation, strength) as edges of known ones.

    All candidates of the one name are linked to all of the other, so a relation's links
    may be very many: its candidates are dealt into buckets, and each pair of buckets is
    linked in a task. The candidates that relations name are written at once.
    """
    known = candidates.select(F.lower("normalized_term").alias("n"), F.col(key).alias("k"))
    asked = pairs.select(F.lower("from_term").alias("na"), F.lower("to_term").alias("nb"), "relation", "strength")
    own = stored(known.join(asked.select(F.col("na").alias("n")).unionAll(asked.select("nb")).distinct(), "n", "left_semi"))
    sizes = own.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / TERMS).cast("long").alias("of"))
    asked = asked.join(sizes.toDF("na", "la"), "na").join(sizes.toDF("nb", "lb"), "nb")
    asked = stored(asked.withColumn("pair", F.monotonically_increasing_id()))
    parts = max(1, min(asked.agg(F.sum(F.col("la") * F.col("lb"))).first()[0] or 0, 10_000))
    own = own.withColumn("h", F.xxhash64("k"))
    a = own.join(asked.select("pair", F.col("na").alias("n"), "la", "lb"), "n").select("pair", F.col("k").alias("source"), F.pmod("h", F.col("la")).alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lb") - 1)).alias("w"))
    b = own.join(asked.select("pair", F.col("nb").alias("n"), "la", "lb", "relation", "strength"), "n")
    b = b.select("pair", F.col("k").alias("target"), "relation", "strength", F.explode(F.sequence(F.lit(0).cast("long"), F.col("la") - 1)).alias("u"), F.pmod("h", F.col("lb")).alias("w"))
    met = a.repartition(parts, "pair", "u", "w").join(b.repartition(parts, "pair", "u", "w"), ["pair", "u", "w"])
    return met.where("source <> target").select("source", "target", "relation", "strength")


def attributes_of(categories: DataFrame, attributes: DataFrame, values: DataFrame) -> DataFrame:
    """(category_id, attribute, values): attributes (category_id, attribute) with their sorted values (attribute, value), if any."""
    joined = categories.select("category_id").join(attributes, "category_id").join(values, "attribute", "left")
    return joined.groupBy("category_id", "attribute").agg(F.array_sort(F.collect_set("value")).alias("values"))


def discover(entities: DataFrame, known: DataFrame, near: DataFrame, least: float = 0.3, limit: int = 20) -> DataFrame:
    """(source, target, relation, confidence) per entity (id, text): known relations, and those that near pairs (source, target, similarity) show."""
    s, t = entities.toDF("source", "s_text"), entities.toDF("target", "t_text")
    pairs = near.where(F.col("similarity") > least).join(s, "source").join(t, "target")
    relation, confidence = relations.classify(F.col("s_text"), F.col("t_text"), F.col("similarity"))
    new = pairs.select("source", "target", relation.alias("relation"), F.round(confidence, 6).alias("confidence")).where("relation is not null")
    new = new.join(known.select("source", "target"), ["source", "target"], "left_anti")
    both = known.select("source", "target", "relation", "confidence").unionByName(new)
    best = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    return both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).drop("place")


def data_quality(entities: DataFrame, embeddings: DataFrame, known: DataFrame) -> DataFrame:
    """One row over entities (id): total, with_embedding, with_relations, mean_relations, mean_confidence."""
    e = embeddings.select(F.col("entity_id").alias("e")).distinct()
    r = known.groupBy(F.col("source").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    joined = entities.select("id").join(e, F.col("id") == F.col("e"), "left").join(r, F.col("id") == F.col("r"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("e").alias("with_embedding"),
        F.count("r").alias("with_relations"),
        F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.count(F.lit(1)), 6).alias("mean_relations"),
        F.round(F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)), 6).alias("mean_confidence"),
    )


def embedding_stats(embeddings: DataFrame) -> DataFrame:
    return embeddings.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


def graph_search(near: DataFrame, edges: DataFrame, seeds: int = 10, hops: int = 2, most: int = 100) -> DataFrame:
    """(id, hops, score): what the best results (id, score) lead to over strong and certain relations, all scored .5."""
    top = [r["id"] for r in near.orderBy(F.desc("score"), "id").limit(seeds).collect()]  # ten at most
    return relations.expand(edges, top, hops, most=most).select(F.col("node").alias("id"), "hops", F.lit(0.5).alias("score"))


def expanded_query(query: str, near: DataFrame, above: float = 0.7, most: int = 5) -> DataFrame:
    """(query): the query and the texts (text, score) most like it that it doesn't hold yet."""
    more = near.where((F.col("score") > above) & ~F.contains(F.lit(query.lower()), F.lower("text"))).orderBy(F.desc("score"), "text").limit(most)
    listed = more.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("text").alias("t")))).alias("all"))
    return listed.select(F.concat_ws(" ", F.lit(query), F.transform("all", lambda x: x["t"])).alias("query"))


def multi_modal(parts: Sequence[tuple[DataFrame, float]], limit: int = 100) -> DataFrame:
    """(id, score): results of several models, each (id, score) with a weight, taken relative to their sum."""
    whole, out = float(sum(w for _, w in parts)), None
    for df, w in parts:
        one = df.select("id", (F.col("score") * (w / whole)).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def domain_relevance(text: Column, domains: Sequence[str]) -> Column:
    """The share of domain words that a text holds."""
    if not domains:
        return F.lit(0.0)
    low = F.lower(text)
    return sum((F.contains(low, F.lit(d.lower())).cast("double") for d in domains), F.lit(0.0)) / len(domains)


def with_feedback(results: DataFrame, feedback: DataFrame, weight: float = 0.1) -> DataFrame:
    """Results (id, score) with the mean of their feedback (id, rating from -1 to 1) added by weight."""
    mean = feedback.groupBy("id").agg(F.avg("rating").alias("rating"))
    return results.join(mean, "id", "left").withColumn("score", F.round(F.col("score") + weight * F.coalesce("rating", F.lit(0.0)), 6)).drop("rating")


def enhance(products: DataFrame, near: DataFrame, categories: DataFrame, each: int = 5) -> DataFrame:
    """Products (id) with their nearest products and categories as arrays; both tables (source, target, confidence)."""
    best = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")

    def listed(df: DataFrame, name: str) -> DataFrame:
        top = df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= each)
        return top.groupBy(F.col("source").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias(name))

    return products.join(listed(near, "similar"), "id", "left").join(listed(categories, "categories"), "id", "left")


def suggestions(entities: DataFrame, partial: str, text: str, limit: int = 10) -> DataFrame:
    """(text): names that begin with the partial text, then those that contain it."""
    low, q = F.lower(text), F.lit(partial.lower())
    found = entities.where(F.contains(low, q)).groupBy(F.col(text).alias("text")).agg(F.min(F.when(F.startswith(low, q), 0).otherwise(1)).alias("rank"))
    return found.orderBy("rank", "text").limit(limit).select("text")


def tasks_due(tasks: DataFrame, limit: int = 100, tries: int = 3) -> DataFrame:
    """Tasks (status, attempts, priority, created_at, task_id) to run next: pending, or failed and not tried too often."""
    due = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < tries))
    return tasks.where(due).orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def vector_search(table: DataFrame, query: Sequence[float], measure: str = "cosine", vector: str = "embedding", key: str = "vec_id", limit: int = 10, threshold: float | None = None) -> DataFrame:
    """(key, score) nearest first, by any of the four measures."""
    score = F.round(vf.MEASURES[measure](F.col(vector), vf.literal(query)), 6)
    out = table.select(key, score.alias("score"))
    near = measure in vf.DISTANCES
    if threshold is not None:
        out = out.where(F.col("score") <= threshold if near else F.col("score") >= threshold)
    return out.orderBy(F.asc("score") if near else F.desc("score"), key).limit(limit)


