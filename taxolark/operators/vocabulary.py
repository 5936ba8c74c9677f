"""Controlled vocabularies: (term_id, term, vocabulary_type, category_id, parent_term_id, aliases, usage_count, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.operators.editjoin import near_texts
from taxolark.operators.stored import stored

#: Least score that counts as valid, by strictness; a permissive check takes any value.
LEVELS = {"strict": 0.6, "moderate": 0.6, "flexible": 0.4, "permissive": 0.0}


def matches(values: DataFrame, terms: DataFrame, fuzzy: float = 0.8) -> DataFrame:
    """(value, term_id, score, kind): the best match of each distinct value.

    Equal after normalizing 1, an alias .95, else Levenshtein similarity from ``fuzzy`` on,
    which lies above 0; candidates come from a join by edits, which computes at once.
    Ties go to the earlier kind and the smaller term_id.
    """
    own = values.select(F.col("value")).where("value is not null").distinct().withColumn("norm", tf.normalize_term(F.col("value")))
    known = terms.select("term_id", tf.normalize_term(F.col("term")).alias("name"))
    alias = terms.select("term_id", F.explode("aliases").alias("a")).select("term_id", tf.normalize_term(F.col("a")).alias("name")).distinct() if "aliases" in terms.columns else None
    exact = own.join(known, F.col("norm") == F.col("name")).select("value", "term_id", F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    parts = exact
    if alias is not None:
        parts = parts.unionByName(own.join(alias, F.col("norm") == F.col("name")).select("value", "term_id", F.lit(0.95).alias("score"), F.lit(1).alias("rank")))
    rest = own.join(exact.select("value").distinct(), "value", "left_anti")
    close = near_texts(rest.select(F.col("norm").alias("text")), known.select(F.col("name").alias("text")), fuzzy)
    near = rest.join(close, F.col("norm") == F.col("x")).join(known, F.col("y") == F.col("name"))
    parts = parts.unionByName(near.select("value", "term_id", "score", F.lit(2).alias("rank")))
    best = Window.partitionBy("value").orderBy(F.desc("score"), "rank", "term_id")
    kind = F.element_at(F.array(F.lit("exact"), F.lit("alias"), F.lit("fuzzy")), F.col("rank") + 1)
    return parts.withColumn("place", F.row_number().over(best)).where("place = 1").select("value", "term_id", F.round("score", 6).alias("score"), kind.alias("kind"))


def validate(values: DataFrame, terms: DataFrame, level: str = "moderate") -> DataFrame:
    """(value, valid, term_id, score, confidence, warning) of each distinct value."""
    found = values.select("value").where("value is not null").distinct().join(matches(values, terms, 0.8 if level in ("strict", "moderate") else 0.6), "value", "left")
    score = F.coalesce("score", F.lit(0.0))
    valid = F.lit(True) if level == "permissive" else F.col("term_id").isNotNull() & (score >= LEVELS[level])
    return found.select("value", valid.alias("valid"), "term_id", score.alias("score"), tf.mapping_level(score).alias("confidence"), (F.col("term_id").isNotNull() & (score < 0.8)).alias("warning"))


def duplicates(terms: DataFrame) -> DataFrame:
    """(norm, n): normalized terms that occur more than once."""
    return terms.groupBy(tf.normalize_term(F.col("term")).alias("norm")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stats(terms: DataFrame) -> DataFrame:
    """(vocabulary_type, terms, categories, orphans, used)."""
    return terms.groupBy("vocabulary_type").agg(
        F.count(F.lit(1)).alias("terms"), F.count_distinct("category_id").alias("categories"), F.count_if(F.col("category_id").isNull()).alias("orphans"), F.count_if(F.col("usage_count") > 0).alias("used")
    )


def mapping_stats(mappings: DataFrame) -> DataFrame:
    """(total, coverage): mappings, and the share of exact and high ones."""
    return mappings.agg(F.count(F.lit(1)).alias("total"), F.round(F.count_if(F.col("confidence").isin("exact", "high")) / F.count(F.lit(1)), 6).alias("coverage"))


def similar_pairs(terms: DataFrame, threshold: float, key: str = "term_id", text: str = "term") -> DataFrame:
    """(a, b, score): pairs a < b whose normalized terms have bigram Jaccard above the threshold.

    Terms with equal normal form meet on it; others must share a bigram. Only the rarest
    bigrams of a term need be looked up: as many as it can miss, and one more.
    """
    own = terms.select(F.col(key).alias("id"), tf.normalize_term(F.col(text)).alias("norm"))
    names = own.select("norm").distinct().withColumn("grams", tf.bigrams(F.col("norm"))).withColumn("size", F.size("grams"))
    grams = names.select("norm", "size", F.explode("grams").alias("g"))
    spread = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("norm").orderBy("df", "g")
    needed = F.col("size") - F.ceil(F.col("size") * threshold) + 1
    prefix = grams.join(spread, "g").withColumn("place", F.row_number().over(rare)).where(F.col("place") <= needed).select("norm", "size", "g")
    left, right = prefix.select("g", F.col("norm").alias("x"), F.col("size").alias("sx")), prefix.select("g", F.col("norm").alias("y"), F.col("size").alias("sy"))
    close = (left["g"] == right["g"]) & (F.col("x") < F.col("y")) & (F.least("sx", "sy") > F.greatest("sx", "sy") * threshold)
    met = left.join(right, close).select("x", "y").distinct()
    score = tf.bigram_jaccard(F.col("x"), F.col("y"))
    near = met.withColumn("score", score).where(F.col("score") > threshold)
    same = names.select(F.col("norm").alias("x"), F.col("norm").alias("y"), F.lit(1.0).alias("score"))
    bare = names.where("size = 0").select("norm")
    empty = bare.select(F.col("norm").alias("x"), F.lit(1).alias("k")).join(bare.select(F.col("norm").alias("y"), F.lit(1).alias("k")), "k").where("x < y").select("x", "y", F.lit(1.0).alias("score"))
    both = near.unionByName(same).unionByName(empty)
    a, b = own.select(F.col("id").alias("a"), F.col("norm").alias("x")), own.select(F.col("id").alias("b"), F.col("norm").alias("y"))
    joined = both.join(a, "x").join(b, "y").where((F.col("x") != F.col("y")) | (F.col("a") < F.col("b")))
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 6).alias("score"))


def quality(terms: DataFrame) -> DataFrame:
    """One row of scores from 0 to 1: completeness, consistency, coverage, redundancy, hierarchy."""
    n = F.count(F.lit(1))
    up = terms.select(F.col("term_id").alias("k")).distinct()
    base = terms.join(up, F.col("parent_term_id") == F.col("k"), "left")
    flat = base.agg(
        n.alias("n"),
        (1 - (F.count_if(F.col("description").isNull() | (F.col("description") == "")) + F.count_if(F.coalesce(F.size("labels"), F.lit(0)) <= 0)) / (2 * n)).alias("completeness"),
        F.count_if(F.rlike("term", F.lit("[A-Z]{2,}"))).alias("shouted"),
        (F.count_if(F.col("usage_count") > 0) / n).alias("coverage"),
        F.count_if(F.col("parent_term_id").isNotNull() & F.col("k").isNull()).alias("broken"),
    )
    twice = duplicates(terms).agg(F.count(F.lit(1)).alias("twice"))
    close = similar_pairs(terms, 0.9).agg(F.count(F.lit(1)).alias("close"))
    floor = lambda c: F.round(F.greatest(F.lit(0.0), c), 6)
    return flat.crossJoin(twice).crossJoin(close).select(  # one row each
        F.col("n").alias("terms"),
        floor(F.col("completeness")).alias("completeness"),
        floor(1 - (F.col("twice") + F.col("shouted")) / F.col("n")).alias("consistency"),
        floor(F.col("coverage")).alias("coverage"),
        floor(1 - F.col("close") / F.col("n")).alias("redundancy"),
        floor(1 - F.col("broken") / F.col("n")).alias("hierarchy"),
    )


def cluster_syntactic(terms: DataFrame) -> DataFrame:
    """(pattern, size, center, strength): terms that share a three-letter beginning or end, or a word of two; two at least."""
    low = F.lower("term")
    own = tf.words(low)
    pair = F.size(own) == 2
    keys = F.array_compact(
        F.array(
            F.when(F.length(low) >= 3, F.concat(F.lit("prefix_"), F.substring(low, 1, 3))),
            F.when(F.length(low) >= 3, F.concat(F.lit("suffix_"), F.right(low, F.lit(3)))),
            F.when(pair, F.concat(F.lit("first_"), F.get(own, F.lit(0)))),
            F.when(pair, F.concat(F.lit("second_"), F.get(own, F.lit(1)))),
        )
    )
    own_keys = terms.select("term_id", "usage_count", F.explode(keys).alias("pattern"))
    grouped = own_keys.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.min_by("term_id", F.struct(-F.col("usage_count"), F.col("term_id"))).alias("center"))
    return grouped.where("size > 1").select("pattern", "size", "center", F.round(F.least(F.lit(1.0), (F.col("size") - 1) / 10), 6).alias("strength"))


def cluster_usage(terms: DataFrame) -> DataFrame:
    """(band, size, center, strength): terms by how often they are used."""
    band = F.when(F.col("usage_count") > 100, "high").when(F.col("usage_count") > 10, "medium").when(F.col("usage_count") > 0, "low").otherwise("unused")
    grouped = terms.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("size"), F.min_by("term_id", F.struct(-F.col("usage_count"), F.col("term_id"))).alias("center"))
    return grouped.select("band", "size", "center", F.round(F.least(F.lit(1.0), (F.col("size") - 1) / 20), 6).alias("strength"))


def recommendations(terms: DataFrame, now: str, merge: float = 0.8, crowded: int = 15, idle_days: int = 90) -> DataFrame:
    """(kind, term_id, other_id, priority, confidence): merges, crowded parents, terms unused for long; urgent first."""
    merges = similar_pairs(terms, merge).select(F.lit("merge").alias("kind"), F.col("a").alias("term_id"), F.col("b").alias("other_id"), F.lit("medium").alias("priority"), F.col("score").alias("confidence"))
    kids = terms.where("parent_term_id is not null").groupBy("parent_term_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded)
    wide = kids.select(F.lit("restructure"), F.col("parent_term_id"), F.lit(None).cast(terms.schema["term_id"].dataType), F.lit("low"), F.lit(0.6))
    idle = terms.where((F.col("usage_count") == 0) & (F.datediff(F.lit(now).cast("date"), F.col("created_at").cast("date")) > idle_days))
    unused = idle.select(F.lit("cleanup"), "term_id", F.lit(None).cast(terms.schema["term_id"].dataType), F.lit("low"), F.lit(0.7))
    rank = F.create_map(*[F.lit(x) for p in (("critical", 4), ("high", 3), ("medium", 2), ("low", 1)) for x in p])
    return merges.unionAll(wide).unionAll(unused).orderBy(F.desc(rank[F.col("priority")]), F.desc("confidence"), "kind", "term_id")


#: Items of a group up to which its pairs are formed in one place; rows and pairs of items of a task; lots of a task, in each of which equal pairs are counted first.
BASKET, ROWS, PAIRS, LOTS = 256, 500_000, 1_000_000, 64


def cooccurrence(occurrences: DataFrame, item: str, group: str, least: int = 2) -> DataFrame:
    """(a, b, n): pairs of items that occur in the same groups, a < b, at least so often; the groups are written at once.

    Each item counts once in a group; null items and groups don't count. The items of a
    large group are dealt into buckets, and each pair of buckets is joined by itself, so
    that no task forms all pairs of a group. Tasks get bounded numbers of rows, then of
    pairs, however many there are, where pairs are formed and where they are counted:
    shuffled bytes don't tell how many pairs rows make, nor what a table of pairs takes.
    Pairs are counted within lots before they are dealt, so that a frequent pair comes as
    a row for each lot.
    """
    known = occurrences.select(F.col(item).alias("i"), F.col(group).alias("g")).where("i is not null and g is not null")
    own = known.repartition(1 + known.count() // ROWS, "g").distinct()
    sized = own.withColumn("k", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("g")) / BASKET).cast("int"))
    dealt = sized.groupBy("g", "k", F.pmod(F.xxhash64("i"), F.col("k")).cast("int").alias("u"))
    baskets = stored(dealt.agg(F.sort_array(F.collect_list("i")).alias("own")))
    n = F.size("own").cast("long")
    formed = baskets.groupBy("k").agg(F.sum(n * n).alias("n"), F.sum(n).alias("rows")).collect()  # a row for each number of buckets
    inner, outer = sum(r["n"] for r in formed), sum(r["rows"] * r["k"] * BASKET for r in formed if r["k"] > 1)

    def lot(parts: int, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(parts * LOTS))

    parts = 1 + inner // (2 * PAIRS)
    first = baskets.select("own", lot(parts, "g", "u").alias("lot")).repartition(parts, "lot").select("lot", "own", F.posexplode("own").alias("at", "a"))
    met = first.select("lot", "a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("b"))
    counted = met.groupBy("lot", "a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", "n")
    if outer:
        # of two buckets the lesser number comes first, whichever item does
        parts, large = 1 + outer // (2 * PAIRS), baskets.where("k > 1")
        x = large.select("g", F.col("own").alias("p"), "u", F.explode(F.sequence(F.col("u") + 1, F.col("k"))).alias("w")).where("w < k").withColumn("lot", lot(parts, "g", "u", "w")).repartition(parts, "lot")
        y = large.where("u > 0").select("g", F.col("own").alias("q"), F.col("u").alias("w"), F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("u")).withColumn("lot", lot(parts, "g", "u", "w"))
        # the join deals y as x is dealt
        crossed = x.join(y.hint("merge"), ["lot", "g", "u", "w"]).select("lot", F.explode("p").alias("p"), "q").select("lot", "p", F.explode("q").alias("q"))
        both = crossed.groupBy("lot", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        counted = counted.unionAll(both.agg(F.count(F.lit(1)).alias("n")).select("a", "b", "n"))
    dealt = counted.repartition(1 + (inner + outer) // (2 * PAIRS), "a", "b")
    return dealt.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rule_matches(values: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(value, term): the first rule (pattern, term) whose pattern a value holds, whatever its case; null if none does."""
    term = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        term = F.when(F.rlike("value", F.lit(f"(?i){pattern}")), name).otherwise(term)
    return values.select("value", term.alias("term"))


def hierarchical(nodes: DataFrame, pairs: DataFrame, levels: Sequence[float]) -> DataFrame:
    """(node, level, cluster): clusters by single linkage of pairs (a, b, score) at least each level, named by their smallest node.

    The levels are taken from the highest down, and each works on the clusters of the one before.
    """
    from taxolark.operators.relations import components

    label = nodes.select("node", F.col("node").alias("cluster"))
    out = None
    for level in sorted(levels, reverse=True):
        own = pairs.where(F.col("score") >= level).select("a", "b")
        a, b = label.select(F.col("node").alias("a"), F.col("cluster").alias("source")), label.select(F.col("node").alias("b"), F.col("cluster").alias("target"))
        merged = components(label.select(F.col("cluster").alias("node")).distinct(), own.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("source", "target").distinct())
        label = stored(label.join(merged.withColumnRenamed("node", "at").hint("merge"), F.col("cluster") == F.col("at")).select("node", F.col("component").alias("cluster")))
        one = label.select("node", F.lit(float(level)).alias("level"), "cluster")
        out = one if out is None else out.unionAll(one)
    return out


class Hierarchy:
    """Terms by their parents: ``reached`` (term_id, parent_term_id, root_id, depth, path of term_ids), from the terms without a known parent down.

    Paths of any length are found by doubling: in a round a term takes the path of the
    term that its own begins below, so a chain of a thousand takes ten rounds. Terms in a
    circle, and those that hang from one, have no root: ``circular`` (term_id) reports
    them. Made at once; of several rows of a term the smallest parent counts.
    """

    def __init__(self, terms: DataFrame, vocabulary_type: str | None = None, category_id: str | None = None):
        if vocabulary_type is not None:
            terms = terms.where(F.col("vocabulary_type") == vocabulary_type)
        if category_id is not None:
            terms = terms.where(F.col("category_id") == category_id)
        own = terms.where("term_id is not null").groupBy("term_id").agg(F.min("parent_term_id").alias("parent_term_id"))
        known = own.select(F.col("term_id").alias("k"))
        above = own.join(known, F.col("parent_term_id") == F.col("k"), "left")
        done = [stored(above.where("k is null").select("term_id", "parent_term_id", F.array("term_id").alias("path")))]
        # ``up``: the term above the path's first one
        rest = stored(above.where("k is not null").select("term_id", "parent_term_id", F.col("k").alias("up"), F.array("term_id").alias("path")))
        while not rest.isEmpty():
            whole = done[0].select(F.col("term_id").alias("at"), F.col("path").alias("before"))
            for d in done[1:]:
                whole = whole.unionAll(d.select("term_id", "path"))
            further = rest.select(F.col("term_id").alias("at"), F.col("up").alias("next"), F.col("path").alias("before"))
            step = rest.join(whole.withColumn("next", F.lit(None).cast(further.schema["next"].dataType)).unionByName(further), F.col("up") == F.col("at"))
            step = stored(step.select("term_id", "parent_term_id", F.col("next").alias("up"), F.concat("before", "path").alias("path")))
            ended = stored(step.where("up is null").select("term_id", "parent_term_id", "path"))
            if ended.isEmpty():  # each length up to the longest occurs, so a round without an end leaves circles alone
                break
            done.append(ended)
            rest = stored(step.where("up is not null"))
        self.circular = rest.select("term_id")
        whole = done[0]
        for d in done[1:]:
            whole = whole.unionAll(d)
        self.reached = whole.select("term_id", "parent_term_id", F.element_at("path", 1).alias("root_id"), (F.size("path") - 1).alias("depth"), "path")

    def path(self, term_id) -> DataFrame:
        """(term_id, place): the terms from the root to one."""
        return self.reached.where(F.col("term_id") == term_id).select(F.posexplode("path").alias("place", "term_id")).select("term_id", "place")

    def descendants(self, term_id, depth: int | None = None) -> DataFrame:
        """(term_id, distance) below a term."""
        at = F.array_position("path", term_id)
        out = self.reached.where(F.array_contains("path", term_id) & (F.col("term_id") != term_id)).select("term_id", (F.size("path") - at).cast("int").alias("distance"))
        return out if depth is None else out.where(F.col("distance") <= depth)

    def siblings(self, term_id) -> DataFrame:
        """Other terms under the same parent; roots have none."""
        one = F.broadcast(self.reached.where((F.col("term_id") == term_id) & (F.col("depth") > 0)).select(F.col("parent_term_id").alias("p")).limit(1))
        return self.reached.join(one, (F.col("parent_term_id") == F.col("p")) & (F.col("term_id") != term_id)).select("term_id")

    def depths(self) -> DataFrame:
        """(root_id, terms, depth): what hangs from each root, and how deep."""
        return self.reached.groupBy("root_id").agg(F.count(F.lit(1)).alias("terms"), F.max("depth").alias("depth"))


def related(terms: DataFrame, term_id: str, limit: int = 20) -> DataFrame:
    """(term_id, relation, score): parent .9, children .8, siblings .7, and terms alike above .6."""
    one = F.broadcast(terms.where(F.col("term_id") == term_id).select(F.col("term_id").alias("s_id"), F.col("parent_term_id").alias("s_parent"), F.col("term").alias("s_term")).limit(1))
    pairs = terms.join(one, F.col("term_id") != F.col("s_id"))
    alike = tf.bigram_jaccard(tf.normalize_term(F.col("term")), tf.normalize_term(F.col("s_term")))
    relation = F.when(F.col("term_id") == F.col("s_parent"), "parent").when(F.col("parent_term_id") == F.col("s_id"), "child").when(F.col("parent_term_id") == F.col("s_parent"), "sibling").when(alike > 0.6, "similar")
    score = F.when(relation == "parent", 0.9).when(relation == "child", 0.8).when(relation == "sibling", 0.7).otherwise(F.round(alike, 6))
    return pairs.select("term_id", relation.alias("relation"), score.alias("score")).where("relation is not null").orderBy(F.desc("score"), "term_id").limit(limit)
