"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets follow from the weights, a source's repetition
rate is its target over its size, and each document is taken floor(rate) times plus
once more with a probability of the rate's fraction. The draw is a hash of the doc_id,
the text and, where rows repeat, a number among the rows that are alike, so that each
row draws for itself and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.llm.tables import Shelf, before, flat, pick

#: Weights of the sources in order of name, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, text: Column, nth: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5: the same in every run and in other engines."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text, nth.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


#: Rows that are alike and are told apart in one task.
ALIKE = 100_000


def numbered(groups: DataFrame) -> DataFrame:
    """Rows of (..., n) once for each number ``nth`` from 1 to n; large groups are dealt out in parts first."""
    parts = groups.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(ALIKE).cast("long"))))
    parts = parts.repartition("first", *[c for c in groups.columns if c != "n"])
    return parts.withColumn("nth", F.explode(F.sequence("first", F.least("n", F.col("first") + ALIKE - 1)))).drop("first", "n")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, shelf: Shelf | None = None) -> DataFrame:
    """(source, source_size, target) for sizes (source, size).

    Sources by code point, null last, get the weights in turn and share ``share`` times
    all sizes by them; no target is above ``most`` times its source's size, and the
    excess goes to the others by weight. The result is a level: each target is the
    smaller of its bound and level times weight. In order of bound over weight, the
    level that leaves the first sources at their bounds is largest at the right cut.
    There may be as many sources as documents. A source of size 0 has target 0.
    """
    shelf = shelf or Shelf(sizes.sparkSession)
    by_name = F.col("source").asc_nulls_last()
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = before(summed, [by_name], {"place": F.lit(1)}, shelf)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    bound = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("bound"))
    bound = bound.withColumn("ratio", F.col("bound") / F.col("weight"))
    cut = shelf.put(before(bound, [F.col("ratio").asc(), by_name], {"full": F.col("bound"), "gone": F.col("weight")}, shelf))
    whole = cut.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = cut.crossJoin(F.broadcast(whole)).agg(F.max((F.lit(share) * F.col("all_size") - F.col("full")) / (F.col("all_weight") - F.col("gone"))).alias("level"))
    # whole and level are one row each; the written table's size tells the planner whether documents must be shuffled to meet it
    return shelf.put(cut.crossJoin(F.broadcast(level)).select("source", "source_size", F.least("bound", F.col("level") * F.col("weight")).alias("target")))


def plan(docs: DataFrame, shelf: Shelf | None = None, seed: int = 42, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for documents (doc_id, text, source), one for each row.

    Size is the number of words; 0 for a null or empty text. Copies follow from doc_id,
    text, source and seed, and among rows that agree in all from their number, so reruns
    agree and each row draws for itself; a null doc_id or text draws as an empty string.
    A null source is a source of its own. No rows give no rows; other columns are ignored.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    sized = pick(docs, "doc_id", "text", "source").select("doc_id", "source", text_hash(F.col("text")).alias("hash"), word_count(F.col("text")).alias("size"))
    alike = shelf.put(sized.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n")))
    share_of = targets(alike.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most, shelf).select(F.col("source").alias("of"), F.col("source_size"), F.col("target"))
    once = alike.where("n = 1").select("doc_id", "source", "hash", "size", F.lit(1).cast("long").alias("nth"))
    rows = once.unionAll(numbered(alike.where("n > 1")).select(*once.columns))
    joined = rows.join(share_of, F.col("source").eqNullSafe(F.col("of")))
    taken = joined.withColumn("copies", copies(F.col("doc_id"), F.col("hash"), F.col("nth"), F.col("target"), F.col("source_size"), seed))
    return taken.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(doc_id: Column, text: Column, nth: Column, target: Column, source_size: Column, seed: int = 42) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (draw(doc_id, text, nth, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, seed: int = 42, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, shelf: Shelf | None = None) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (see ``plan``); columns as given.

    Sizes are summed in a first pass over the texts; the second pass joins each
    document with its source's rate. Rows that agree in doc_id, text and source, if
    there are any, are numbered part by part; which of them is taken more often, where
    they differ in other columns, follows the order of the files.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    names, rows = docs.columns, flat(docs)
    doc_id, text, source = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source"))
    key = [doc_id.alias("of_id"), source.alias("of_source"), text_hash(text).alias("of_hash")]
    alike = shelf.put(rows.select(*key, word_count(text).alias("size")).groupBy("of_id", "of_source", "of_hash", "size").agg(F.count("*").alias("n")))
    share_of = targets(alike.select(F.col("of_source").alias("source"), (F.col("size") * F.col("n")).alias("size")), weights, share, most, shelf)
    repeated = alike.where("n > 1").select("of_id", "of_source", "of_hash")
    hashed = rows.withColumn("hash", text_hash(text))
    if repeated.isEmpty():
        told = hashed.withColumn("nth", F.lit(1).cast("long"))
    else:
        same = doc_id.eqNullSafe(F.col("of_id")) & source.eqNullSafe(F.col("of_source")) & (F.col("hash") == F.col("of_hash"))
        once = hashed.join(repeated, same, "left_anti").withColumn("nth", F.lit(1).cast("long"))
        many = shelf.put(hashed.join(repeated, same, "left_semi").withColumn("part", F.spark_partition_id()))
        by = [F.col(c) for c in ("c" + str(names.index("doc_id")), "c" + str(names.index("source")), "hash")]
        counts = many.groupBy(*by, "part").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*[c.alias(f"of{i}") for i, c in enumerate(by)], F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        within = Window.partitionBy(*by, "part").orderBy("part")
        on = by[0].eqNullSafe(F.col("of0")) & by[1].eqNullSafe(F.col("of1")) & (by[2] == F.col("of2")) & (F.col("part") == F.col("of_part"))
        placed = many.withColumn("place", F.row_number().over(within)).join(offsets, on)
        told = once.unionAll(placed.withColumn("nth", F.col("place") + F.col("offset")).select(*once.columns))
    joined = told.join(share_of, source.eqNullSafe(F.col("source")))
    taken = joined.withColumn("copies", copies(doc_id, F.col("hash"), F.col("nth"), F.col("target"), F.col("source_size"), seed)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*rows.columns).toDF(*names)
