"""A stored index of completions: what to suggest for the beginning, or any part, of a text.

Every part of a text up to a length is a key, and a key keeps its best completions only,
so an answer is one small read from one partition. Keys of the full length keep all of
theirs: a longer partial text is answered from these, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolark.operators.stored import remove, stored

#: Characters of the longest key; partitions of keys.
LENGTH, SHARDS = 6, 64


def _shard(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


class Completions:
    """An index of texts in a folder that all machines share; one writer at a time, and no reader meanwhile.

    ``keep``: answers at most. Texts that begin with the partial one come first if
    ``begins``, else the earlier a text holds it the better; ties by text. Case is ignored.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10, begins: bool = True):
        self.spark, self.path, self.keep, self.begins = spark, path.rstrip("/"), keep, begins

    def entries(self) -> DataFrame:
        """(key, text, place, shard): the best completions of each key."""
        return self.spark.read.schema("key string, text string, place int, shard int").parquet(f"{self.path}/entries")

    def texts(self) -> DataFrame:
        return self.spark.read.schema("text string").parquet(f"{self.path}/texts")

    @classmethod
    def build(cls, texts: DataFrame, path: str, keep: int = 10, begins: bool = True) -> Completions:
        """An index of the distinct texts (text), written to the folder; computes at once. Nulls have no part."""
        index = cls(texts.sparkSession, path, keep, begins)
        remove(index.spark, index.path)
        own = stored(texts.select("text").where("text is not null").distinct())
        index._put(index._best(index._keys(own)), "overwrite")
        own.write.parquet(f"{index.path}/texts")
        return index

    def add(self, texts: DataFrame) -> None:
        """Texts more: their keys take them in, other keys stay."""
        fresh = stored(texts.select("text").where("text is not null").distinct().join(self.texts(), "text", "left_anti"))
        if fresh.isEmpty():
            return
        new = stored(self._keys(fresh))
        self._rewrite(self._best(self.entries().drop("shard").unionByName(new)), new)
        fresh.write.mode("append").parquet(f"{self.path}/texts")

    def remove(self, texts: DataFrame) -> None:
        """Without these texts: their keys are filled up again from all others."""
        gone = stored(texts.select("text").join(self.texts().distinct(), "text", "left_semi").distinct())
        if gone.isEmpty():
            return
        left = stored(self.texts().join(gone, "text", "left_anti"))
        hit = stored(self._keys(gone).select("key").distinct())
        refilled = self._keys(left).join(hit, "key", "left_semi")
        kept = self.entries().drop("shard").join(hit, "key", "left_anti")
        self._rewrite(kept.unionByName(self._best(refilled)), hit)
        left.write.mode("overwrite").parquet(f"{self.path}/texts")

    def suggest(self, partial: str) -> DataFrame:
        """(text, place): the best texts that hold the partial one, and where; an empty one has no answer."""
        low = partial.lower()
        key = F.lit(low[:LENGTH])
        own = self.entries().where((F.col("shard") == _shard(key)) & (F.col("key") == key))
        place = F.instr(F.lower("text"), low)
        found = own.select("text", place.alias("place")).where((F.col("place") > 0) & F.lit(bool(low))).distinct()
        return found.orderBy(*self._order(), "text").limit(self.keep)

    def _order(self) -> list[Column]:
        return [F.when(F.col("place") == 1, 0).otherwise(1)] if self.begins else [F.col("place")]

    def _keys(self, texts: DataFrame) -> DataFrame:
        """(key, text, place): every part of a text up to the length, where it is first."""
        low = texts.select("text", F.lower("text").alias("low")).where(F.length("low") > 0)
        starts = low.select("text", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("place"))
        parts = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(LENGTH), F.length("low") - F.col("place") + 1))))
        return parts.groupBy(F.substr("low", "place", "n").alias("key"), "text").agg(F.min("place").cast("int").alias("place"))

    def _best(self, keyed: DataFrame) -> DataFrame:
        """Of short keys the best alone: the window is cut to these before rows are sent."""
        rank = Window.partitionBy("key").orderBy(*self._order(), "text")
        short = keyed.where(F.length("key") < LENGTH).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= self.keep).drop("rank")
        return short.unionByName(keyed.where(F.length("key") >= LENGTH))

    def _put(self, entries: DataFrame, mode: str) -> None:
        dealt = entries.withColumn("shard", _shard(F.col("key"))).repartitionByRange("shard", "key", "text").sortWithinPartitions("shard", "key", "text")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{self.path}/entries")

    def _rewrite(self, entries: DataFrame, keys: DataFrame) -> None:
        """Only partitions that hold one of the keys are written; one that loses all its rows goes."""
        shards = [r["shard"] for r in keys.select(_shard(F.col("key")).alias("shard")).distinct().collect()]  # SHARDS at most
        new = stored(entries.where(_shard(F.col("key")).isin(shards)))
        full = {r["shard"] for r in new.select(_shard(F.col("key")).alias("shard")).distinct().collect()}
        self._put(new, "overwrite")
        for s in set(shards) - full:
            remove(self.spark, f"{self.path}/entries/shard={s}")
