"""A stored full-text index: postings in blocks that know the best that they can score.

Documents are dealt into slots by a hash of their key; a block holds a word's postings of
one slot, with the largest count and the shortest text among them, from which follows
what a document of that block can score at most, whatever the whole collection's figures
are. A request reads the blocks' heads of its own words, one partition for each, scores
the slots that promise most, and then only those that promise at least as much as it has
found. Documents added later make a segment of their own; removed ones are noted and left
out of all results; merging makes one segment of what is left.

Texts are shuffled once, to their slots, where their postings are formed and put into
blocks; blocks are shuffled once, to the files of their words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.operators.stored import remove, stored

#: Documents of a slot, about; partitions of words; slots that are scored first; words of a task; slots of which a word's blocks stay together.
SLOT, BUCKETS, FIRST, WORDS, SPAN = 512, 64, 8, 1_000_000, 256


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index in a folder that all machines share; it outlives the session that made it.

    Words are what stands between white space, in lower case. One writer at a time, and
    no reader meanwhile. ``key`` is the documents' key, which no two of them share.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.kind = spark.read.parquet(f"{self.path}/docs").schema["key"].dataType.simpleString()

    def docs(self) -> DataFrame:
        """(key, slot, size, at, segment): ``size`` is the number of words, null for a null text, ``at`` the place in the slot from 0."""
        return self._docs("docs").join(self.gone().select("segment", "slot", "at"), ["segment", "slot", "at"], "left_anti").select("key", "slot", "size", "at", "segment")

    def gone(self) -> DataFrame:
        """(key, slot, size, at, segment) of the documents removed since the last merge; blocks still hold them."""
        return self._docs("gone")

    def _docs(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}, slot long, size int, at int, segment int").parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        """(word, slot, n, most, shortest, postings array<struct<at, n>>, segment, bucket): which document of a slot is at a place, ``docs`` tells."""
        kind = "word string, slot long, n long, most long, shortest int, postings array<struct<at: int, n: int>>, segment int, bucket int"
        return self.spark.read.schema(kind).parquet(f"{self.path}/blocks")

    def figures(self) -> DataFrame:
        """(segment, docs, words, sized) without removed documents: a row for each segment."""
        less = _figures(self.gone().groupBy("segment")).toDF("segment", "d", "w", "s")
        rest = [(F.col(x) - F.coalesce(y, F.lit(0))).alias(x) for x, y in (("docs", "d"), ("words", "w"), ("sized", "s"))]
        return self._figures().join(less, "segment", "left").select("segment", *rest)

    def _figures(self) -> DataFrame:
        return self.spark.read.schema("docs long, words long, sized long, segment int").parquet(f"{self.path}/figures")

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str) -> TextIndex:
        """An index of the documents, written to the folder; computes at once. Documents without a key are left out."""
        spark = df.sparkSession
        remove(spark, path)
        _build(df, key, text, path, 0)
        index = cls(spark, path)
        index._note(index._docs("docs").where("false"))  # makes the folder
        return index

    def add(self, df: DataFrame, key: str, text: str) -> None:
        """Documents more, as a segment of their own; those whose key is there are replaced."""
        self.remove(df.select(F.col(key).alias("key")))
        _build(df, key, text, self.path, self._next())

    def remove(self, keys: DataFrame) -> None:
        """Without the documents of these keys (key): they are noted, and their blocks stay until the next merge."""
        self._note(self.docs().join(keys.select("key").where("key is not null").distinct(), "key", "left_semi"))

    def _note(self, docs: DataFrame) -> None:
        docs.select("key", "slot", "size", "at", "segment").write.mode("append").partitionBy("segment").parquet(f"{self.path}/gone")

    def merge(self) -> None:
        """One segment of all, without removed documents."""
        known = [r["segment"] for r in self._figures().select("segment").collect()]  # a row for each call of add
        gone = self.gone()
        if len(known) < 2 and gone.isEmpty():
            return
        # slots of later segments go behind those of earlier ones
        ends = {r["segment"]: r["last"] + 1 for r in self._docs("docs").groupBy("segment").agg(F.max("slot").alias("last")).collect()}
        shift, table = 0, [F.lit(-1), F.lit(0)]
        for s in sorted(ends):
            table += [F.lit(s), F.lit(shift)]
            shift += ends[s]
        moved = (F.col("slot") + F.create_map(*table)[F.col("segment")]).cast("long").alias("slot")
        # of each slot, which places are gone
        places = gone.groupBy("segment", "slot").agg(F.collect_set("at").alias("ats"))
        flags = places.select("segment", "slot", F.transform(F.sequence(F.lit(0), F.array_max("ats")), lambda i: F.array_contains("ats", i)).alias("flags"))
        whole = self.blocks().select("segment", "slot", "word", "shortest", *_columns()).join(flags, ["segment", "slot"], "left")
        left = F.filter(_zipped(), lambda p: ~F.coalesce(F.get("flags", p["at"]), F.lit(False)))
        blocks = whole.select("word", moved, "shortest", F.when(F.col("flags").isNull(), _zipped()).otherwise(left).alias("postings")).where(F.size("postings") > 0)
        segment = self._next()
        words = _write_docs(self.docs().select("key", moved, "size", "at"), self.path, segment)
        _write_blocks(blocks, self.path, segment, words)
        for s in known:
            for name in ("docs", "blocks", "figures", "gone"):
                remove(self.spark, f"{self.path}/{name}/segment={s}")

    def _next(self) -> int:
        return (self._figures().agg(F.max("segment")).first()[0] or 0) + 1

    def heads(self, words: list[str]) -> DataFrame:
        """(segment, slot, word, n, most, shortest) of the blocks of some words; neither other partitions nor postings are read."""
        wanted = F.lit(False)
        for w in words:
            wanted = wanted | ((F.col("bucket") == _bucket(F.lit(w))) & (F.col("word") == w))
        return self.blocks().where(wanted).select("segment", "slot", "word", "n", "most", "shortest")

    def search(self, query: str, k1: float = 1.2, b: float = 0.75, limit: int = 10) -> DataFrame:
        """(key, score): BM25 of the query's distinct words, best first, ties by key; computes at once.

        The result is that of scoring every document; scores have six decimals.
        """
        words = sorted(set(query.lower().split()))
        whole = self.figures().agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.sum("sized").alias("sized")).first()
        heads = self.heads(words)
        spread = {r["word"]: r["df"] for r in heads.groupBy("word").agg(F.sum("n").alias("df")).collect()}  # a row for each word
        dead = self.gone().select("segment", "slot", "at")
        if not dead.isEmpty():
            for r in self._postings(words, dead.select("segment", "slot")).join(dead, ["segment", "slot", "at"], "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect():
                spread[r["word"]] -= r["n"]
        spread = {w: n for w, n in spread.items() if n}
        if not spread:
            return self.spark.range(0).select(F.lit(None).cast(self.kind).alias("key"), F.lit(0.0).alias("score"))
        words = list(spread)
        heads = self.heads(words)
        mean = whole["words"] / max(1, whole["sized"])
        weight = F.create_map(*[F.lit(x) for w, n in spread.items() for x in (w, math.log(1 + (whole["docs"] - n + 0.5) / (n + 0.5)))])

        def part(n: str, size: str) -> Column:
            return weight[F.col("word")] * F.col(n) * (k1 + 1) / (F.col(n) + k1 * (1 - b + b * F.col(size) / mean))

        promised = stored(heads.groupBy("segment", "slot").agg(F.sum(part("most", "shortest")).alias("promise")))
        first = promised.orderBy(F.desc("promise"), "segment", "slot").limit(FIRST)
        found = stored(self._scored(words, first, part, limit))
        floor = found.agg(F.when(F.count(F.lit(1)) >= limit, F.min("score")).alias("floor")).first()["floor"]
        rest = promised.join(first, ["segment", "slot"], "left_anti")
        if floor is not None:  # scores are rounded
            rest = rest.where(F.col("promise") >= floor - 1e-6)
        return found.unionAll(self._scored(words, rest, part, limit)).orderBy(F.desc("score"), "key").limit(limit)

    def _postings(self, words: list[str], slots: DataFrame) -> DataFrame:
        """(word, segment, slot, at, n) of some words and slots, removed documents included."""
        wanted = F.lit(False)
        for w in words:
            wanted = wanted | ((F.col("bucket") == _bucket(F.lit(w))) & (F.col("word") == w))
        own = self.blocks().where(wanted).join(slots, ["segment", "slot"], "left_semi")
        return own.select("word", "segment", "slot", F.explode("postings").alias("p")).select("word", "segment", "slot", "p.*")

    def _scored(self, words: list[str], slots: DataFrame, part, limit: int) -> DataFrame:
        """The best documents of some slots."""
        slots = slots.select("segment", "slot")
        docs = self.docs().join(slots, ["segment", "slot"], "left_semi")
        own = self._postings(words, slots).join(docs, ["segment", "slot", "at"])
        return own.groupBy("key").agg(F.round(F.sum(part("n", "size")), 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def _build(df: DataFrame, key: str, text: str, path: str, segment: int) -> None:
    """A segment of the documents; of several with one key, which there should not be, one counts."""
    known = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    slot = F.pmod(F.xxhash64("key"), F.lit(1 + known.count() // SLOT)).alias("slot")
    at = (F.row_number().over(Window.partitionBy("slot").orderBy("key")) - 1).alias("at")
    own, one = tf.words(F.lower("text")), F.xxhash64("text")
    sizes = known.groupBy("key").agg(F.min(F.struct(one.alias("one"), F.when(own.isNotNull(), F.size(own)).alias("size"))).alias("first"))
    words = _write_docs(sizes.select("key", slot, F.col("first.size").alias("size")).select("key", "slot", "size", at), path, segment)
    # all that follows stays where a slot is
    placed = known.select("key", "text", slot).repartition(_parts(words), "slot").groupBy("slot", "key").agg(F.min_by("text", one).alias("text")).select("slot", at, "text")
    single = placed.select("slot", "at", own.alias("own")).select("slot", "at", F.size("own").alias("size"), F.explode("own").alias("word"))
    counted = single.groupBy("slot", "word", "at", "size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # a slot bounds what a block holds
    blocks = counted.groupBy("slot", "word").agg(F.min("size").alias("shortest"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("postings"))
    _write_blocks(blocks, path, segment, words)


def _columns() -> list[Column]:
    """Postings as an array for each field, which take less room in a shuffle."""
    return [F.transform("postings", lambda p: p["at"].cast("smallint")).alias("at"), F.transform("postings", lambda p: p["n"]).alias("n")]


def _zipped() -> Column:
    """Postings of these arrays."""
    return F.zip_with("at", "n", lambda at, n: F.struct(at.cast("int").alias("at"), n.alias("n")))


def _parts(words: int) -> int:
    return 1 + words // WORDS


def _figures(docs) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("words"), F.count("size").alias("sized"))


def _write_docs(docs: DataFrame, path: str, segment: int) -> int:
    """Documents (key, slot, size, at) and their figures; the number of their words."""
    docs.sortWithinPartitions("key").write.mode("overwrite").parquet(at := f"{path}/docs/segment={segment}")
    _figures(docs.sparkSession.read.schema(docs.schema).parquet(at)).write.mode("overwrite").parquet(of := f"{path}/figures/segment={segment}")
    return docs.sparkSession.read.schema("words long").parquet(of).first()["words"]


def _write_blocks(blocks: DataFrame, path: str, segment: int, words: int) -> None:
    """Blocks (word, slot, shortest, postings) by words, in tasks of bounded size; the blocks of a frequent word are in several."""
    share = F.pmod(F.xxhash64("word", F.floor(F.col("slot") / SPAN)), F.lit(1 + 2 * _parts(words) // BUCKETS))
    dealt = blocks.select("word", "slot", "shortest", *_columns()).repartition(_parts(words), _bucket(F.col("word")), share)
    heads = _bucket(F.col("word")).alias("bucket"), "word", "slot", F.size("n").cast("long").alias("n"), F.array_max("n").cast("long").alias("most"), "shortest"
    found = dealt.select(*heads, _zipped().alias("postings")).sortWithinPartitions("bucket", "word", "slot")
    found.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/segment={segment}")
