"""Prefix trie of conversations, without a trie in any one place.

A node is a distinct sequence of first turns. Turns are hashed with their place, so a
prefix's digest is a running sum, which is taken over ranges of rows; a conversation of
any length is split among tasks. Of each digest the smallest conversation is known: its
owner. Who owns a prefix owns all its longer ones, so a conversation's first owned depth
is found by binary search, all conversations at once, a join a step. What a conversation
owns from there on is its chain, and the chains form a tree: each hangs on the node of
another's chain one depth above. Sums over subtrees are made along the chains' tree,
bottom up, with pointers that double, and then along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.llm.tables import Shelf, pick

#: Numbers of 32 bits of which a digest is made: two longs.
WORDS = 4
#: Conversation ids that are written together at most, a power of two.
RUN = 65_536


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], shelf: Shelf) -> DataFrame:
    """Rows with, under each name, the sum of a column up to the row among the rows of its key.

    Rows are dealt by range of key and order and summed within their part; a key that
    goes over several parts gets the sums of the parts before. ``order`` tells the rows
    of a key apart, but for rows that are alike.
    """
    dealt = shelf.put(df.repartitionByRange(F.col(key), *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy(key, "part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("of"), F.col("part").alias("at"), *[F.sum(n).over(earlier).alias(f"o_{n}") for n in sums])
    carried = carried.where(F.col(f"o_{next(iter(sums))}").isNotNull())  # a key goes on into a part: one for each part at most
    inside = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    out = found.join(F.broadcast(carried), (F.col(key) == F.col("of")) & (F.col("part") == F.col("at")), "left")
    return out.select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"o_{n}"), F.lit(0))).cast("long").alias(n) for n in sums])


def numbered(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, n, turn_hash, bytes) of rows (conv_id, turn, role, text): n is the turn's number from 1.

    Turns are in order of turn, null first, then of the role's and the text's beginning
    and of the turn's hash. Null roles and texts are empty; rows without conv_id are left out.
    """
    said = pick(rows, "conv_id", "turn", "role", "text").where("conv_id is not null")
    said = said.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    hashed = said.select(
        F.col("conv_id").cast("long"),
        "turn",
        F.substring("role", 1, 64).alias("role"),
        F.substring("text", 1, 256).alias("text"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("turn_hash"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    order = [F.col(c) for c in ("turn", "role", "text", "turn_hash")]
    return running(hashed, "conv_id", order, {"n": F.lit(1)}, shelf).select("conv_id", "n", "turn_hash", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: (conv_id), and (conv_id, depth, turn_hash, bytes) of their turns.

    ``turns``: from ``numbered``. Conversation c gets the first h turns of conversation
    c - c % group, h being the unsigned crc32 of its decimal id % ``most`` (all if there
    are fewer, none if that conversation is absent), then its own after its first h.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    every = counts.select("conv_id", head, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lent = counts.select(F.col("conv_id").alias("base"), F.least(F.col("size"), F.lit(most)).alias("lent"))
    plan = every.join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("shift"))
    own = turns.join(plan.select("conv_id", "h", "shift"), "conv_id").where(F.col("n") > F.col("h"))
    own = own.select("conv_id", (F.col("n") - F.col("h") + F.col("shift")).alias("depth"), "turn_hash", "bytes")
    # at most ``most`` turns of one conversation go to at most ``group`` others
    first = turns.where((F.col("n") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "n", "turn_hash", "bytes")
    borrowed = first.join(plan, "base").where(F.col("n") <= F.col("h")).select("conv_id", F.col("n").alias("depth"), "turn_hash", "bytes")
    return every.select("conv_id"), own.unionAll(borrowed)


def prefixes(turns: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, depth, bytes, k1, k2): the digest of the first ``depth`` turns, of turns (conv_id, depth, turn_hash, bytes)."""
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "turn_hash"), 256)
    words = [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(WORDS)]
    summed = running(turns.select("conv_id", "depth", "bytes", *words), "conv_id", [F.col("depth")], {f"s{i}": F.col(f"w{i}") for i in range(WORDS)}, shelf)
    low = [F.col(f"s{i}").bitwiseAND(0xFFFFFFFF) for i in range(WORDS)]
    return summed.select("conv_id", "depth", "bytes", *[F.shiftleft(low[2 * i], 32).bitwiseOR(low[2 * i + 1]).alias(f"k{i + 1}") for i in range(2)])


def first_owned(sizes: DataFrame, at: DataFrame, minima: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, size, first): the first depth from 1 that a conversation owns, size + 1 if none, by binary search.

    ``sizes`` (conv_id, size), ``at`` (conv_id, depth, k1, k2), ``minima`` (depth, k1, k2,
    owner, ...). A step asks, for every conversation still open, who owns its middle depth.
    """
    state = shelf.put(sizes.select("conv_id", "size", F.lit(1).cast("long").alias("low"), (F.col("size") + 1).alias("high")))
    while not state.where("low < high").isEmpty():
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        asked = state.where("low < high").select("conv_id", middle.alias("depth")).join(at, ["conv_id", "depth"])
        told = asked.join(minima.select("depth", "k1", "k2", "owner"), ["depth", "k1", "k2"]).select("conv_id", F.col("depth").alias("asked"), (F.col("owner") == F.col("conv_id")).alias("owns"))
        moved = state.join(told, "conv_id", "left").select(
            "conv_id",
            "size",
            F.when(~F.col("owns"), F.col("asked") + 1).otherwise(F.col("low")).alias("low"),
            F.when(F.col("owns"), F.col("asked")).otherwise(F.col("high")).alias("high"),
        )
        moved = shelf.put(moved)
        shelf.drop(state)
        state = moved
    return state.select("conv_id", "size", F.col("low").alias("first"))


def subtree_sums(chains: DataFrame, names: list[str], shelf: Shelf) -> DataFrame:
    """Chains (conv_id, parent, names) with each name summed over the chain and all below it.

    A round adds the sums of the chains that a pointer reaches and doubles the pointers,
    so a tree of any height takes as many rounds as its height has binary digits.
    """
    state = shelf.put(chains.select("conv_id", "parent", *names))
    while not state.where("parent is not null").isEmpty():
        given = state.where("parent is not null").groupBy(F.col("parent").alias("to")).agg(*[F.sum(n).alias(f"g_{n}") for n in names])
        further = state.select(F.col("conv_id").alias("at"), F.col("parent").alias("next")).where("next is not null")
        moved = state.join(given, F.col("conv_id") == F.col("to"), "left").join(further, F.col("parent") == F.col("at"), "left")
        moved = shelf.put(moved.select("conv_id", F.col("next").alias("parent"), *[(F.col(n) + F.coalesce(F.col(f"g_{n}"), F.lit(0))).alias(n) for n in names]))
        shelf.drop(state)
        state = moved
    return state.drop("parent")


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, member): SHA-256 of each node's members, ascending, joined by commas.

    Members are joined by runs of ids first, RUN at most; a node's runs then stream
    through one task in order, which a hash of one sequence needs, and none is held.
    """
    run = F.shiftright("member", RUN.bit_length() - 1)
    joined = ends.groupBy("conv_id", "depth", run.alias("run")).agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("said"))
    dealt = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for c, d, said in zip(*(b.column(n).to_pylist() for n in ("conv_id", "depth", "said")), strict=True):
                if (c, d) == node:
                    sha.update(f",{said}".encode())
                    continue
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (c, d), hashlib.sha256(said.encode())
            yield _rows(out)
        if node is not None:
            yield _rows([(*node, sha.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"])

    return dealt.select("conv_id", "depth", "said").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(every: DataFrame, turns: DataFrame, shelf: Shelf) -> DataFrame:
    """The nodes of conversations (conv_id) with turns (conv_id, depth from 1, turn_hash, bytes); computes at once but for its last joins.

    Per node: conv_id, its smallest member; depth; parent_conv_id, null for the root;
    n_convs; n_children; n_leaves, the childless nodes of its subtree; saved_tokens,
    over its subtree (n_convs - 1) times the bytes of a node's last turn; ends_sha256
    of the members that end here. The root has depth 0 and all conversations, those
    without turns too. No conversations give no rows; conv_ids are distinct and not null.
    """
    at = shelf.put(prefixes(turns, shelf))
    sizes = shelf.put(every.join(at.groupBy("conv_id").agg(F.max("depth").alias("size")), "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    top, total = sizes.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    minima = shelf.put(at.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes")))
    found = first_owned(sizes, at, minima, shelf)
    # who owns the node one depth above: the parent of a chain, and where a conversation without one ends
    above = found.where("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")).join(at, ["conv_id", "depth"]).join(minima, ["depth", "k1", "k2"])
    held = found.join(above.select("conv_id", F.col("owner").alias("up")), "conv_id", "left")
    root = F.col("conv_id") == F.lit(top)
    held = shelf.put(held.select("conv_id", "size", F.when(root, 0).otherwise(F.col("first")).alias("first"), F.when(~root, F.coalesce("up", F.lit(top))).alias("up")))
    chains = held.where("first <= size")
    hung = chains.where("up is not null").select("conv_id", F.col("up").alias("on"), (F.col("first") - 1).alias("at"))
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    if top is not None:
        nodes = nodes.unionAll(sizes.sparkSession.range(1).select(F.lit(top).alias("conv_id"), F.lit(0).cast("long"), F.lit(total), F.lit(0).cast("long")))
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    tail = hung.groupBy(F.col("on").alias("conv_id"), F.col("at").alias("size")).agg(F.lit(0).cast("long").alias("leaf"))
    each = chains.join(own, "conv_id").join(tail, ["conv_id", "size"], "left").select("conv_id", F.col("up").alias("parent"), "saved", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaves"))
    summed = subtree_sums(each, ["saved", "leaves"], shelf)
    gained = hung.join(summed, "conv_id").groupBy(F.col("on").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hung"), F.sum("saved").alias("g_saved"), F.sum("leaves").alias("g_leaves"))
    zero = F.lit(0).cast("long")
    wide = nodes.join(gained, ["conv_id", "depth"], "left").join(chains.select("conv_id", "size", "first", "up"), "conv_id")
    wide = wide.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("hung", zero) + (F.col("depth") < F.col("size")).cast("long")).alias("n_children"),
        (F.col("saved") + F.coalesce("g_saved", zero)).alias("saved"),
        (F.coalesce("g_leaves", zero) + F.when((F.col("depth") == F.col("size")) & F.col("hung").isNull(), 1).otherwise(0)).alias("leaves"),
    )
    whole = running(wide, "conv_id", [F.col("depth").desc()], {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")}, shelf)
    ends = held.select(F.when(F.col("first") <= F.col("size"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("size").alias("depth"), F.col("conv_id").alias("member"))
    out = whole.join(digests(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
