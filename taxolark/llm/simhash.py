"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints within
four bits either agree in a whole segment, or differ in exactly one bit in each of
two segments. The first case meets on the segment's value. For the second, each
segment is decoded to the nearest Golay codeword (one index) and to all codewords
within distance four (one or six); a word's nearest codeword is always among those
of a word one bit away. One side of the join carries (nearest, all) of a pair of
segments and the other (all, nearest), so no link is lost. Candidates are verified.

Such a key has 22 to 24 bits, so with many fingerprints it has many rows. A crowded
key is made longer by the Golay indices of the segments that it leaves open. Words
two bits apart share a codeword within distance four, that nearest to the word between
them. So of the open segments' errors either all are at most two each, and the indices
within four meet in every open segment, or one segment has three or four and the other
one at most, where nearest and within four meet as above. Keys then have 34 to 46
bits. What is crowded still is a group of near copies, and is linked through the
points between them (see ``links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolark.llm import golay
from taxolark.llm.components import components
from taxolark.llm.tables import Shelf, flat, pick, slices

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed before their bits are added up.
CHUNK = 1 << 16


def shingle_hashes(raw: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of each n-word shingle; of the whole sequence if there are fewer words; none if there are no words."""
    words = raw.lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes).tolist(), ends[min(n, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first, last, strict=False)], dtype=np.uint64)


def fingerprints_of(texts: list[bytes | None], n: int, seed: int) -> np.ndarray:
    """One signed 64-bit fingerprint for each text; 0 for a text that is null or has no words."""
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def add() -> None:
        nonlocal size
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(ones, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        held.clear()
        owner.clear()
        size = 0

    for i, raw in enumerate(texts):
        hashes = shingle_hashes(raw or b"", n, seed)
        total[i] = len(hashes)
        for at in range(0, len(hashes), CHUNK):
            held.append(hashes[at : at + CHUNK])
            owner.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                add()
    add()
    packed = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    return packed.view(np.int64).reshape(-1)


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and fp long of documents (text); null and empty texts have fingerprint 0."""
    rows = pick(docs, *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            fp = fingerprints_of(b.column(len(keep)).to_pylist(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp, type=pa.int64())], names=[*keep, "fp"])

    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keep], T.StructField("fp", T.LongType())])
    return rows.select(*keep, F.col("text").cast("binary")).mapInArrow(run, schema)


#: Of each kind of key, the segments that it leaves open: kinds 0 to 2 hold a whole segment, 3 to 5 a pair's indices.
OPEN = ((1, 2), (0, 2), (0, 1), (2,), (1,), (0,))


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]


class _Rows:
    """Rows made of others: the row that each comes from, its key, its side."""

    def __init__(self) -> None:
        self.row, self.key, self.left = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=bool)]

    def put(self, of: np.ndarray, kind: int, value: np.ndarray, left: bool | np.ndarray) -> None:
        self.row.append(of)
        self.key.append(kind << 40 | value)
        self.left.append(np.full(len(of), left) if isinstance(left, bool) else left)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(self.row), np.concatenate(self.key), np.concatenate(self.left)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, left, fp): a row's partners are those of the other side with its key."""
    for b in slices(batches, 4096):
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, out, every = _parts(fp), _Rows(), np.arange(len(fp))
        for kind, part in enumerate(parts):
            out.put(every, kind, part, True)
            out.put(every, kind, part, False)
        near = [golay.nearest(p) for p in parts]
        around = [golay.within_four(p) for p in parts]
        for kind, (x, y) in enumerate(combinations(range(len(parts)), 2), len(parts)):
            of, code = around[y]
            out.put(of, kind, near[x][of] << golay.MESSAGE | code, True)
            of, code = around[x]
            out.put(of, kind, code << golay.MESSAGE | near[y][of], False)
        row, key, left = out.all()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(left), pa.array(fp[row])], names=["key", "left", "fp"])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, more, left, fp): crowded keys' rows with the indices of the open segments."""
    for b in slices(batches, 4096):
        key, left, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        parts, out, kinds = _parts(fp.astype(np.int64)), _Rows(), key >> 40
        for kind, open_ in enumerate(OPEN):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            side = left[own]
            near = [golay.nearest(parts[x][own]) for x in open_]
            around = [golay.within_four(parts[x][own]) for x in open_]
            if len(open_) == 1:
                of, code = around[0]
                out.put(own[of], 0, code, side[of])
                continue
            (row_x, code_x), (row_y, code_y) = around
            width = np.bincount(row_y, minlength=len(own))
            first = np.cumsum(width) - width
            times = width[row_x]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            of = np.repeat(row_x, times)
            out.put(own[of], 0, np.repeat(code_x, times) << golay.MESSAGE | code_y[first[of] + nth], side[of])
            for n in range(2):
                out.put(own[side], 1 + n, near[n][side], True)
                of, code = around[n]
                right = ~side[of]
                out.put(own[of[right]], 1 + n, code[right], False)
        row, more, left = out.all()
        yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(more), pa.array(left), pa.array(fp[row])], names=["key", "more", "left", "fp"])


#: All patterns of two bits or fewer: two fingerprints within four bits share one of their sums with these.
_MASKS = [0, *(sum(1 << b for b in bits) for k in (1, 2) for bits in combinations(range(64), k))]
_MASKS = [m - (1 << 64) if m >= 1 << 63 else m for m in _MASKS]

#: Rows of a key up to which they are paired, and of a longer key up to which pairing costs less than sums with all patterns.
CROWD, DENSE = 512, len(_MASKS)


def _paired(rows: DataFrame, key: list[str]) -> DataFrame:
    """Verified pairs (a, b) of the two sides of each key."""
    left = rows.where("left").select(*key, F.col("fp").alias("a"))
    right = rows.where("not left").select(*key, F.col("fp").alias("b"))
    near = left.join(right, key).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 4))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(points: DataFrame, shelf: Shelf, crowd: int = CROWD, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) whose components are those of all links within four bits between ``points`` (fp), all different.

    A key with ``crowd`` rows or fewer is joined and each candidate pair verified. The
    rows of a larger key get longer keys, and are joined by these. Those of a longer key
    with more than ``dense`` rows are linked without pairing them: each meets all others
    within two bits of any point within two bits of itself, and all that meet at one
    point are within four bits of each other, so a star suffices. As two fingerprints
    within four bits always share such a point, no link is lost, and the work grows
    with the number of fingerprints, not with its square.
    """
    keys = shelf.put(points.select("fp").mapInArrow(_keys, "key long, left boolean, fp long"))
    crowded = shelf.put(keys.groupBy("key").count().where(F.col("count") > crowd).select("key"))
    if crowded.isEmpty():
        return shelf.put(_paired(keys, ["key"]).distinct())
    found = _paired(keys.join(crowded, "key", "left_anti"), ["key"])
    longer = shelf.put(keys.join(crowded, "key", "left_semi").select("key", "left", "fp").mapInArrow(_longer, "key long, more long, left boolean, fp long"))
    hot = shelf.put(longer.groupBy("key", "more").count().where(F.col("count") > dense).select("key", "more"))
    if hot.isEmpty():
        out = shelf.put(found.unionAll(_paired(longer, ["key", "more"])).distinct())
    else:
        found = found.unionAll(_paired(longer.join(hot, ["key", "more"], "left_anti"), ["key", "more"]))
        many = longer.join(hot, ["key", "more"], "left_semi").select("fp").distinct()
        meet = many.select("fp", F.explode(F.array(*map(F.lit, _MASKS))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
        stars = meet.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        out = shelf.put(found.unionAll(stars.select("a", F.explode("all").alias("b")).where("a < b")).distinct())
    shelf.drop(keys, crowded, longer, hot)
    return out


def groups(prints: DataFrame, shelf: Shelf) -> DataFrame:
    """(fp, root) of all different fingerprints of ``prints`` (fp): the smallest reachable over links."""
    points = shelf.put(prints.select("fp").distinct())
    found = components(links(points, shelf), shelf)
    return points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shelf: Shelf | None = None, n: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id reachable over links of four bits or fewer.

    ``docs``: doc_id (integer), text; other columns are ignored. Null and empty texts,
    and texts of white space, have fingerprint 0 and link like any other. Rows are
    returned as often as they occur; those without doc_id link like others but name no
    group, so a group of such rows only has a null component_id. No rows give no rows.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    prints = shelf.put(fingerprints(docs, n, seed))
    least = prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least"))
    of = shelf.put(groups(prints, shelf).join(least, "fp"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """The documents with one of each group kept, the one of the smallest doc_id; columns as given.

    Of rows that repeat the smallest doc_id the one with the smallest hash of its text
    stays, one of equal rows; a row without doc_id stays only if its group has no other.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    names, rows = docs.columns, flat(docs)
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rows = rows.withColumn("hash", F.xxhash64(text, F.col(text).isNull()))
    keyed = rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), "hash")
    prints = shelf.put(fingerprints(keyed, 4, 42, keep=("doc_id", "hash")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")).alias("best")
    least = prints.groupBy("fp").agg(best)
    chosen = groups(prints, shelf).join(least, "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = shelf.put(chosen.select(F.col("best.doc_id").alias("id"), F.col("best.hash").alias("h")))
    kept = rows.join(chosen, rows[key].eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left_semi")
    repeated = shelf.put(prints.groupBy("doc_id", "hash").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("hash").alias("h")))
    same = rows[key].eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    once = kept.join(repeated, same, "left_anti").select(*rows.columns)
    many = kept.join(repeated, same, "left_semi").select(*rows.columns).dropDuplicates([key, "hash"])
    return once.unionAll(many).drop("hash").toDF(*names)
