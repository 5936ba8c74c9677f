"""Vector code compression: integer codebooks for the parts of vectors, fitted and applied exactly.

A vector's components become integers and the vector is cut into equal parts; each part
position has a codebook. The nearest entry is found by annular norm pruning: entries are
sorted by norm, and since two vectors are at least as far apart as their norms, only
entries whose norm lies within the current best distance of the part's can be nearer.
That interval is found by binary search, ends included, and evaluated in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolark.llm.tables import Shelf, pick, slices

#: Rows of vectors and pairs of part and entry that a worker compares at once.
ROWS, PAIRS = 8192, 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """``entries`` (part, entry, position) of integers; a component's integer is floor(scale * x)."""

    scale: int = 256
    entries: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0), dtype=np.int64))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _kept(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(k0, ..., v array<double>) of the rows whose vector is not null and holds neither null nor non-finite components."""
    rows = pick(rows, *keep, "embedding").toDF(*[f"k{i}" for i in range(len(keep))], "v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn("v", F.col("v").cast("array<double>")).where(F.col("v").isNotNull() & finite)


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """A row for each vector, filled up with zeros; components that squared distances in 64 bits have no room for raise."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(values) and np.abs(values).max() > np.sqrt(2.0**61 / width) / 2:
        raise OverflowError("components are too large for integer distances of 64 bits")
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values.astype(np.int64)
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``parts`` the nearest entry, of equally near ones the first, and the squared distance."""
    norms = np.sqrt((entries**2).sum(axis=1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    norms, sorted_entries = norms[order], entries[order]
    own = np.sqrt((parts**2).sum(axis=1).astype(np.float64))
    above = np.minimum(np.searchsorted(norms, own), len(norms) - 1)
    below = np.maximum(above - 1, 0)
    seed = np.where(np.abs(norms[above] - own) < np.abs(norms[below] - own), above, below)
    reach = np.sqrt(((parts - sorted_entries[seed]) ** 2).sum(axis=1).astype(np.float64))
    reach += 1e-9 + 1e-12 * (own + reach)  # far more than the roots are rounded by
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    index, best = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(high - low)])
    at = 0
    while at < len(parts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        sizes = (high - low)[at:to]
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(at, to), sizes)
        place = np.arange(sizes.sum()) - np.repeat(starts - low[at:to], sizes)
        distance = ((parts[row] - sorted_entries[place]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, starts)
        first = np.where(distance == np.repeat(least, sizes), order[place], len(norms))
        index[at:to], best[at:to] = np.minimum.reduceat(first, starts), least
        at = to
    return index, best


def _sums(kept: DataFrame, books: Codebooks) -> np.ndarray:
    """(part, entry, position + 1): counts of the parts that an entry is nearest to, then their sums."""
    n, k, w = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, k, w + 1), dtype=np.int64)
        for b in slices(batches, ROWS):
            vectors = integers(b.column("v"), n * w, books.scale)
            for p in range(n):
                part = vectors[:, p * w : (p + 1) * w]
                index, _ = nearest(part, books.entries[p])
                np.add.at(total[p, :, 1:], index, part)
                total[p, :, 0] += np.bincount(index, minlength=k)
        used = np.flatnonzero(np.repeat(total[:, :, 0].ravel() > 0, w + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int64()), pa.array(total.ravel()[used], type=pa.int64())], names=["cell", "n"])

    cells = kept.select("v").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(n * k * (w + 1), dtype=np.int64)
    for cell, total in cells.collect():  # as many rows as the codebooks have numbers and counts
        out[cell] = total
    return out.reshape(n, k, w + 1)


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of rows (vec_id, embedding), fitted on all of them; computes at once.

    Each starts as the parts of the ``entries`` smallest vec_ids that are not null, in
    order (of an id with several vectors the smallest one, null ids start none), or of
    all if they are fewer. A round assigns every part to its nearest entry and replaces
    each entry that has parts by their floored mean. Every worker adds up what it reads,
    so counts and sums, not rows, reach the driver. Vectors shorter than the longest, or
    than a multiple of ``parts``, are filled up with zeros. No rows give no entries.
    """
    kept = _kept(rows, ("vec_id",))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts)) * parts
    ids = [r[0] for r in kept.where("k0 is not null").select("k0").distinct().orderBy("k0").limit(entries).collect()]
    first = kept.where(F.col("k0").isin(ids)).groupBy("k0").agg(F.min("v").alias("v")).orderBy("k0").collect() if ids else []
    start = integers(pa.array([r["v"] for r in first], type=pa.list_(pa.float64())), width, scale)
    books = Codebooks(scale, np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2)))
    for _ in range(rounds if len(start) else 0):
        totals = _sums(kept, books)
        counts = totals[:, :, :1]
        books = Codebooks(scale, np.where(counts > 0, totals[:, :, 1:] // np.maximum(counts, 1), books.entries))
    return books


def encode(rows: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns of ``keep``, ``code`` string and ``error`` long of rows (embedding).

    ``code``: the index of each part's nearest entry, two hex digits each (ties to the
    lower index); ``error``: the squared distances summed over the parts. Rows whose
    vector is null or holds null or non-finite components are dropped; others are
    returned as often as they occur. Without entries nothing can be encoded: no rows.
    """
    n, k, w = books.entries.shape
    kept = _kept(rows, keep)
    fields = [T.StructField(f"k{i}", kept.schema[f"k{i}"].dataType) for i in range(len(keep))]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(k)])
        for b in slices(batches, ROWS) if k else ():
            vectors = integers(b.column(len(keep)), n * w, books.scale)
            found = [nearest(vectors[:, p * w : (p + 1) * w], books.entries[p]) for p in range(n)]
            code = np.array([digits[i] for i, _ in found]).T
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(["".join(c) for c in code.tolist()], type=pa.string()), pa.array(sum(d for _, d in found), type=pa.int64())],
                names=[f.name for f in schema.fields],
            )

    return kept.mapInArrow(run, schema).toDF(*keep, "code", "error")


def decode(rows: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns of ``keep`` and ``embedding`` array<double>, the vector that a code (code) stands for; of a null code null."""
    rows = pick(rows, *keep, "code").toDF(*[f"k{i}" for i in range(len(keep))], "code")
    schema = T.StructType([*[rows.schema[f"k{i}"] for i in range(len(keep))], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            codes = [None if c is None else np.concatenate([books.entries[p][i] for p, i in enumerate(bytes.fromhex(c))]) / books.scale for c in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(codes, type=pa.list_(pa.float64()))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).toDF(*keep, "embedding")


def compress(rows: DataFrame, shelf: Shelf) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error, label_error) of rows (vec_id, embedding, label), and the codebooks; fits at once.

    ``label_error``: the error summed over all rows of an equal label, null labels
    together. Labels are summed before they are joined, and the join can be split
    where one label holds many rows.
    """
    books = fit(rows)
    coded = shelf.put(encode(rows, books, keep=("vec_id", "label")))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error"), books
