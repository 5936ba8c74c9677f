"""Nearest neighbours by stable projections and a kd-tree.

Vectors are projected to a few dimensions by a Gaussian matrix: over its choice, the
squared ratio of a projected to a true distance is chi-square distributed. The
projections are indexed by a kd-tree whose upper cells are dealt to tasks and whose
lower cells, the leaves, are built in the task. A query takes leaves in order of
projected distance and verifies their vectors, until a vector as near as its k-th
nearest so far would, with the wanted probability, have been met already.

A task holds a piece of a cell and some of the queries that come to it, both of
bounded size. Equal queries are answered once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolark.llm.tables import Shelf
from taxolark.llm.vectors import distances, largest, matrix, padded, same, usable, width

#: Projected dimensions (even) and wanted probability of meeting a neighbour.
DIMENSIONS, SURE = 8, 0.975
#: Most rows of a piece, rows of the smallest piece made for the sake of more tasks, rows of a leaf, queries that a task answers.
PIECE, SMALL, LEAF, ASK = 8192, 512, 32, 512
#: Rows whose projections the cells are fitted on, and levels of cells.
SAMPLE, DEPTH = 131_072, 14
#: Distances from rows to cells that are held at once.
HELD = 1 << 21
#: The id that a query leaves out if it leaves out none.
NOBODY = -(1 << 63)


def chi_square(x: float, m: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - exp(-x / 2) * total


def stop_ratio(m: int, sure: float) -> float:
    """The squared ratio of projected to true distance that the wanted share of vectors stays within."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < sure else (lo, mid)
    return hi


def projection(d: int, m: int = DIMENSIONS, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, m))


class Cells:
    """The upper kd-tree: medians of a bounded sample, in heap order; every vector falls in one cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, m = depth, sample.shape[1]
        self.axis, self.cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        self.lo, self.hi = np.full((1 << depth, m), -np.inf), np.full((1 << depth, m), np.inf)
        self._split(1, sample, self.lo[0].copy(), self.hi[0].copy())

    def _split(self, at: int, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if at >= 1 << self.depth:
            self.lo[at - (1 << self.depth)], self.hi[at - (1 << self.depth)] = lo, hi
            return
        axis = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
        cut = float(np.median(own[:, axis])) if len(own) else 0.0
        self.axis[at], self.cut[at] = axis, cut
        for side in (0, 1):
            inner_lo, inner_hi = lo.copy(), hi.copy()
            (inner_lo if side else inner_hi)[axis] = cut
            self._split(2 * at + side, own[(own[:, axis] >= cut) == bool(side)], inner_lo, inner_hi)

    def of(self, p: np.ndarray) -> np.ndarray:
        at = np.ones(len(p), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + (p[np.arange(len(p)), self.axis[at]] >= self.cut[at])
        return at - (1 << self.depth)

    def near(self, p: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell) for each cell whose squared distance from a row is within the row's reach; some rows at a time."""
        step = max(1, HELD // len(self.lo) // p.shape[1])
        for x in range(0, len(p), step):
            own = p[x : x + step, None, :]
            gaps = (np.maximum(0, np.maximum(self.lo - own, own - self.hi)) ** 2).sum(axis=2)
            row, cell = np.nonzero(gaps <= reach[x : x + step, None])
            yield row + x, cell


class Leaves:
    """The lower kd-tree of one piece: rows in leaf order and the leaves' boxes."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        order: list[np.ndarray] = []
        todo = [np.arange(len(p))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                order.append(rows)
                continue
            axis = int(np.argmax(np.ptp(p[rows], axis=0)))
            half = len(rows) // 2
            rows = rows[np.argpartition(p[rows, axis], half)]
            todo += [rows[:half], rows[half:]]
        self.rows = np.concatenate(order) if order else np.empty(0, dtype=np.int64)
        self.starts = np.cumsum([0, *map(len, order)])
        self.lo = np.array([p[r].min(axis=0) for r in order])
        self.hi = np.array([p[r].max(axis=0) for r in order])

    def gaps(self, q: np.ndarray) -> np.ndarray:
        return (np.maximum(0, np.maximum(self.lo - q, q - self.hi)) ** 2).sum(axis=1)


def search(ids: np.ndarray, v: np.ndarray, p: np.ndarray, own_ids: np.ndarray, q: np.ndarray, qp: np.ndarray, bound: np.ndarray, k: int, ratio: float, scale: float = 1.0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, distances) of up to k nearest of the rows (v, projected p) for each query, as far as nearer than its bound.

    ``own_ids``: an id that is no candidate for the query, or NOBODY. ``scale``: projections
    are of vectors multiplied by it, bounds and distances are not.
    """
    tree = Leaves(p)
    for n in range(len(q)):
        gaps = tree.gaps(qp[n])
        near = np.argsort(gaps, kind="stable")
        best_d, best_i, limit, at, step = np.empty(0), np.empty(0, dtype=np.int64), bound[n], 0, 4
        while at < len(near) and gaps[near[at]] <= ratio * (limit * scale) ** 2:
            own = np.concatenate([tree.rows[tree.starts[x] : tree.starts[x + 1]] for x in near[at : at + step]])
            at, step = at + step, 2 * step
            if own_ids[n] != NOBODY:
                own = own[ids[own] != own_ids[n]]
            own = own[((p[own] - qp[n]) ** 2).sum(axis=1) <= ratio * (limit * scale) ** 2]
            best_d, best_i = np.concatenate([best_d, distances(v[own], q[n])]), np.concatenate([best_i, ids[own]])
            first = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[first], best_i[first]
            if len(best_d) == k:
                limit = min(limit, best_d[-1])
        yield n, best_i, best_d


def _spread(rows: np.ndarray) -> np.ndarray:
    """Hashes of the rows of an array of 64-bit numbers, not negative."""
    bits = np.ascontiguousarray(rows).view(np.uint64).reshape(len(rows), rows.size // max(1, len(rows)))
    odd = np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(bits.shape[1], dtype=np.uint64) + np.uint64(1))
    mixed = (bits * odd).sum(axis=1)
    return (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, shelf: Shelf | None = None, sure: float = SURE, seed: int = 42, piece_rows: int = PIECE, ask_rows: int = ASK) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest of ``rows`` for each of ``queries``, both (vec_id, embedding).

    The score is the Euclidean distance in double precision; ties go to the smaller
    vec_id; rows of a query's own vec_id are no candidates. Each neighbour is found with
    a probability of ``sure`` at least. Rows that take no part (vectors.usable) are
    neither queries nor candidates; repeated rows (vec_id and vector) count once. A
    vec_id with several vectors is a candidate with each of them, and as a query has a
    list, ranked from 1, for each. Of equal vectors the k + 1 smallest vec_ids are
    indexed: no other can be among a query's k nearest. A query is first looked up in
    its own cell, then in those that its k-th distance doesn't rule out. Components may
    be as large or small as doubles are. Other columns are ignored; no rows give no rows.
    """
    shelf = shelf or Shelf(rows.sparkSession)
    base, wanted = usable(rows), usable(queries)
    d = max(width(base), width(wanted))
    if not d:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    alike = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = padded(base, d).select("*", *same()).withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    few = shelf.put(few.distinct())
    m, ratio = DIMENSIONS, stop_ratio(DIMENSIONS, sure)
    most = largest(few)
    scale = 1.0 if 1e-100 < most < 1e100 else float(np.ldexp(1.0, min(1000, -int(np.frexp(most)[1]))))
    turn = projection(d, m, seed)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    total = few.count()
    pieces_wanted = max(total / piece_rows, min(total / SMALL, 4 * cores), 1)
    depth = min(DEPTH, int(np.ceil(np.log2(pieces_wanted))))

    def project(v: np.ndarray) -> np.ndarray:
        return (v * scale) @ turn

    def shadows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = project(matrix(b.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * m), pa.array(p.ravel()))], names=["p"])

    sample = few.select("v").sample(min(1.0, SAMPLE / max(1, total)), seed=seed).limit(SAMPLE).mapInArrow(shadows, "p array<double>").toArrow()
    cells = Cells(matrix(sample["p"].combine_chunks(), m), depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cells.of(project(matrix(b.column(0), d)))), *b.columns], names=["cell", *b.schema.names])

    found = shelf.put(few.select("v", "vec_id").mapInArrow(placed, "cell long, v array<double>, vec_id long"))
    shelf.drop(few)
    parts = np.ones(1 << depth, dtype=np.int64)  # a cell of more rows than a piece has several pieces
    for r in found.groupBy("cell").count().collect():  # a number for each cell
        parts[r["cell"]] = -(-r["count"] // piece_rows)
    start = np.concatenate([[0], np.cumsum(parts)])

    # a query is a vector; an id with several vectors has queries of its own
    told = padded(wanted, d).select("vec_id", "v", *same())
    members = told.select("vec_id", "k1", "k2").distinct()
    several = members.groupBy("vec_id").count().where("count > 1").select("vec_id", F.lit(True).alias("several"))
    members = members.join(several, "vec_id", "left").withColumn("own", F.when(F.col("several"), F.col("vec_id")).otherwise(F.lit(NOBODY)))
    members = shelf.put(members.select("vec_id", "k1", "k2", "own", F.xxhash64("k1", "k2", "own").alias("ask")))
    asked = told.join(members, ["vec_id", "k1", "k2"]).groupBy("ask").agg(F.min("own").alias("own"), F.min_by("v", "vec_id").alias("v"))
    asked = shelf.put(asked.select("v", "ask", "own").mapInArrow(placed, "cell long, v array<double>, ask long, own long"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for b in batches:
            yield b, np.arange(b.num_rows), b.column(0).to_numpy()

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for b in batches:
            home, reach = b.column(0).to_numpy(), ratio * (b.column(4).to_numpy() * scale) ** 2
            for row, cell in cells.near(project(matrix(b.column(1), d)), reach):
                away = cell != home[row]
                yield b, row[away], cell[away]

    def look(_: tuple, own: pa.Table, ask: pa.Table) -> pa.Table:
        none = pa.table({"ask": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not own.num_rows or not ask.num_rows:
            return none
        v, q, asks = matrix(own["v"], d), matrix(ask["v"], d), ask["ask"].to_numpy()
        got = list(search(own["vec_id"].to_numpy(), v, project(v), ask["own"].to_numpy(), q, project(q), ask["bound"].to_numpy(), k + 1, ratio, scale))
        who = np.repeat([asks[n] for n, _, _ in got], [len(i) for _, i, _ in got])
        return pa.table({"ask": who.astype(np.int64), "vec_id": np.concatenate([i for _, i, _ in got]), "score": np.concatenate([s for _, _, s in got])})

    def in_pieces(ask: DataFrame, visits) -> DataFrame:
        """Each piece is dealt out once for every ``ask_rows`` queries that come to its cell."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(1 << depth, dtype=np.int64)
            for _, _, cell in visits(batches):
                n += np.bincount(cell, minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["cell", "n"])

        slots = np.zeros(1 << depth, dtype=np.int64)  # none where no query comes: such cells are not read at all
        for r in ask.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            slots[r["cell"]] = -(-r["n"] // ask_rows)
        spots = np.concatenate([[0], np.cumsum(parts * slots)])  # a cell's spots: one for each piece and slot

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column(0).to_numpy()
                part, times = _spread(matrix(b.column(1), d)) % parts[cell], slots[cell]
                row = np.repeat(np.arange(b.num_rows), times)
                slot = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                at = cell[row]
                spot = spots[at] + part[row] * slots[at] + slot
                yield pa.RecordBatch.from_arrays([pa.array(spot), *b.take(pa.array(row)).columns[1:]], names=["spot", "v", "vec_id"])

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, row, cell in visits(batches):
                times = parts[cell]
                slot = _spread(b.column(2).to_numpy()[row]) % np.maximum(1, slots[cell])
                spot = spots[cell] + slot
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                spot = np.repeat(spot, times) + nth * np.repeat(slots[cell], times)
                yield pa.RecordBatch.from_arrays([pa.array(spot), *b.take(pa.array(np.repeat(row, times))).columns[1:]], names=["spot", "v", "ask", "own", "bound"])

        own = found.mapInArrow(dealt, "spot long, v array<double>, vec_id long")
        ask = ask.mapInArrow(sent, "spot long, v array<double>, ask long, own long, bound double")
        return own.groupBy("spot").cogroup(ask.groupBy("spot")).applyInArrow(look, "ask long, vec_id long, score double")

    best = Window.partitionBy("ask").orderBy("score", "vec_id")
    near = shelf.put(in_pieces(asked.withColumn("bound", F.lit(float("inf"))), at_home))
    limit = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k + 1).select("ask", F.col("score").alias("bound"))
    bounded = shelf.put(asked.join(limit, "ask", "left").select("cell", "v", "ask", "own", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
    every = near.unionAll(in_pieces(bounded, elsewhere))
    top = every.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("ask", "vec_id", "score")
    told = members.select("ask", F.col("vec_id").alias("query_id")).join(top, "ask").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
