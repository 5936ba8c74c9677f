"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, which changes no cosine. Rows are
ranked along the first axis and dealt into blocks of equal size; a task compares a
pair of blocks tile by tile. A tile's products are accumulated over the leading axes
first; what the rest can add is at most the product of the two suffix norms, so pairs
that cannot reach the threshold are left there. Pairs of blocks, and of tiles within
them, whose boxes on the leading axes are too far apart are never compared. Survivors
are decided by the cosine of the vectors as given.

A row is sent once for each partner of its block. Blocks are as large as a task may
hold, unless there are so few rows that all tasks are wanted, so a row travels to
(rows / rows of a block) tasks at most, and to fewer where the first axis tells blocks
apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.llm.components import components
from taxolark.llm.tables import Shelf, before
from taxolark.llm.vectors import matrix, padded, same, scaled, unusable, usable, width

#: Bytes of a block's vectors, of which a task holds two; rows of the smallest block and of a tile.
BLOCK_BYTES, LEAST, TILE = 32 << 20, 1024, 1024
#: Axes whose ranges make up a box.
BOX = 8
#: Share of a tile's pairs from which the tile is multiplied out rather than pair by pair.
DENSE = 0.02


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _gram(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((d, d))
    for b in batches:
        v = unit(matrix(b.column(0), d))
        total += v.T @ v
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "x"])


def axes(found: DataFrame, d: int) -> np.ndarray:
    """The principal axes of all unit vectors, strongest first, as columns. Only a d x d matrix reaches the driver."""
    sums = found.select("v").mapInArrow(lambda it: _gram(it, d), "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    gram = np.zeros(d * d)
    for row in sums.collect():
        gram[row["at"]] = row["x"]
    return np.ascontiguousarray(np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1])


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives rows linked by pairs (i, j) one label, the smallest row; label keeps pointing at roots."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label[:] = up


class Pairs:
    """Compares two sets of vectors (or one with itself) tile by tile."""

    def __init__(self, rotate: np.ndarray, threshold: float):
        self.rotate, self.threshold = rotate, threshold
        d = len(rotate)
        self.steps = [s for s in (d // 4, d // 2) if s] + [d]
        self.far = 2 - 2 * threshold + 1e-9  # the square of the distance of two unit vectors at the threshold

    def prepare(self, v: np.ndarray) -> dict:
        v = scaled(v)
        norm = np.linalg.norm(v, axis=1)
        turned = (v / norm[:, None]) @ self.rotate
        rest = np.sqrt(np.maximum(0, 1 - np.cumsum(turned**2, axis=1)))
        cuts = np.arange(0, len(v), TILE)
        low, high = (f.reduceat(turned[:, :BOX], cuts, axis=0) if len(v) else turned[:, :BOX] for f in (np.minimum, np.maximum))
        return {"v": v, "norm": norm, "turned": turned, "lead": turned[:, : self.steps[0]].astype(np.float32), "rest": [rest[:, s - 1] for s in self.steps], "low": low, "high": high}

    def meet(self, low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Which boxes are near enough to one box."""
        gap = np.maximum(0, np.maximum(lows - high, low - highs))
        return np.flatnonzero((gap**2).sum(axis=1) <= self.far)

    def exact(self, a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a["v"][i], b["v"][j]) / (a["norm"][i] * b["norm"][j])

    def tile(self, a: dict, ra: slice, b: dict, rb: slice) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all pairs of the tile that reach the threshold."""
        margin = 1e-5  # of float32 sums of products of unit vectors
        got = a["lead"][ra] @ b["lead"][rb].T
        bound = got + np.outer(a["rest"][0][ra].astype(np.float32), b["rest"][0][rb].astype(np.float32))
        i, j = np.nonzero(bound >= self.threshold - margin)
        i, j = i + ra.start, j + rb.start
        if len(i) > DENSE * got.size:
            full = a["turned"][ra] @ b["turned"][rb].T
            i, j = np.nonzero(full >= self.threshold - 1e-9)
            sure = full[i, j] > self.threshold + 1e-9
            i, j = i + ra.start, j + rb.start
            near = np.flatnonzero(~sure)
            sure[near] = self.exact(a, i[near], b, j[near]) >= self.threshold
            return i[sure], j[sure]
        sums = np.zeros(len(i))
        for k, (start, stop) in enumerate(zip([0, *self.steps], self.steps, strict=False)):
            sums += np.einsum("ij,ij->i", a["turned"][i, start:stop], b["turned"][j, start:stop])
            alive = sums + a["rest"][k][i] * b["rest"][k][j] >= self.threshold - margin
            i, j, sums = i[alive], j[alive], sums[alive]
        yes = self.exact(a, i, b, j) >= self.threshold
        return i[yes], j[yes]

    def compare(self, va: np.ndarray, wa: np.ndarray, vb: np.ndarray | None, wb: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For the rows of both sets: other vectors linked across, by weight; the row that stands for those linked here."""
        a = self.prepare(va)
        b, own = (a, True) if vb is None else (self.prepare(vb), False)
        n, m = len(va), len(va) if own else len(vb)
        weight = wa if own else np.concatenate([wa, wb])
        shift = 0 if own else n
        links, label = np.zeros(len(weight), dtype=np.int64), np.arange(len(weight))
        for x in range(0, n, TILE):
            for t in self.meet(a["low"][x // TILE], a["high"][x // TILE], b["low"], b["high"]).tolist():
                y = t * TILE
                if own and y < x:
                    continue
                i, j = self.tile(a, slice(x, min(n, x + TILE)), b, slice(y, min(m, y + TILE)))
                if own:
                    i, j = i[i < j], j[i < j]
                j = j + shift
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                _hook(label, i, j)
        return links, label


def near_duplicates(rows: DataFrame, shelf: Shelf | None = None, threshold: float = 0.95, block_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows (vec_id, embedding), one for each row.

    Two vectors are linked if their cosine in double precision is at least the
    threshold. ``n_links`` counts the other rows linked directly; the component is named
    by its smallest vec_id and that row is kept. Rows of one vec_id with unlike vectors
    are rows like any others, each with its own links; a row without vec_id links too,
    but names no component and isn't kept (a component of such rows alone has a null
    name). Rows that take no part (see vectors.usable) have no links and are components
    of their own. Equal vectors are compared once and counted as often as they occur.
    Finite components may be as large or small as doubles are. Other columns are
    ignored; no rows give no rows. ``block_rows`` overrides the size of a block.
    """
    shelf = shelf or Shelf(rows.sparkSession)
    found = usable(rows, ids=False).select("vec_id", "v", *same())
    classes = found.groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.any_value("v").alias("v"))
    classes = shelf.put(classes.withColumn("node", F.monotonically_increasing_id()))  # a number of the table as written
    d = width(classes)
    linked = shelf.put(_linked(padded(classes, d), d, threshold, shelf, block_rows)) if d else classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    count = linked.groupBy("node").agg(F.sum("links").alias("links"))
    component = components(linked.select(F.col("root").alias("a"), F.col("node").alias("b")), shelf)
    label = classes.select("k1", "k2", "node", "weight", "low").join(count, "node", "left").join(component, "node", "left")
    label = shelf.put(label.withColumn("component", F.coalesce("component", "node")))
    names = label.groupBy("component").agg(F.min("low").alias("name"))
    members = found.select("vec_id", "k1", "k2").join(label.join(names, "component"), ["k1", "k2"])
    some = members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.col("name").alias("component_id"))
    out = some.unionAll(unusable(rows, ids=False).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def block_size(rows: int, d: int, cores: int) -> int:
    """Rows of a block: what a task may hold, or fewer, so that the pairs of blocks give every core some."""
    return max(1, min(BLOCK_BYTES // (8 * d), max(LEAST, ceil(rows / ceil(sqrt(4 * cores))))))


def _linked(classes: DataFrame, d: int, threshold: float, shelf: Shelf, block_rows: int | None) -> DataFrame:
    """(node, links, root): what each compared pair of blocks found for its rows that have links."""
    rotate = axes(classes, d)
    total = classes.count()
    size = block_rows or block_size(total, d, classes.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-total // size))
    box = min(BOX, d)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit(matrix(b.column(2), d)) @ rotate[:, 0])], names=["node", "weight", "v", "first"])

    first = classes.select("node", "weight", "v").mapInArrow(along, "node long, weight long, v array<double>, first double")
    ranked = before(first, [F.col("first"), F.col("node")], {"place": F.lit(1)}, shelf)
    dealt = shelf.put(ranked.select(F.floor(F.col("place") / size).alias("block"), "place", "node", "weight", "v"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, block = unit(matrix(b.column(1), d)) @ rotate[:, :box], b.column(0).to_numpy()
            for g in np.unique(block):
                own = lead[block == g]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(box, g)), pa.array(np.arange(box)), pa.array(own.min(0)), pa.array(own.max(0))], names=["block", "axis", "lo", "hi"])

    lo, hi = np.full((blocks, box), np.inf), np.full((blocks, box), -np.inf)
    seen = dealt.select("block", "v").mapInArrow(ranges, "block long, axis long, lo double, hi double")
    for r in seen.groupBy("block", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # 8 numbers for each 32 MB of vectors
        lo[r["block"], r["axis"]], hi[r["block"], r["axis"]] = r["lo"], r["hi"]
    pairs = Pairs(rotate, threshold)

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(0).to_numpy()
            for g in np.unique(block):
                own = b.filter(pa.array(block == g))
                for h in pairs.meet(lo[g], hi[g], lo, hi):
                    pair = int(min(g, h)) * blocks + int(max(g, h))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, pair)), *own.columns], names=["pair", "block", "place", "node", "weight", "v"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")  # by block and, inside, along the first axis
        block, node = t["block"].to_numpy(), t["node"].to_numpy()
        weight, v = t["weight"].to_numpy(), matrix(t["v"], d)
        cut = int((block == block[0]).sum())
        a, b = divmod(int(t["pair"][0].as_py()), blocks)
        if a == b:
            links, label = pairs.compare(v, weight, None, None)
        elif cut < len(block):
            links, label = pairs.compare(v[:cut], weight[:cut], v[cut:], weight[cut:])
        else:
            links, label = np.zeros(len(v), dtype=np.int64), np.arange(len(v))
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[label[some]]})

    sent = dealt.mapInArrow(partners, "pair long, block long, place long, node long, weight long, v array<double>")
    return sent.groupBy("pair").applyInArrow(compare, "node long, links long, root long")
