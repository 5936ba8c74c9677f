"""A stored vector index: inverted lists of quantised residuals, with the vectors for an exact last step.

Vectors lie in the list of their nearest centre, one partition of the table for each
list. Beside a vector stands its residual in one byte a component, and how far that is
from the truth. A search reads the codes of the lists that it probes, keeps what may be
among the nearest by these bounds, and measures only that on the vectors themselves.
The lists' radii tell which other lists can hold anything nearer, so a search can go on
until its result is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolark.operators.stored import remove, stored

#: Vectors from which centres are fitted at most; rounds of fitting; lists at most.
SAMPLE, ROUNDS, LISTS = 50_000, 8, 4096
#: Rows of a list and queries that a task compares at once.
PIECE, ASKED = 8192, 256
#: Lists that a search for the certain result probes first.
FIRST = 4

_ROW = "id {0}, list int, v array<double>, code binary, scale double, slack double, gap double"


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _gaps(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all centres."""
    out = np.empty((len(v), len(centers)))
    for at in range(0, len(v), 1024):
        part = v[at : at + 1024]
        out[at : at + 1024] = np.sqrt(np.maximum(0.0, (part**2).sum(axis=1)[:, None] - 2 * part @ centers.T + (centers**2).sum(axis=1)))
    return out


def _fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres by Lloyd's rounds, from rows spread over the sample; a centre without rows stays."""
    centers = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _gaps(sample, centers).argmin(axis=1)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


class VectorIndex:
    """An index in a folder that all machines share; it outlives the session that made it.

    ``measure``: euclidean, or cosine of vectors scaled to norm 1. One writer at a time,
    and no reader meanwhile; a write that fails halfway is made good by doing it again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centers").orderBy("list").collect()  # LISTS rows at most
        self.centers = np.array([r["center"] for r in rows])
        self.measure, self.kind = rows[0]["measure"], rows[0]["kind"]
        self._figures()

    @property
    def d(self) -> int:
        return self.centers.shape[1]

    def _figures(self) -> None:
        """Rows and radius of each list; a radius is that of the vectors themselves."""
        self.sizes, self.radii = np.zeros(len(self.centers), dtype=np.int64), np.zeros(len(self.centers))
        for r in self.rows().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect():  # a row for each list
            self.sizes[r["list"]], self.radii[r["list"]] = r["n"], r["gap"]

    def rows(self) -> DataFrame:
        """(id, v, code, scale, slack, gap, list), a partition for each list."""
        return self.spark.read.schema(_ROW.format(self.kind)).parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, path: str, measure: str = "euclidean", lists: int | None = None) -> VectorIndex:
        """An index of rows (id, v), written to the folder; computes at once.

        Rows without id, and vectors that are null, empty, shorter or longer than most,
        not finite, or zero if the measure is the cosine, are left out; of rows of one id
        the greatest vector stays. Centres are fitted on SAMPLE vectors drawn by a hash
        of their id; every row is indexed. ``lists``: the square root of the rows, LISTS at most.
        """
        if measure not in ("euclidean", "cosine"):
            raise ValueError(f"no measure {measure}")
        usable = _usable(rows, measure)
        d = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        if not d:
            raise ValueError("an index needs a vector to begin with")
        usable = stored(usable.where(F.size("v") == d[0]["d"]).groupBy("id").agg(F.max("v").alias("v")))
        n = usable.count()
        lists = max(1, min(LISTS, n, lists or math.isqrt(n)))
        drawn = usable.orderBy(F.xxhash64(F.lit("centres"), "id"), "id").limit(SAMPLE).select("v").toArrow()["v"]
        sample = _scaled(_matrix(drawn, d[0]["d"]), measure)
        kind = usable.schema["id"].dataType.simpleString()
        centers = [(i, c.tolist(), measure, kind) for i, c in enumerate(_fitted(sample, min(lists, len(sample))))]
        spark = rows.sparkSession
        remove(spark, path)
        spark.createDataFrame(centers, "list int, center array<double>, measure string, kind string").coalesce(1).write.parquet(f"{path}/centers")
        coded = _coded(usable, np.array([c[1] for c in centers]), measure, kind)
        _write(coded, path)
        return cls(spark, path)

    def delete(self, ids: DataFrame) -> None:
        """Without the rows of these ids (id); only the lists that hold one are written again."""
        gone = stored(ids.select("id").where("id is not null").distinct())
        hit = [r["list"] for r in self.rows().select("id", "list").join(gone, "id", "left_semi").select("list").distinct().collect()]  # LISTS at most
        if not hit:
            return
        left = stored(self.rows().where(F.col("list").isin(hit)).join(gone, "id", "left_anti"))
        full = {r["list"] for r in left.select("list").distinct().collect()}
        left.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.path}/rows")
        for x in set(hit) - full:
            remove(self.spark, f"{self.path}/rows/list={x}")
        self._figures()

    def upsert(self, rows: DataFrame) -> None:
        """Rows (id, v) in place of those of their ids; unusable ones as in ``build`` only delete."""
        self.delete(rows)
        usable = _usable(rows, self.measure).where(F.size("v") == self.d).groupBy("id").agg(F.max("v").alias("v"))
        _write(_coded(usable, self.centers, self.measure, self.kind), self.path)
        self._figures()

    def get(self, ids: DataFrame) -> DataFrame:
        """(id, v) of these ids (id)."""
        return self.rows().select("id", "v").join(ids.select("id").distinct(), "id", "left_semi")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, rank, id, score): the ``k`` nearest of queries (query, v), ties by id; computes at once.

        With ``probes`` the nearest of so many lists, else of all. The score is the
        distance, or the cosine. Queries that are not of the index's kind of vectors find nothing.
        """
        asked = _usable(queries.select(F.col("query").alias("id"), "v"), self.measure).where(F.size("v") == self.d).select(F.col("id").alias("query"), "v")
        asked = stored(_unit(asked, self.measure, "query"))
        found = stored(self._nearest(asked, self._probed(asked, probes or FIRST), k))
        if probes is None:
            kth = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))
            open_ = asked.join(kth, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
            more = self._nearest(asked, self._probed(open_, None, skip=FIRST), k)
            found = _best(found.unionAll(more), k)
        score = F.when(F.lit(self.measure == "cosine"), 1 - F.col("distance") * F.col("distance") / 2).otherwise(F.col("distance"))
        rank = Window.partitionBy("query").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(rank)).select("query", "rank", "id", score.alias("score"))

    def _probed(self, asked: DataFrame, most: int | None, skip: int = 0) -> DataFrame:
        """(query, v, list): the nearest ``most`` lists, or those from place ``skip`` on that hold a vector within ``reach`` if any."""
        centers, radii, sizes = self.centers, self.radii, self.sizes
        key = asked.schema["query"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    gaps = _gaps(_matrix(b.column("v"), centers.shape[1]), centers)
                    near = np.argsort(gaps, axis=1, kind="stable")
                    take = np.zeros(gaps.shape, dtype=bool)
                    if most is not None:
                        np.put_along_axis(take, near[:, :most], True, axis=1)
                    else:
                        reach = b.column("reach").to_numpy(zero_copy_only=False)
                        np.put_along_axis(take, near[:, skip:], True, axis=1)
                        take &= gaps - radii <= reach[:, None] + 1e-9 * (1 + gaps)
                    row, which = np.nonzero(take & (sizes > 0))
                    picked = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([picked.column("query"), picked.column("v"), pa.array(which, type=pa.int32())], names=["query", "v", "list"])

        return asked.mapInArrow(run, f"query {key}, v array<double>, list int")

    def _nearest(self, asked: DataFrame, probed: DataFrame, k: int) -> DataFrame:
        """(query, id, distance): the nearest of the probed lists, by bounds from the codes and then exactly."""
        probed = stored(probed)
        counts = probed.groupBy("list").agg(F.count(F.lit(1)).alias("asked")).collect()  # a row for each list
        centers, d = self.centers, self.d
        key = probed.schema["query"].dataType.simpleString()
        shares = [(r["list"], max(1, -(-int(self.sizes[r["list"]]) // PIECE)), -(-r["asked"] // ASKED)) for r in counts]
        plan = F.broadcast(self.spark.createDataFrame(shares, "list int, pieces int, groups int"))  # LISTS rows at most
        lists = self.rows().where(F.col("list").isin([s[0] for s in shares])) if shares else self.rows().where(F.lit(False))
        # every piece of a list meets every group of its queries
        codes = lists.select("id", "list", "code", "scale", "slack").join(plan, "list").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        codes = codes.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("pieces", "groups")
        work = probed.join(plan, "list").withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int"))
        work = work.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "groups")

        def run(queries: pa.Table, found: pa.Table) -> pa.Table:
            none = pa.table({"query": queries["query"][:0], "id": found["id"][:0], "list": pa.array([], type=pa.int32()), "low": pa.array([], type=pa.float64()), "high": pa.array([], type=pa.float64())})
            if not queries.num_rows or not found.num_rows:
                return none
            center = centers[found["list"][0].as_py()]
            code = np.frombuffer(b"".join(found["code"].to_pylist()), dtype=np.int8).reshape(-1, d)
            scale, slack = (found[n].to_numpy() for n in ("scale", "slack"))
            near = _gaps(_matrix(queries["v"], d), center + code * scale[:, None])
            # the product form of a distance is rounded by the vectors' size
            blur = 1e-7 * (1 + near + np.abs(center).max(initial=0.0))
            low, high = near - slack - blur, near + slack + blur
            kth = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, min(k, high.shape[1]) - 1]
            row, which = np.nonzero(low <= kth[:, None])
            return pa.table({"query": queries["query"].take(pa.array(row)), "id": found["id"].take(pa.array(which)), "list": pa.array(np.full(len(row), found["list"][0].as_py()), type=pa.int32()), "low": pa.array(low[row, which]), "high": pa.array(high[row, which])})

        met = work.groupBy("list", "piece", "group").cogroup(codes.groupBy("list", "piece", "group")).applyInArrow(run, f"query {key}, id {self.kind}, list int, low double, high double")
        met = stored(met)
        by_high = Window.partitionBy("query").orderBy("high")
        kth = met.withColumn("n", F.row_number().over(by_high)).where(F.col("n") <= k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("high")).otherwise(float("inf")).alias("kth"))
        close = met.join(kth, "query").where("low <= kth").select("query", "id", "list")
        vectors = lists.select("id", "list", "v")
        exact = close.join(_unit(vectors, self.measure, "id", "list"), ["id", "list"]).join(asked.select("query", F.col("v").alias("w")), "query")
        gap = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        return _best(exact.select("query", "id", gap.alias("distance")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).select("query", "id", "distance")


def _usable(rows: DataFrame, measure: str) -> DataFrame:
    v = F.col("v").cast("array<double>")
    fine = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if measure == "cosine":
        fine = fine & F.exists(v, lambda x: x != 0)
    return rows.select("id", v.alias("v")).where(fine)


def _unit(rows: DataFrame, measure: str, *keep: str) -> DataFrame:
    """Vectors of norm 1 where the measure is the cosine."""
    if measure != "cosine":
        return rows.select(*keep, "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(*keep, "v", norm.alias("_norm")).select(*keep, F.transform("v", lambda x: x / F.col("_norm")).alias("v"))


def _scaled(v: np.ndarray, measure: str) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=1))[:, None] if measure == "cosine" else v


def _coded(rows: DataFrame, centers: np.ndarray, measure: str, kind: str) -> DataFrame:
    """Rows (id, v) with their list, code and bounds: ``slack`` is how far code and centre together are from the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = _scaled(_matrix(b.column("v"), centers.shape[1]), measure)
                near = _gaps(v, centers).argmin(axis=1)
                rest = v - centers[near]
                scale = np.abs(rest).max(axis=1) / 127
                code = np.rint(rest / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
                slack = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1))
                gap = np.sqrt((rest**2).sum(axis=1))
                columns = [b.column("id"), pa.array(near, type=pa.int32()), b.column("v"), pa.array([c.tobytes() for c in code], type=pa.binary()), pa.array(scale), pa.array(slack), pa.array(gap)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "list", "v", "code", "scale", "slack", "gap"])

    return rows.select("id", "v").mapInArrow(run, _ROW.format(kind))


def _write(coded: DataFrame, path: str) -> None:
    """A file for each list and task, sorted by id, so that a few ids are found without reading a list."""
    coded.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode("append").partitionBy("list").parquet(f"{path}/rows")
