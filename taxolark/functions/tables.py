"""Table functions and aggregates of the library's own, in Arrow, callable from SQL once registered."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREAKS = "key string, kind string, first timestamp_ntz, last timestamp_ntz, n long"
STATE = "struct<at: double, total: double>"


class Streaks:
    """Rows in a row of one kind, of a table (key, kind, at) that is partitioned by key and ordered; batches follow each other.

    ``SELECT * FROM streaks(TABLE(t) PARTITION BY key ORDER BY at)``. Null kinds are a kind.
    """

    def __init__(self):
        self.open = None  # key, kind, first, last, n

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        out = []
        for key, kind, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if self.open is not None and self.open[1] == kind:
                self.open = (*self.open[:3], at, self.open[4] + 1)
                continue
            if self.open is not None:
                out.append(self.open)
            self.open = (key, kind, at, at, 1)
        if out:
            yield self._table(out)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield self._table([self.open])

    @staticmethod
    def _table(rows: list[tuple]) -> pa.Table:
        kinds = (pa.string(), pa.string(), pa.timestamp("us"), pa.timestamp("us"), pa.int64())
        return pa.table({n: pa.array([r[i] for r in rows], type=k) for i, (n, k) in enumerate(zip(("key", "kind", "first", "last", "n"), kinds, strict=True))})


def faded(at: np.ndarray, total: np.ndarray, half_life: float) -> tuple[float, float] | None:
    """Totals of several times brought to the latest one and added up."""
    if not len(at):
        return None
    last = float(at.max())
    return last, float((total * np.exp2((at - last) / half_life)).sum())


def _floats(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def register(spark: SparkSession, half_life: float = 86_400.0) -> None:
    """Makes ``streaks``, ``decayed``, ``decayed_merge`` and ``decayed_total`` callable from SQL in a session.

    ``decayed(value, at)`` is an aggregate: values that halve every ``half_life`` seconds,
    as they stand at the group's latest time ``at``; its result (at, total) can be
    aggregated again by ``decayed_merge``, whose result is the same however rows were
    grouped before. ``decayed_total(state, at)`` gives a state's total at a later time.
    Rows with a null count nothing; a group without others gives null.
    """

    @F.arrow_udf(STATE)
    def decayed(value: pa.Array, at: pa.Array) -> dict:
        v, t = _floats(value), _floats(at)
        fine = ~(np.isnan(v) | np.isnan(t))
        found = faded(t[fine], v[fine], half_life)
        return None if found is None else {"at": found[0], "total": found[1]}

    @F.arrow_udf(STATE)
    def decayed_merge(state: pa.Array) -> dict:
        t, v = (_floats(state.field(n)) for n in ("at", "total"))
        fine = np.array(state.is_valid()) & ~np.isnan(t)
        found = faded(t[fine], v[fine], half_life)
        return None if found is None else {"at": found[0], "total": found[1]}

    @F.arrow_udf("double")
    def decayed_total(state: pa.Array, at: pa.Array) -> pa.Array:
        t, v = (_floats(state.field(n)) for n in ("at", "total"))
        return pa.array(v * np.exp2((t - _floats(at)) / half_life), from_pandas=True)

    for f in (decayed, decayed_merge, decayed_total):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("streaks", F.arrow_udtf(Streaks, returnType=STREAKS))


def decayed(rows: DataFrame, by: Sequence[str], value: str, at: str, half_life: float = 86_400.0) -> DataFrame:
    """(by, at, total): the aggregate ``decayed`` of each group, of rows whose ``at`` counts seconds.

    A task first makes a state of each group in each of its batches, so that a group of
    any size is sent, and merged in one place, as few small states.
    """
    groups = [f"g{i}" for i in range(len(by))]
    own = rows.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(value).cast("double").alias("v"), F.col(at).cast("double").alias("t")).where("v is not null and t is not null")
    kinds = ", ".join(f"{g} {own.schema[g].dataType.simpleString()}" for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b]).append_column("row", pa.array(np.arange(b.num_rows)))
            found = table.group_by(groups).aggregate([("row", "list")])
            v, t = _floats(b.column("v")), _floats(b.column("t"))
            states = [faded(t[i], v[i], half_life) for i in (np.array(x) for x in found["row_list"].to_pylist())]
            columns = [found[g].combine_chunks() for g in groups]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s[0] for s in states], type=pa.float64()), pa.array([s[1] for s in states], type=pa.float64())], names=[*groups, "at", "total"])

    parts = own.mapInArrow(run, f"{kinds}, at double, total double")
    last = F.max("at")
    merged = parts.groupBy(*groups).agg(last.alias("at"), F.collect_list(F.struct("at", "total")).alias("states"))
    faded_ = F.aggregate("states", F.lit(0.0), lambda s, x: s + x["total"] * F.exp((x["at"] - F.col("at")) * F.lit(math.log(2) / half_life)))
    return merged.select(*[F.col(g).alias(c) for c, g in zip(by, groups, strict=True)], "at", faded_.alias("total"))
