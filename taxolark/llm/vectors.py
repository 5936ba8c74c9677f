"""Vector columns: which rows take part, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolark.llm.tables import pick


def _takes_part(ids: bool) -> Column:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.col("vec_id").isNotNull() | F.lit(not ids)) & finite & F.exists(v, lambda x: x != 0)


def usable(rows: DataFrame, ids: bool = True) -> DataFrame:
    """(vec_id, v array<double>) of rows (vec_id, embedding) that take part.

    Left out: rows without vec_id if ``ids`` are asked for, and vectors that are null, empty or zero or hold a
    null or non-finite component. Components are doubles from here on.
    """
    return pick(rows, "vec_id", "embedding").where(_takes_part(ids)).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


def unusable(rows: DataFrame, ids: bool = True) -> DataFrame:
    """(vec_id) of the other rows, one for each."""
    return pick(rows, "vec_id", "embedding").where(~F.coalesce(_takes_part(ids), F.lit(False))).select(F.col("vec_id").cast("long"))


def width(found: DataFrame) -> int:
    return found.agg(F.max(F.size("v"))).first()[0] or 0


def largest(found: DataFrame) -> float:
    """The largest absolute component."""
    return found.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()[0] or 0.0


def padded(found: DataFrame, d: int) -> DataFrame:
    """All vectors as long as the longest; shorter ones count as followed by zeros."""
    return found.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v"))))


def same(v: str = "v") -> list:
    """Two columns whose values, 128 bits together, tell different vectors apart."""
    return [F.xxhash64(v).alias("k1"), F.xxhash64(F.lit("again"), F.reverse(v)).alias("k2")]


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.empty((0, d)), *(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in chunks)])


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row divided by the power of two that brings its largest component to between a half and one.

    No cosine changes, not even in its last bit, and no square overflows or vanishes.
    """
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows from q; where squares overflow or vanish, from components over the largest."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = v - q
        out = np.sqrt((gap**2).sum(axis=1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < np.inf)))
        if len(odd):
            most = np.abs(gap[odd]).max(axis=1, initial=0.0)
            inner = np.sqrt(((gap[odd] / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1))
            out[odd] = np.where(np.isinf(most), np.inf, most * inner)
    return out
