"""As-of joins: each row with the latest row of another table that was known at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.operators.stored import stored


def as_of(
    left: DataFrame,
    right: DataFrame,
    at: str,
    known: str,
    by: Sequence[str] = (),
    take: Sequence[str] = (),
    tie: Sequence[str] = (),
    forward: bool = False,
    exact: bool = True,
    within: Column | None = None,
) -> DataFrame:
    """``left`` with the columns ``take`` of its last row of ``right`` with ``known`` <= ``at`` and equal ``by``; computes at once.

    ``forward`` looks for the first row with ``known`` >= ``at`` instead; without
    ``exact`` an equal time is no match. Of rows known at the same time the one with the
    greatest ``tie`` counts (the least if ``forward``). ``within`` is a condition on the
    columns of ``left``, ``take`` and ``known`` that the row found must fulfil, such as an
    end of validity; another row isn't looked for. Every row of ``left`` is returned once: with nulls where there
    is no match, as for a null time or a null key. Names in ``take``, and ``known`` if
    ``within`` needs it, must not be columns of ``left``.

    Both tables' rows are dealt by range of key and time together, so a key of any size
    is spread over tasks; within a part the last row of ``right`` is carried on, and
    into a part that goes on with a key the last one of the parts before.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    taken = list(dict.fromkeys([*take, known]))
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    rows = right.select(*named, F.col(known).alias("_t"), F.struct(*(tie or [known])).alias("_tie"), F.struct(*taken).alias("_right"))
    for c in ("_t", *keys):
        rows = rows.where(F.col(c).isNotNull())
    asked = left.select(*named, F.col(at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    # of equal times the lesser side comes first
    both = rows.withColumn("_side", F.lit(0 if exact else 1)).unionByName(asked.withColumn("_side", F.lit(1 if exact else 0)), allowMissingColumns=True)
    time, rank = (F.desc_nulls_first("_t"), F.desc_nulls_first("_tie")) if forward else (F.asc_nulls_first("_t"), F.asc_nulls_first("_tie"))
    order = [time, F.asc("_side"), rank]
    dealt = stored(both.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("_found", F.last("_right", ignorenulls=True).over(upto)).where("_left is not null")
    edge = F.min_by if forward else F.max_by
    ends = dealt.groupBy("_part", *keys).agg(edge("_right", F.when(F.col("_right").isNotNull(), F.struct("_t", "_tie"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_before is not null")
    carried = F.broadcast(carried.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"{k}_") for k in keys], "_before"))  # a part goes on with one key: a row for each part at most
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}_"))
    out = inside.join(carried, same, "left").select("_left.*", F.coalesce("_found", "_before").alias("_hit"))
    if within is not None:
        fits = out.select("*", *[F.col(f"_hit.{c}").alias(c) for c in taken])
        out = fits.select(*left.columns, F.when(within, F.col("_hit")).alias("_hit"))
    return out.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in take])
