"""Figures of any stretch of days from small sketches of each day, and aggregations over several groupings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, which bounds the rank error at about 1.33 %; bits of a distinct sketch, whose standard error is about 0.8 %.
QUANTILES, DISTINCT = 200, 14


def daily(rows: DataFrame, at: str, by: Sequence[str], value: str, item: str) -> DataFrame:
    """(by, day, n, total, quantiles, items): a row for each group and day.

    ``quantiles`` is a mergeable sketch of the values, ``items`` one of the distinct
    items, as text. Rows without a time belong to no day; null values and items aren't
    counted in the sketches. A sketch's size doesn't grow with its rows, and Spark makes
    partial ones before it sends them, so a large group is no burden.
    """
    v = F.col(value).cast("double")
    return rows.where(F.col(at).isNotNull()).groupBy(*by, F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, QUANTILES).alias("quantiles"), F.hll_sketch_agg(F.col(item).cast("string"), DISTINCT).alias("items")
    )


def over(days: DataFrame, by: Sequence[str], first: str | None = None, last: str | None = None, ranks: Sequence[float] = (0.5,)) -> DataFrame:
    """(by, n, mean, quantiles, items) of the days from first to last, both included: no row of those days is read again.

    ``quantiles`` are estimates of the values at the ranks, ``items`` of the distinct ones.
    ``n`` counts rows, the mean is of values; without any, it and the quantiles are null.
    """
    if first is not None:
        days = days.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last).cast("date"))
    merged = days.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("quantiles").alias("q"), F.hll_union_agg("items").alias("i"))
    values = F.kll_sketch_get_n_double("q")
    mean = F.when(values > 0, F.col("total") / values).otherwise(F.col("total"))
    found = F.when(values > 0, F.array(*[F.kll_sketch_get_quantile_double("q", F.lit(float(r))) for r in ranks]))
    return merged.select(*by, "n", mean.alias("mean"), found.alias("quantiles"), F.hll_sketch_estimate("i").alias("items"))


def within(found: DataFrame, rows: DataFrame, by: Sequence[str], value: str, item: str, ranks: Sequence[float] = (0.5,), rank_error: float = 0.03, item_error: float = 0.05) -> DataFrame:
    """(by, n, mean, quantiles, items, quantiles_near, items_near): figures from ``over`` held against the rows that they are of.

    A quantile is near if it lies between the exact ones of its rank less and plus
    ``rank_error``, ends included, which the numbers of values below it and up to it tell:
    values are neither sorted nor kept. The figures, a row for each group, are broadcast.
    Distinct items are counted apart, as all that is aggregated beside them would be kept
    for each item. Null and NaN aren't values; where there are none, nothing is far.
    """
    v, keys = F.col(value).cast("double"), [f"_by{i}" for i in range(len(by))]
    v = F.when(~F.isnan(v), v)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        on = F.lit(True)
        for b, k in zip(by, keys, strict=True):
            on = on & F.col(b).eqNullSafe(F.col(k))
        return left.join(F.broadcast(right.withColumnsRenamed(dict(zip(by, keys, strict=True)))), on).drop(*keys)

    counts, near = [F.count(v).alias("_n")], F.lit(True)
    for i, r in enumerate(ranks):
        q = F.col("_q")[i]
        counts += [F.count_if(v <= q).alias(f"_to{i}"), F.count_if(v < q).alias(f"_under{i}")]
        near = near & (F.col(f"_to{i}") >= F.greatest(F.lit(1.0), F.col("_n") * max(0.0, r - rank_error))) & (F.col(f"_under{i}") < F.col("_n") * min(1.0, r + rank_error))
    counted = joined(rows.select(*by, value), found.select(*by, F.col("quantiles").alias("_q"))).groupBy(*by).agg(*counts)
    distinct = rows.groupBy(*by).agg(F.count_distinct(item).alias("_items"))
    far = F.abs(F.col("items") - F.col("_items")) > F.col("_items") * item_error
    return joined(joined(found, counted), distinct).select(*found.columns, ((F.col("_n") == 0) | near).alias("quantiles_near"), (~far).alias("items_near"))


def rank_of(days: DataFrame, by: Sequence[str], value: float) -> DataFrame:
    """(by, rank): the share of values up to one, over all the days given."""
    merged = days.groupBy(*by).agg(F.kll_merge_agg_double("quantiles").alias("q"))
    return merged.select(*by, F.kll_sketch_get_rank_double("q", F.lit(float(value))).alias("rank"))


def cube(rows: DataFrame, by: Sequence[str], **measures: Column) -> DataFrame:
    """(by, level, measures): aggregations for every subset of the columns; a column outside the subset is null.

    ``level`` has a bit for each column, the first the highest, set where it is left out,
    which tells a null of the data from one that stands for all.
    """
    return rows.cube(*by).agg(F.grouping_id().alias("level"), *[m.alias(n) for n, m in measures.items()])


def grouping_sets(rows: DataFrame, sets: Sequence[Sequence[str]], **measures: Column) -> DataFrame:
    """The same for given groupings only; an empty one gives the total."""
    by = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.grouping_id().alias("level"), *[m.alias(n) for n, m in measures.items()])
