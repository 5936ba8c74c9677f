"""Aggregations and facets asked for by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.operators import filters as ff

KINDS = tuple("count sum avg min max distinct_count group_by percentile".split())


@dataclass(frozen=True)
class Aggregation:
    kind: str
    field: str | None = None
    name: str = "value"
    group_by: tuple[str, ...] = ()
    filters: tuple[ff.Filter, ...] = ()
    having: tuple[ff.Filter, ...] = ()
    percentile: float = 0.5


@dataclass(frozen=True)
class Facet:
    field: str
    kind: str = "terms"
    size: int = 10
    min_count: int = 1
    order: str = "count_desc"
    ranges: tuple[tuple[str, float | None, float | None], ...] = ()
    interval: str = "day"
    base: tuple[ff.Filter, ...] = field(default=())


def _measure(a: Aggregation) -> Column:
    c = F.col(a.field) if a.field else None
    match a.kind:
        case "count" | "group_by":
            return F.count(c if c is not None else F.lit(1))
        case "sum":
            return F.sum(c)
        case "avg":
            return F.avg(c)
        case "min":
            return F.min(c)
        case "max":
            return F.max(c)
        case "distinct_count":
            return F.count_distinct(c)
        case "percentile":
            return F.percentile(c, F.lit(a.percentile))
        case _:
            raise ValueError(f"aggregation {a.kind!r} is unknown")


def distinct_requests(requests: Sequence[Aggregation]) -> list[Aggregation]:
    """Each request once; requests that differ in filters or conditions stay apart."""
    out: list[Aggregation] = []
    for r in requests:
        if r not in out:
            out.append(r)
    return out


def aggregate(df: DataFrame, a: Aggregation) -> DataFrame:
    """Filter, group, measure, then conditions on the groups."""
    grouped = ff.apply(df, a.filters).groupBy(*a.group_by).agg(_measure(a).alias(a.name))
    return ff.apply(grouped, a.having)


def facet(df: DataFrame, f: Facet) -> DataFrame:
    """(key, count): values, ranges or time steps of a field, with their number of rows."""
    df = ff.apply(df, f.base)
    c = F.col(f.field)
    if f.kind == "terms":
        key = c
    elif f.kind == "range":
        key = None
        for name, lo, hi in f.ranges:
            inside = (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c < hi)
            key = F.when(inside, name) if key is None else key.when(inside, name)
    elif f.kind == "date_histogram":
        key = F.date_trunc(f.interval, c).cast("timestamp_ntz")
    else:
        raise ValueError(f"facet {f.kind!r} is unknown")
    counted = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= f.min_count)
    by, up = f.order.rsplit("_", 1)
    first = F.col("count" if by == "count" else "key")
    return counted.orderBy(first.asc() if up == "asc" else first.desc(), F.col("key").asc()).limit(f.size)


def top_keywords(df: DataFrame, words: Column, n: int) -> DataFrame:
    """(word, n): the most frequent words, ties by word."""
    own = df.select(F.explode(words).alias("word"))
    return own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): rows of each table, one row for each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def column_values(value: Any) -> Any:
    return list(value) if isinstance(value, set | frozenset) else value


def document_stats(docs: DataFrame, kind: str, text: str, at: str) -> DataFrame:
    """(kind, documents, sections, words, updated): by kind; a section is a line that isn't blank; null texts have none."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    words = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    return docs.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(lines)).alias("sections"), F.sum(words).alias("words"), F.max(at).alias("updated"))


def frames(df: DataFrame, by: str, order: Sequence[str], value: str, tiles: int = 4) -> DataFrame:
    """The rows with, in their group's order: ``previous`` and ``next`` value, ``tile``, ``running`` sum, ``moving`` mean of three rows, ``share`` of the group's sum."""
    w = Window.partitionBy(by).orderBy(*order)
    group = Window.partitionBy(by)
    return df.withColumns(
        {
            "previous": F.lag(value).over(w),
            "next": F.lead(value).over(w),
            "tile": F.ntile(tiles).over(w),
            "running": F.round(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 6),
            "moving": F.round(F.avg(value).over(w.rowsBetween(-1, 1)), 6),
            "share": F.round(F.col(value) / F.sum(value).over(group), 6),
        }
    )
