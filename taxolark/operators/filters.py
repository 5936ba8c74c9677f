"""Filter lists, sort lists and pages, compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = tuple("eq ne contains not_contains starts_with ends_with in not_in gt gte lt lte between is_null is_not_null regex".split())
LISTS = ("in", "not_in")
UNARY = ("is_null", "is_not_null")


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None
    case_sensitive: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class Sort:
    field: str
    ascending: bool = True
    nulls: str = "last"
    weight: float = 1.0


@dataclass(frozen=True)
class Page:
    limit: int | None = 100
    offset: int = 0


def problems(filters: Sequence[Filter]) -> list[str]:
    """What is wrong with a filter list, one text for each fault."""
    out = []
    for i, f in enumerate(filters):
        at = f"Filter {i}: "
        if not f.field or not f.field.strip():
            out.append(at + "field is empty")
        if f.operator not in OPERATORS:
            out.append(at + f"operator {f.operator!r} is unknown")
        elif f.operator in UNARY:
            continue
        elif f.value is None:
            out.append(at + f"{f.operator} needs a value")
        elif f.operator in LISTS and not isinstance(f.value, list | tuple | set | frozenset):
            out.append(at + f"{f.operator} needs a list")
        elif f.operator == "between" and not (isinstance(f.value, list | tuple) and len(f.value) == 2):
            out.append(at + "between needs two values")
        elif f.operator == "regex" and not isinstance(f.value, str):
            out.append(at + "regex needs a string")
    return out


def normal(f: Filter) -> Filter:
    """Field trimmed and lower case, weight within 0 and 10, strings lower case unless case counts (patterns keep theirs)."""
    value = f.value
    if not f.case_sensitive and f.operator != "regex":
        if isinstance(value, str):
            value = value.lower()
        elif isinstance(value, list | tuple | set | frozenset):
            value = [v.lower() if isinstance(v, str) else v for v in value]
    return replace(f, field=f.field.strip().lower(), value=value, weight=min(10.0, max(0.0, f.weight)))


def condition(f: Filter, df: DataFrame) -> Column:
    """The filter over a DataFrame's column.

    Null is never equal, contained, matched or compared; it is unequal to every value,
    in no list and contains nothing, so the negated operators let it pass.
    """
    if wrong := problems([f]):
        raise ValueError("; ".join(wrong))
    f = normal(f)
    c, v = df[f.field], f.value
    text = dict(df.dtypes).get(f.field, "string") == "string"
    if text and not f.case_sensitive and f.operator != "regex":
        c = F.lower(c)
    string = c if text else c.cast("string")
    match f.operator:
        case "eq":
            return c == F.lit(v)
        case "ne":
            return ~c.eqNullSafe(F.lit(v))
        case "contains":
            return F.contains(string, F.lit(str(v)))
        case "not_contains":
            return F.coalesce(~F.contains(string, F.lit(str(v))), F.lit(True))
        case "starts_with":
            return F.startswith(string, F.lit(str(v)))
        case "ends_with":
            return F.endswith(string, F.lit(str(v)))
        case "in":
            return c.isin(list(v))
        case "not_in":
            return F.coalesce(~c.isin(list(v)), F.lit(True))
        case "gt":
            return c > F.lit(v)
        case "gte":
            return c >= F.lit(v)
        case "lt":
            return c < F.lit(v)
        case "lte":
            return c <= F.lit(v)
        case "between":
            return c.between(F.lit(v[0]), F.lit(v[1]))
        case "is_null":
            return c.isNull() | (F.trim(string) == "")
        case "is_not_null":
            return c.isNotNull() & (F.trim(string) != "")
        case _:
            return F.rlike(string, F.lit(v if f.case_sensitive else f"(?i){v}"))


def apply(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that pass all filters."""
    for f in filters:
        df = df.where(condition(f, df))
    return df


def boost(df: DataFrame, filters: Sequence[Filter]) -> Column:
    """The sum of the weights of the filters that a row passes."""
    out = F.lit(0.0)
    for f in filters:
        out = out + F.when(condition(f, df), normal(f).weight).otherwise(0.0)
    return out


def order(df: DataFrame, sorts: Sequence[Sort], tie: str) -> DataFrame:
    """Rows by the sort list; a field counts where it comes first; ties by a unique column."""
    keys, seen = [], set()
    for s in [*sorts, Sort(tie)]:
        if s.field in seen:
            continue
        seen.add(s.field)
        c = df[s.field]
        first = s.nulls == "first"
        keys.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if s.ascending else (c.desc_nulls_first() if first else c.desc_nulls_last()))
    return df.orderBy(*keys)


def page(df: DataFrame, p: Page) -> DataFrame:
    """A page of ordered rows: at least one row and at most a thousand, from no negative offset; all rows if the page has no limit."""
    if p.limit is None:
        return df.offset(max(0, p.offset))
    return df.offset(max(0, p.offset)).limit(min(1000, max(1, p.limit)))


@dataclass(frozen=True)
class Table:
    """A fluent selection: conditions, order and page are all honoured when it is built."""

    df: DataFrame
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    window: Page = field(default_factory=Page)

    def where(self, name: str, operator: str, value: Any = None) -> Table:
        return replace(self, filters=(*self.filters, Filter(name, operator, value)))

    def between(self, name: str, lo: Any, hi: Any) -> Table:
        return self.where(name, "between", [lo, hi])

    def sort(self, name: str, ascending: bool = True) -> Table:
        return replace(self, sorts=(*self.sorts, Sort(name, ascending)))

    def page(self, number: int, size: int) -> Table:
        return replace(self, window=Page(size, (number - 1) * size))

    def build(self, tie: str) -> DataFrame:
        return page(order(apply(self.df, self.filters), self.sorts, tie), self.window)
