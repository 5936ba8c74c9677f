"""Search requests: validation, rewriting, and one function for each query type."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.functions import vector as vf
from taxolark.operators import aggregate as agg
from taxolark.operators import filters as ff
from taxolark.operators.stored import drop, stored

TYPES = tuple("exact fuzzy semantic hybrid faceted graph full_text aggregation".split())


@dataclass(frozen=True)
class Request:
    kind: str
    text: str | None = None
    vector: tuple[float, ...] | None = None
    entity_types: tuple[str, ...] = ()
    filters: tuple[ff.Filter, ...] = ()
    sorts: tuple[ff.Sort, ...] = ()
    aggregations: tuple[agg.Aggregation, ...] = ()
    facets: tuple[agg.Facet, ...] = ()
    window: ff.Page = field(default_factory=ff.Page)
    similarity: float = 0.5
    fuzzy: float = 0.8
    timeout: int = 30


@dataclass(frozen=True)
class Shape:
    """Which columns of a table play which part."""

    key: str
    text: tuple[str, ...]
    kind: str | None = None
    vector: str | None = None


def problems(r: Request) -> list[str]:
    out = ff.problems(r.filters)
    if r.kind not in TYPES:
        out.append(f"query type {r.kind!r} is unknown")
    if r.kind in ("exact", "fuzzy", "full_text") and not (r.text and r.text.strip()):
        out.append(f"{r.kind} search needs a text")
    if r.kind == "semantic" and not (r.vector or (r.text and r.text.strip())):
        out.append("semantic search needs a text or a vector")
    for name, t in (("similarity", r.similarity), ("fuzzy", r.fuzzy)):
        if not 0 <= t <= 1:
            out.append(f"{name} threshold must be within 0 and 1")
    return out


def optimize(r: Request) -> Request:
    """An equal request in normal form.

    Filters, sorts and aggregations occur once; equality and list filters come first,
    then text filters; limits are clamped; the time limit follows the work.
    """
    rank = {"eq": 0, "in": 0, "contains": 1, "starts_with": 1}
    once: dict[tuple, ff.Filter] = {}
    for f in r.filters:
        once.setdefault((f.field, f.operator, str(f.value)), f)
    ordered = sorted(once.values(), key=lambda f: rank.get(f.operator, 2))
    sorts: dict[str, ff.Sort] = {}
    for s in r.sorts:
        sorts.setdefault(s.field, s)
    work = 30 + 10 * (len(ordered) > 5) + 15 * bool(r.aggregations) + 20 * (r.kind in ("semantic", "hybrid", "graph"))
    page = ff.Page(None if r.window.limit is None else min(1000, max(1, r.window.limit)), max(0, r.window.offset))
    return replace(r, filters=tuple(ordered), sorts=tuple(sorts.values()), aggregations=tuple(agg.distinct_requests(r.aggregations)), window=page, timeout=work)


def narrowed(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    df = ff.apply(df, r.filters)
    return df.where(F.col(shape.kind).isin(*r.entity_types)) if r.entity_types and shape.kind else df


def exact(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """Rows of which some text field equals the text, whatever its case; tested before paging."""
    hit = F.exists(F.array(*[F.lower(c) for c in shape.text]), lambda x: x == r.text.lower())
    found = narrowed(df, r, shape).where(hit).withColumn("score", F.lit(1.0))
    return ff.page(ff.order(found, r.sorts, shape.key), r.window)


def fuzzy(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """The best Levenshtein similarity over the text fields; every row is scored, by length first."""
    near = None
    for c in shape.text:
        one = tf.within_similarity(F.col(c), r.text, r.fuzzy) if r.fuzzy > 0 else F.lit(True)
        near = one if near is None else near | one
    parts = [F.coalesce(tf.levenshtein_similarity(F.col(c), F.lit(r.text)), F.lit(0.0)) for c in shape.text]
    score = F.greatest(*parts) if len(parts) > 1 else parts[0]
    found = narrowed(df, r, shape).where(near).withColumn("score", F.round(score, 6))
    return ff.page(found.orderBy(F.desc("score"), shape.key), r.window)


def semantic(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """Cosine with the request's vector (or its text's hashed embedding), at least the threshold."""
    own = F.col(shape.vector) if shape.vector else vf.hashed_embedding(F.concat_ws(" ", *shape.text))
    query = vf.literal(r.vector) if r.vector else vf.hashed_embedding(F.lit(r.text))
    found = narrowed(df, r, shape).withColumn("score", vf.cosine(own, query)).where(F.col("score") >= r.similarity).withColumn("score", F.round("score", 6))
    return ff.page(found.orderBy(F.desc("score"), shape.key), r.window)


def full_text(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """For each word of the text, repeats too: 1 if the row has that word (longer than three), half if it contains it."""
    whole = F.lower(F.concat_ws(" ", *shape.text))
    own = F.array_distinct(tf.words(whole))
    score = F.lit(0.0)
    for w in r.text.lower().split():
        if len(w) > 3:
            score = score + F.when(F.array_contains(own, w), 1.0).otherwise(0.0)
        score = score + F.when(F.contains(whole, F.lit(w)), 0.5).otherwise(0.0)
    found = narrowed(df, r, shape).withColumn("score", score).where("score > 0")
    return ff.page(found.orderBy(F.desc("score"), shape.key), r.window)


def hybrid(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """Half text similarity, half cosine; what reaches the similarity threshold."""
    parts = [F.coalesce(tf.levenshtein_similarity(F.col(c), F.lit(r.text or "")), F.lit(0.0)) for c in shape.text]
    words = F.greatest(*parts) if len(parts) > 1 else parts[0]
    own = F.col(shape.vector) if shape.vector else vf.hashed_embedding(F.concat_ws(" ", *shape.text))
    query = vf.literal(r.vector) if r.vector else vf.hashed_embedding(F.lit(r.text or ""))
    score = 0.5 * words + 0.5 * vf.cosine(own, query, clip=True)
    found = narrowed(df, r, shape).withColumn("score", score).where(F.col("score") >= r.similarity).withColumn("score", F.round("score", 6))
    return ff.page(found.orderBy(F.desc("score"), shape.key), r.window)


def faceted(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """(facet, key, count): all facets of a request over the rows that pass its filters."""
    base, out = narrowed(df, r, shape), None
    for f in r.facets:
        one = agg.facet(base, f).select(F.lit(f.field).alias("facet"), F.col("key").cast("string").alias("key"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def aggregation(df: DataFrame, r: Request, shape: Shape) -> DataFrame:
    """(name, value): the request's ungrouped aggregations; a grouped one by itself gives its groups."""
    base = narrowed(df, r, shape)
    if len(r.aggregations) == 1:
        return agg.aggregate(base, r.aggregations[0])
    out = None
    for a in r.aggregations:
        one = agg.aggregate(base, a).select(F.lit(a.name).alias("name"), F.col(a.name).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


PROCESSORS: dict[str, Callable[[DataFrame, Request, Shape], DataFrame]] = {
    "exact": exact,
    "fuzzy": fuzzy,
    "semantic": semantic,
    "full_text": full_text,
    "hybrid": hybrid,
    "faceted": faceted,
    "aggregation": aggregation,
}


class Engine:
    """Runs requests against a table; further query types can be registered."""

    def __init__(self, df: DataFrame, shape: Shape):
        self.df, self.shape = df, shape
        self.processors = dict(PROCESSORS)

    def register(self, kind: str, processor: Callable[[DataFrame, Request, Shape], DataFrame]) -> None:
        self.processors[kind] = processor

    def supported(self) -> list[str]:
        return sorted(self.processors)

    def run(self, r: Request) -> DataFrame:
        if wrong := problems(r):
            raise ValueError("; ".join(wrong))
        r = optimize(r)
        if r.kind not in self.processors:
            raise ValueError(f"no processor for {r.kind}")
        return self.processors[r.kind](self.df, r, self.shape)

    def matching(self, r: Request) -> DataFrame:
        """All rows that a request matches, whatever its page."""
        return self.run(replace(r, window=ff.Page(None)))

    def by_ids(self, ids: Sequence) -> DataFrame:
        return self.df.where(F.col(self.shape.key).isin(*ids))

    def by_id(self, key) -> DataFrame:
        return self.df.where(F.col(self.shape.key) == key)


# --- the driver: cache, history, API shape -----------------------------------------


class Driver:
    """Runs requests through an engine, keeps results for a while, and records what was asked.

    Results of a request, in normal form, are written once and served again until they
    are ``ttl`` seconds old; the oldest of more than ``keep`` are dropped. ``clock`` gives
    the time in seconds. The history holds the last ``last`` requests.
    """

    def __init__(self, engine: Engine, ttl: float = 300, keep: int = 100, last: int = 1000, clock: Callable[[], float] = time.time):
        self.engine, self.ttl, self.keep, self.clock = engine, ttl, keep, clock
        self.cache: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.asked: deque[tuple[float, str, str | None, bool, bool, float]] = deque(maxlen=last)

    @staticmethod
    def key(r: Request) -> str:
        return hashlib.sha256(repr(optimize(r)).encode()).hexdigest()

    def run(self, r: Request) -> DataFrame:
        """The result; an error is recorded and raised."""
        began, key = self.clock(), self.key(r)
        made, df = self.cache.get(key, (0.0, None))
        hit = df is not None and began - made <= self.ttl
        try:
            if not hit:
                if df is not None:
                    self._forget(key)
                df = stored(self.engine.run(r))
                self.cache[key] = (began, df)
                while len(self.cache) > self.keep:
                    self._forget(next(iter(self.cache)))
        except Exception:
            self.asked.append((began, r.kind, r.text, False, False, 1000 * (self.clock() - began)))
            raise
        self.asked.append((began, r.kind, r.text, True, hit, 1000 * (self.clock() - began)))
        return df

    def _forget(self, key: str) -> None:
        drop(self.cache.pop(key)[1])

    def history(self) -> DataFrame:
        """(at, kind, text, success, cached, took_ms), one row for each request."""
        return self.engine.df.sparkSession.createDataFrame(list(self.asked), "at double, kind string, text string, success boolean, cached boolean, took_ms double")


def api_shape(results: DataFrame, shape: Shape, fields: Sequence[str] = ()) -> DataFrame:
    """(id, entity_type, score, data): results as an API gives them, ``data`` as JSON of the named fields, nulls left out."""
    kind = F.col(shape.kind).cast("string") if shape.kind else F.lit(None).cast("string")
    score = F.col("score").cast("double") if "score" in results.columns else F.lit(1.0)
    own = [F.col(c) for c in (fields or [c for c in results.columns if c not in ("score", shape.key)])]
    return results.select(F.col(shape.key).cast("string").alias("id"), kind.alias("entity_type"), score.alias("score"), F.to_json(F.struct(*own)).alias("data"))


def api_response(engine: Engine, request: Request, fields: Sequence[str] = ()) -> DataFrame:
    """One row (success, total, response): an answer of an API.

    The response holds the request's page; the total is that of all rows that match it.
    """
    page = api_shape(engine.run(request), engine.shape, fields)
    every = engine.matching(request).agg(F.count(F.lit(1)).alias("total"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "id", "entity_type", "score", "data")))
    one = page.agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["entity_type"].alias("entity_type"), x["score"].alias("score"), x["data"].alias("data"))).alias("results"))
    return one.crossJoin(F.broadcast(every)).select(F.lit(True).alias("success"), "total", F.to_json(F.struct(F.lit(request.kind).alias("query_type"), "total", "results")).alias("response"))


# --- history ----------------------------------------------------------------------


def suggestions(history: DataFrame, partial: str, text: str = "text", at: str = "at", success: str = "success", last: int = 100, limit: int = 10) -> DataFrame:
    """(text, place): distinct texts of the last successful queries that contain the partial one, earliest place first."""
    recent = history.where(F.col(success)).orderBy(F.desc(at), text).limit(last)
    place = F.instr(F.lower(text), partial.lower())
    return recent.select(F.col(text).alias("text"), place.alias("place")).where("place > 0").groupBy("text").agg(F.min("place").alias("place")).orderBy("place", "text").limit(limit)


def query_metrics(history: DataFrame, kind: str, took: str, success: Column) -> DataFrame:
    """(kind, total, success_rate, mean_ms): by type, the mean over times that are not 0."""
    return history.groupBy(F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(success.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(F.col(took) != 0, F.col(took))), 6).alias("mean_ms")
    )


def last_n(df: DataFrame, n: int, at: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The last rows by time, in all or of each group."""
    if not by:
        return df.orderBy(F.desc(at), F.desc(tie)).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


# --- the history of a table's own queries, full text with idf ----------------------


def bm25(df: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75, limit: int = 10) -> DataFrame:
    """(key, score): BM25 over all rows; only the query's words are kept of each text."""
    terms = sorted(set(query.lower().split()))
    own = df.select(key, tf.words(F.lower(F.col(text))).alias("own")).withColumn("size", F.size("own"))
    whole = own.agg(F.avg("size").alias("mean"), F.count(F.lit(1)).alias("docs"))
    hits = own.select(key, "size", F.explode(F.filter("own", lambda w: w.isin(*terms))).alias("word")).groupBy(key, "size", "word").agg(F.count(F.lit(1)).alias("tf"))
    spread = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(spread, "word").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)
