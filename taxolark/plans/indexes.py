"""Joins as of a time, stored indexes of vectors, texts and completions, joins by edit distance, sketches, cubes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taxolark.functions import tables
from taxolark.operators import asof, editjoin, sketches
from taxolark.operators.completions import Completions
from taxolark.operators.stored import folder as shared
from taxolark.operators.textindex import TextIndex
from taxolark.operators.vectorindex import VectorIndex
from taxolark.plans.registry import TERMS_SQL, query, read, terms
from taxolark.streaming import stateful, streams


def _place(spark, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


# --- as of a time ------------------------------------------------------------------------------------


@query(
    """WITH versions AS (SELECT event_type AS from_term, ts AS valid_from, max(event_id) AS version FROM events WHERE value > 150 GROUP BY 1, 2)
       SELECT event_id, 'v' || version AS mapped FROM events e ASOF LEFT JOIN versions v ON event_type = from_term AND ts >= valid_from"""
)
def versions_as_of(spark, folder):
    """Each event with the version of its term's mapping that was known at its time; a large event makes a new version."""
    e = read(spark, folder, "events")
    versions = e.where("value > 150").select(F.col("event_type").alias("from_term"), F.col("ts").alias("valid_from"), F.col("event_id").alias("version"))
    asked = e.select("event_id", F.col("event_type").alias("from_term"), "ts")
    found = asof.as_of(asked, versions, "ts", "valid_from", by=["from_term"], take=["version"], tie=["version"])
    return found.select("event_id", F.concat(F.lit("v"), F.col("version").cast("string")).alias("mapped"))


@query(
    """WITH p AS (SELECT user_id, ts AS at, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
       SELECT e.event_id, CASE WHEN p.at < e.ts + INTERVAL 1 DAY THEN p.event_id END AS bought FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts < p.at WHERE e.event_type = 'view'"""
)
def next_purchase(spark, folder):
    """Each view with the same user's next purchase after it, if that is within a day."""
    e = read(spark, folder, "events")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("bought"))
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    soon = F.col("at") < F.col("ts") + F.expr("INTERVAL 1 DAY")
    return asof.as_of(views, p, "ts", "at", by=["user_id"], take=["bought"], tie=["bought"], forward=True, exact=False, within=soon).select("event_id", "bought")


# --- vectors -----------------------------------------------------------------------------------------

_SQUARES = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query(
    f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT a.id AS query, b.id, sqrt({_SQUARES}) AS distance FROM e a, e b WHERE a.id % 100 = 0)
        SELECT query, rank, id, round(distance, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id)::INT AS rank FROM m) WHERE rank <= 10"""
)
def vector_index_search(spark, folder):
    """The certain ten nearest by a stored index."""
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex.build(rows, _place(spark, "vectors"))
    found = index.search(rows.where("id % 100 = 0").select(F.col("id").alias("query"), "v"), 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH e AS (SELECT vec_id AS id, CASE WHEN label = 3 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE label <> 5),
        m AS (SELECT a.id AS query, b.id, {_COSINE} AS score FROM e a, e b WHERE a.id % 100 = 0)
        SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 5"""
)
def vector_index_changed(spark, folder):
    """Nearest by cosine after vectors of one label were turned round and those of another deleted."""
    e = read(spark, folder, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex.build(rows, path := _place(spark, "vectors"), "cosine")
    index.upsert(e.where("label = 3").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: -x).alias("v")))
    index.delete(e.where("label = 5").select(F.col("vec_id").alias("id")))
    again = VectorIndex(spark, path)
    asked = again.rows().where("id % 100 = 0").select(F.col("id").alias("query"), "v")
    return again.search(asked, 5).select("query", "id")


# --- texts -------------------------------------------------------------------------------------------


def _bm25_sql(docs: str, words: tuple[str, ...]) -> str:
    return f"""WITH own AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM {docs}), whole AS (SELECT avg(len(w)) AS mean, count(*) AS docs FROM own),
        hits AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM own) WHERE word IN ({', '.join(f"'{w}'" for w in words)}) GROUP BY 1, 2, 3),
        df AS (SELECT word, count(*) AS df FROM hits GROUP BY 1)
        SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
        FROM hits JOIN df USING (word), whole GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


@query(_bm25_sql("documents", ("token", "password", "license,", "the")))
def text_index_search(spark, folder):
    """The best documents by BM25 from a stored index."""
    index = TextIndex.build(read(spark, folder, "documents"), "doc_id", "text", _place(spark, "texts"))
    return index.search("the token password license,").withColumnRenamed("key", "doc_id")


@query(_bm25_sql("(SELECT doc_id, CASE WHEN lang = 'de' THEN upper(source) || ' the der' ELSE text END AS text FROM documents WHERE lang <> 'fr')", ("der", "the")))
def text_index_changed(spark, folder):
    """The same after documents of one language were replaced and those of another removed, and all segments merged."""
    docs = read(spark, folder, "documents")
    index = TextIndex.build(docs, "doc_id", "text", path := _place(spark, "texts"))
    index.add(docs.where("lang = 'de'").select("doc_id", F.concat(F.upper("source"), F.lit(" the der")).alias("text")), "doc_id", "text")
    index.remove(docs.where("lang = 'fr'").select(F.col("doc_id").alias("key")))
    index.merge()
    return TextIndex(spark, path).search("der the").withColumnRenamed("key", "doc_id")


# --- edit distance -------------------------------------------------------------------------------------


@query(
    f"""WITH {TERMS_SQL}, s AS (SELECT a.term_id AS a, b.term_id AS b, 1 - levenshtein(a.term, b.term) / greatest(length(a.term), length(b.term))::DOUBLE AS score FROM terms a JOIN terms b ON a.term_id < b.term_id)
        SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.6"""
)
def edit_pairs(spark, folder):
    """Terms of a vocabulary that are near each other by edits."""
    return editjoin.near_pairs(terms(spark, folder), "term_id", "term", 0.6)


@query(
    """WITH c AS (SELECT c_custkey AS key, c_name AS name FROM customer), s AS (SELECT s_suppkey AS key, s_name AS name FROM supplier),
       m AS (SELECT lower(c.name) AS value, lower(s.name) AS term, 1 - levenshtein(lower(c.name), lower(s.name)) / greatest(length(c.name), length(s.name))::DOUBLE AS score FROM c, s)
       SELECT value, arg_min(term, (-score, term)) AS term, round(max(score), 6) AS score FROM m WHERE score >= 0.7 GROUP BY 1"""
)
def edit_best_matches(spark, folder):
    """For each customer's name the nearest supplier's: names with a long part that all share."""
    values, names = (read(spark, folder, t).select(F.col(c).alias("text")) for t, c in (("customer", "c_name"), ("supplier", "s_name")))
    return editjoin.best_matches(values, names, 0.7)


# --- completions -----------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT DISTINCT p_name AS text FROM part), q(partial) AS (VALUES ('ol'), ('red w'), ('e'), ('hot rod'), ('zzz'))
       SELECT partial, text FROM (SELECT partial, text, row_number() OVER (PARTITION BY partial ORDER BY NOT starts_with(text, partial), text) AS k FROM t JOIN q ON contains(text, partial)) WHERE k <= 10"""
)
def completion_index(spark, folder):
    """The same suggestions as by a scan, from one partition each."""
    index = Completions.build(read(spark, folder, "part").select(F.col("p_name").alias("text")), _place(spark, "completions"))
    out = None
    for partial in ("OL", "red w", "e", "hot rod", "zzz"):
        one = index.suggest(partial).select(F.lit(partial.lower()).alias("partial"), "text")
        out = one if out is None else out.unionAll(one)
    return out


@query(
    """WITH t AS (SELECT DISTINCT c_name AS text FROM customer WHERE c_mktsegment <> 'BUILDING' UNION SELECT DISTINCT s_name FROM supplier), q(partial) AS (VALUES ('01'), ('r#0'), ('customer#0000000'), ('9'))
       SELECT partial, text, place FROM (SELECT *, row_number() OVER (PARTITION BY partial ORDER BY place, text) AS k FROM (SELECT partial, text, strpos(lower(text), partial)::INT AS place FROM t, q) WHERE place > 0) WHERE k <= 10"""
)
def completion_index_changed(spark, folder):
    """After some texts were added and others removed."""
    c = read(spark, folder, "customer")
    index = Completions.build(c.select(F.col("c_name").alias("text")), _place(spark, "completions"), begins=False)
    index.add(read(spark, folder, "supplier").select(F.col("s_name").alias("text")))
    index.remove(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("text")))
    out = None
    for partial in ("01", "r#0", "customer#0000000", "9"):
        one = index.suggest(partial).select(F.lit(partial).alias("partial"), "text", "place")
        out = one if out is None else out.unionAll(one)
    return out


# --- sketches and groupings --------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT * FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
       SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, true AS quantiles_near, true AS users_near FROM e GROUP BY 1"""
)
def daily_sketches(spark, folder):
    """Figures of a stretch of days from stored sketches, and whether the estimates lie within their bounds of the exact ones."""
    e = read(spark, folder, "events")
    sketches.daily(e, "ts", ["event_type"], "value", "user_id").write.parquet(path := _place(spark, "sketches"))
    ranks = (0.1, 0.5, 0.9)
    found = sketches.over(spark.read.parquet(path), ["event_type"], "2024-01-05", "2024-01-20", ranks)
    own = e.where("to_date(ts) between date'2024-01-05' and date'2024-01-20'")
    held = sketches.within(found, own, ["event_type"], "value", "user_id", ranks)
    return held.select("event_type", "n", F.round("mean", 6).alias("mean"), "quantiles_near", F.col("items_near").alias("users_near"))


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def facet_cube(spark, folder):
    found = sketches.cube(read(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), quantity=F.round(F.sum("l_quantity"), 2))
    return found.withColumn("level", F.col("level").cast("long"))


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n, max(o_totalprice) AS dearest FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def facet_grouping_sets(spark, folder):
    found = sketches.grouping_sets(read(spark, folder, "orders"), [["o_orderstatus"], ["o_orderpriority"], []], n=F.count(F.lit(1)), dearest=F.max("o_totalprice"))
    return found.withColumn("level", F.col("level").cast("long"))


# --- table functions, aggregates, state ----------------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS key, event_type AS kind, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
       SELECT key, kind, min(ts) AS first, max(ts) AS last, count(*) AS n FROM e GROUP BY key, kind, island"""
)
def streak_table(spark, folder):
    """Rows in a row of one kind, by a table function called from SQL."""
    tables.register(spark)
    e = read(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), "event_id")
    return spark.sql("SELECT * FROM streaks(TABLE(SELECT * FROM {e}) PARTITION BY key ORDER BY (at, event_id))", e=e)


@query(
    """WITH e AS (SELECT event_type, user_id, value, epoch(ts) AS sec FROM events), l AS (SELECT event_type, max(sec) AS last FROM e GROUP BY 1)
       SELECT event_type, round(sum(value * power(2.0::DOUBLE, (sec - last) / 86400)), 4) AS total, true AS alike FROM e JOIN l USING (event_type) GROUP BY 1"""
)
def decayed_totals(spark, folder):
    """Values that halve in a day, by an aggregate called from SQL in two steps; in one pass over batches the result is alike."""
    tables.register(spark)
    e = read(spark, folder, "events").select("event_type", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    twice = spark.sql("SELECT event_type, decayed_merge(s).total AS total FROM (SELECT event_type, decayed(value, at) AS s FROM {e} GROUP BY event_type, user_id) GROUP BY event_type", e=e)
    once = tables.decayed(e, ["event_type"], "value", "at").select("event_type", F.col("total").alias("other"))
    alike = F.abs(F.col("total") - F.col("other")) <= 1e-9 * F.abs(F.col("total"))
    return twice.join(once, "event_type").select("event_type", F.round("total", 4).alias("total"), alike.alias("alike"))


@query(
    """WITH first AS (SELECT max(epoch_ms(ts)) AS ms FROM events WHERE event_type <> 'error'), whole AS (SELECT max(epoch_ms(ts)) AS ms FROM events),
       known AS (SELECT e.*, event_type = 'error' AND epoch_ms(ts) < first.ms - 86400000 AS late FROM events e, first),
       gone AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000 AS parts FROM known WHERE NOT late),
       numbered AS (SELECT *, count(*) FILTER (parts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM gone),
       s AS (SELECT user_id::VARCHAR AS key, nth, count(*) AS n, round(sum(value), 4) AS total, max(epoch_ms(ts)) AS last FROM numbered GROUP BY ALL)
       SELECT key, nth, n, total FROM s, whole WHERE last + 7200000 <= ms - 86400000 UNION ALL SELECT user_id::VARCHAR, -1, 1, round(value, 4) FROM known WHERE late"""
)
def stateful_sessions(spark, folder):
    """Sessions of two hours by a processor with state and timers; errors arrive last, and most of them more than a day late."""
    at, e = _place(spark, "sessions"), read(spark, folder, "events")
    e.where("event_type <> 'error'").coalesce(1).write.parquet(f"{at}/in")
    source = streams.read(spark, f"{at}/in", e.schema)
    found = stateful.sessions(source, "user_id", "ts", "value", "event_type", 7_200_000, 86_400_000)
    for rest in (None, e.where("event_type = 'error'")):
        if rest is not None:
            rest.coalesce(1).write.mode("append").parquet(f"{at}/in")
        stateful.start(found, f"{at}/closed", f"{at}/late", f"{at}/checkpoint").awaitTermination()
    both = spark.read.parquet(f"{at}/closed").unionByName(spark.read.parquet(f"{at}/late"))
    return both.select("key", "nth", "n", F.round("total", 4).alias("total"))
