"""Filters, searches, pages, aggregations, facets, text functions and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.operators import aggregate as agg
from taxolark.operators import filters as ff
from taxolark.operators import governance, search
from taxolark.plans.registry import query, read

PART = search.Shape(key="p_partkey", text=("p_name",), kind="p_type")
_COLUMNS = ("p_partkey", "p_name", "p_size")


def _filter(name: str, f: ff.Filter, where: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return ff.apply(read(spark, folder, "part"), [f]).select(*_COLUMNS)

    run.__name__ = f"filter_{name}"
    query(f"SELECT {', '.join(_COLUMNS)} FROM part WHERE {where}")(run)


for _name, _f, _where in (
    ("eq", ff.Filter("p_name", "eq", "RED Widget"), "lower(p_name) = 'red widget'"),
    ("ne", ff.Filter("p_name", "ne", "red widget"), "p_name IS DISTINCT FROM 'red widget'"),
    ("contains", ff.Filter("p_name", "contains", "wid"), "contains(lower(p_name), 'wid')"),
    ("not_contains", ff.Filter("p_name", "not_contains", "wid"), "coalesce(NOT contains(lower(p_name), 'wid'), true)"),
    ("starts_with", ff.Filter("p_name", "starts_with", "Blue"), "starts_with(lower(p_name), 'blue')"),
    ("ends_with", ff.Filter("p_name", "ends_with", "ring"), "ends_with(lower(p_name), 'ring')"),
    ("in", ff.Filter("p_name", "in", ["red rod", "OLD bolt"]), "lower(p_name) IN ('red rod', 'old bolt')"),
    ("not_in", ff.Filter("p_name", "not_in", ["red rod", "old bolt"]), "coalesce(lower(p_name) NOT IN ('red rod', 'old bolt'), true)"),
    ("gt", ff.Filter("p_size", "gt", 40), "p_size > 40"),
    ("gte", ff.Filter("p_size", "gte", 40), "p_size >= 40"),
    ("lt", ff.Filter("p_size", "lt", 5), "p_size < 5"),
    ("lte", ff.Filter("p_size", "lte", 5), "p_size <= 5"),
    ("between", ff.Filter("p_size", "between", [10, 12]), "p_size BETWEEN 10 AND 12"),
    ("is_null", ff.Filter("p_name", "is_null"), "p_name IS NULL OR trim(p_name) = ''"),
    ("is_not_null", ff.Filter("p_name", "is_not_null"), "p_name IS NOT NULL AND trim(p_name) <> ''"),
    ("regex", ff.Filter("p_name", "regex", "^(old|new) .*t$"), "regexp_matches(p_name, '(?i)^(old|new) .*t$')"),
):
    _filter(_name, _f, _where)


@query("SELECT p_partkey, p_name, 2.0::DOUBLE * (p_size > 25)::INT + 1.5::DOUBLE * contains(p_name, 'red')::INT AS boost FROM part")
def filter_boost(spark, folder):
    df = read(spark, folder, "part")
    return df.select("p_partkey", "p_name", ff.boost(df, [ff.Filter("p_size", "gt", 25, weight=2.0), ff.Filter("p_name", "contains", "red", weight=1.5)]).alias("boost"))


@query(
    """SELECT p_partkey, p_name, round(1 - levenshtein(lower(p_name), 'red widgit') / greatest(length(p_name), 10)::DOUBLE, 6) AS score FROM part
       WHERE 1 - levenshtein(lower(p_name), 'red widgit') / greatest(length(p_name), 10)::DOUBLE >= 0.8 ORDER BY score DESC, p_partkey LIMIT 1000"""
)
def fuzzy_search(spark, folder):
    r = search.Request("fuzzy", "Red Widgit", fuzzy=0.8, window=ff.Page(1000))
    return search.Engine(read(spark, folder, "part"), PART).run(r).select("p_partkey", "p_name", "score")


@query("SELECT p_partkey, p_name, 1.0::DOUBLE AS score FROM part WHERE lower(p_name) = 'hot rod' AND p_type IN ('PROMO', 'SMALL') ORDER BY p_partkey LIMIT 20 OFFSET 5")
def exact_search(spark, folder):
    r = search.Request("exact", "HOT Rod", entity_types=("PROMO", "SMALL"), window=ff.Page(20, 5))
    return search.Engine(read(spark, folder, "part"), PART).run(r).select("p_partkey", "p_name", "score")


@query("SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_size DESC NULLS LAST, p_brand ASC NULLS LAST, p_partkey LIMIT 100")
def multi_sort_nulls_last(spark, folder):
    return ff.page(ff.order(read(spark, folder, "part"), [ff.Sort("p_size", False), ff.Sort("p_brand")], "p_partkey"), ff.Page(100)).select("p_partkey", "p_size", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 30 ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def paginate(spark, folder):
    t = ff.Table(read(spark, folder, "part")).between("p_size", 5, 30).sort("p_retailprice", ascending=False).page(3, 25)
    return t.build("p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13)")
def entity_by_ids(spark, folder):
    return search.Engine(read(spark, folder, "part"), PART).by_ids([3, 5, 8, 13]).select("p_partkey", "p_name")


# --- aggregations -----------------------------------------------------------------------------


def _aggregation(kind: str, expression: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return agg.aggregate(read(spark, folder, "lineitem"), agg.Aggregation(kind, "l_partkey" if "count" in kind else "l_quantity", group_by=("l_returnflag",)))

    run.__name__ = f"agg_{kind.replace('distinct_count', 'distinct')}"
    query(f"SELECT l_returnflag, {expression} AS value FROM lineitem GROUP BY l_returnflag")(run)


for _kind, _expression in (
    ("count", "count(l_partkey)"),
    ("sum", "sum(l_quantity)"),
    ("min", "min(l_quantity)"),
    ("max", "max(l_quantity)"),
    ("distinct_count", "count(DISTINCT l_partkey)"),
    ("percentile", "quantile_cont(l_quantity, 0.5)"),
):
    _aggregation(_kind, _expression)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY ALL")
def agg_avg(spark, folder):
    a = agg.Aggregation("avg", "l_extendedprice", group_by=("l_returnflag", "l_linestatus"))
    return agg.aggregate(read(spark, folder, "lineitem"), a).withColumn("value", F.round("value", 4))


@query("SELECT l_suppkey, count(l_orderkey) AS value FROM lineitem WHERE l_quantity > 10 GROUP BY 1 HAVING count(l_orderkey) > 450")
def agg_having(spark, folder):
    a = agg.Aggregation("count", "l_orderkey", group_by=("l_suppkey",), filters=(ff.Filter("l_quantity", "gt", 10),), having=(ff.Filter("value", "gt", 450),))
    return agg.aggregate(read(spark, folder, "lineitem"), a)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus)::INT AS whole FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def facet_totals(spark, folder):
    return read(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_linestatus").cast("int").alias("whole"))


@query("SELECT 'total' AS name, count(p_partkey)::DOUBLE AS value FROM part WHERE p_size < 20 UNION ALL SELECT 'largest', max(p_size)::DOUBLE FROM part WHERE p_size < 20")
def aggregation_search(spark, folder):
    r = search.Request("aggregation", filters=(ff.Filter("p_size", "lt", 20),), aggregations=(agg.Aggregation("count", "p_partkey", "total"), agg.Aggregation("max", "p_size", "largest")))
    return search.Engine(read(spark, folder, "part"), PART).run(r)


@query("SELECT p_type AS key, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_terms(spark, folder):
    return agg.facet(read(spark, folder, "part"), agg.Facet("p_type"))


@query(
    """SELECT CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1050 THEN 'middle' ELSE 'high' END AS key, count(*) AS count
       FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY 1 LIMIT 10"""
)
def facet_range(spark, folder):
    f = agg.Facet("p_retailprice", "range", order="key_asc", ranges=(("low", None, 950), ("middle", 950, 1050), ("high", 1050, None)), base=(ff.Filter("p_size", "gt", 10),))
    return agg.facet(read(spark, folder, "part"), f)


@query("SELECT date_trunc('day', ts) AS key, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1 LIMIT 40")
def facet_date_histogram(spark, folder):
    return agg.facet(read(spark, folder, "events"), agg.Facet("ts", "date_histogram", size=40, min_count=2, order="key_asc"))


@query(
    """SELECT * FROM (SELECT 'p_type' AS facet, p_type AS key, count(*) AS count FROM part WHERE p_size < 30 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
       UNION ALL SELECT * FROM (SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_size < 30 GROUP BY 2 ORDER BY 2 DESC LIMIT 5)"""
)
def faceted_search(spark, folder):
    r = search.Request("faceted", filters=(ff.Filter("p_size", "lt", 30),), facets=(agg.Facet("p_type"), agg.Facet("p_brand", size=5, order="key_desc")))
    return search.Engine(read(spark, folder, "part"), PART).run(r)


# --- text ----------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tf.STOP_WORDS)
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"


@query(
    f"""WITH w AS (SELECT unnest(list_filter(list_transform(list_filter({_WORDS}, lambda w: length(w) > 2 AND w NOT IN ({_STOP})), lambda w: trim(w, '.,!?;:"()[]{{}}')), lambda w: w <> '')) AS word FROM documents)
        SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""
)
def keywords_topk(spark, folder):
    return agg.top_keywords(read(spark, folder, "documents"), tf.keywords(F.col("text")), 50)


@query(
    f"""WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        g AS (SELECT item_id, unnest(flatten([list_transform(range(1, len(w) - 1 + 1), lambda i: w[i:i+1]), list_transform(range(1, len(w) - 2 + 1), lambda i: w[i:i+2]), list_transform(range(1, len(w) - 3 + 1), lambda i: w[i:i+3])])) AS g FROM w)
        SELECT DISTINCT item_id, array_to_string(g, ' ') AS phrase FROM g WHERE g[1] NOT IN ({_STOP}) AND g[-1] NOT IN ({_STOP}) AND length(array_to_string(g, ' ')) > 5"""
)
def phrases(spark, folder):
    return read(spark, folder, "benchmark").select("item_id", F.explode(tf.phrases(F.col("text"))).alias("phrase"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s\-.,]', ' ', 'g'), '\.{2,}', '.', 'g'), '\s+', ' ', 'g')) AS clean FROM documents"""
)
def clean_text(spark, folder):
    return read(spark, folder, "documents").select("doc_id", tf.clean_for_embedding(F.col("text")).alias("clean"))


@query(
    """WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part), s AS (SELECT a.p_name AS x, b.p_name AS y, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS score FROM n a JOIN n b ON a.p_name < b.p_name)
       SELECT x, y, round(score, 6) AS score FROM s WHERE score > 0"""
)
def word_jaccard_pairs(spark, folder):
    """All pairs of names that share a word."""
    n = read(spark, folder, "part").select("p_name").distinct()
    word = n.select("p_name", F.explode(F.array_distinct(tf.words(F.lower("p_name")))).alias("w"))
    pairs = word.toDF("x", "w").join(word.toDF("y", "w"), "w").where("x < y").select("x", "y").distinct()
    return pairs.select("x", "y", F.round(tf.word_jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query(
    r"""WITH v AS (SELECT p_partkey, '  ' || upper(p_name) || ' w/ Sz ' || p_size || ' & qty_' || p_brand || ' + clr w/o ' AS raw FROM part),
        s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '\s+', ' ', 'g'),
          'w/(\s|$)', 'with\1', 'g'), 'w/o(\s|$)', 'without\1', 'g'), '\s&\s', ' and ', 'g'), '\s\+\s', ' plus ', 'g'), '\bsz\b', 'size', 'g'), '\bclr\b', 'color', 'g'), '\bqty\b', 'quantity', 'g') AS s FROM v)
        SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(s, '_', ' '), '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM s"""
)
def vocab_normalize(spark, folder):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" w/ Sz "), F.col("p_size"), F.lit(" & qty_"), F.col("p_brand"), F.lit(" + clr w/o "))
    return read(spark, folder, "part").select("p_partkey", tf.normalize_term(raw).alias("norm"))


@query(
    r"""WITH v AS (SELECT p_partkey, p_name || ' ' || p_size || '.5 kg, 20CM x ' || p_size || ' ml and 3 oz' AS raw FROM part),
        u AS (SELECT p_partkey, m, regexp_extract_all(raw, p, 1) AS n, regexp_extract_all(raw, p, 2) AS unit FROM v, (VALUES
          ('weight', '(?i)\b(\d+(?:\.\d+)?)\s*(kg|g|lb|oz|pound|gram|kilogram)\b'), ('length', '(?i)\b(\d+(?:\.\d+)?)\s*(cm|mm|m|in|inch|ft|foot|yard)\b'), ('volume', '(?i)\b(\d+(?:\.\d+)?)\s*(ml|l|liter|oz|gallon|cup)\b')) t(m, p))
        SELECT p_partkey, m AS measure, unnest(n)::DOUBLE AS number, unnest(unit) AS unit FROM u"""
)
def extract_units(spark, folder):
    raw = F.concat("p_name", F.lit(" "), "p_size", F.lit(".5 kg, 20CM x "), "p_size", F.lit(" ml and 3 oz"))
    return read(spark, folder, "part").select("p_partkey", F.explode(tf.extract_units(raw)).alias("u")).select("p_partkey", "u.measure", "u.number", "u.unit")


@query("SELECT p_partkey, regexp_replace(p_name, '(?i)(RED)', '<em>\\1</em>', 'g') AS marked FROM part")
def highlight(spark, folder):
    return read(spark, folder, "part").select("p_partkey", tf.highlight(F.col("p_name"), "RED").alias("marked"))


@query(
    r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || '-Price Value!')), '[\s\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS name,
        CASE lower(p_type) WHEN 'economy' THEN 'cheap' ELSE p_type END AS value FROM part"""
)
def normalize_attributes(spark, folder):
    df = read(spark, folder, "part")
    return df.select("p_partkey", tf.attribute_name(F.concat("p_name", F.lit("-Price Value!"))).alias("name"), tf.attribute_value(F.col("p_type"), "categorical", {"economy": "cheap"}, ["SMALL"]).alias("value"))


_QUERY = ("the", "and", "ation", "thing")


@query(
    f"""WITH t AS (SELECT doc_id, lower(text) AS low, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, {' + '.join([f"0.5::DOUBLE * contains(low, '{q}')::INT" for q in _QUERY] + [f"1.0::DOUBLE * list_contains(w, '{q}')::INT" for q in _QUERY if len(q) > 3])} AS score FROM t)
        SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100"""
)
def doc_search(spark, folder):
    r = search.Request("full_text", " ".join(_QUERY))
    return search.Engine(read(spark, folder, "documents"), search.Shape("doc_id", ("text",))).run(r).select("doc_id", "score")


@query(
    f"""WITH own AS (SELECT doc_id, {_WORDS} AS w FROM documents), whole AS (SELECT avg(len(w)) AS mean, count(*) AS docs FROM own),
        hits AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM own) WHERE word IN ('token', 'password', 'license,') GROUP BY 1, 2, 3),
        df AS (SELECT word, count(*) AS df FROM hits GROUP BY 1)
        SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
        FROM hits JOIN df USING (word), whole GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
)
def bm25(spark, folder):
    return search.bm25(read(spark, folder, "documents"), "doc_id", "text", "token password license,")


# --- history, governance ----------------------------------------------------------------------------


@query(
    """SELECT event_type AS kind, count(*) AS total, round(avg((value < 100)::INT::DOUBLE), 6) AS success_rate, round(avg(value) FILTER (value <> 0), 6) AS mean_ms FROM events GROUP BY 1"""
)
def query_metrics(spark, folder):
    return search.query_metrics(read(spark, folder, "events"), "event_type", "value", F.col("value") < 100)


@query(
    """WITH h AS (SELECT event_type || ' ' || user_id AS text, ts AS at FROM events WHERE event_type <> 'error' ORDER BY ts DESC, text LIMIT 100)
       SELECT text, min(strpos(lower(text), 'c'))::INT AS place FROM h WHERE strpos(lower(text), 'c') > 0 GROUP BY 1 ORDER BY 2, 1 LIMIT 10"""
)
def suggestions(spark, folder):
    h = read(spark, folder, "events").select(F.concat_ws(" ", "event_type", "user_id").alias("text"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("success"))
    return search.suggestions(h, "C")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def last_per_type(spark, folder):
    return search.last_n(read(spark, folder, "events"), 5, "ts", "event_id", ["event_type"]).select("event_type", "event_id")


@query(
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC, event_id DESC) AS down FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100))
       SELECT round(avg(value), 6) AS mean, round(max(value) FILTER (down = 5), 6) AS p95, count(*) AS n FROM r"""
)
def latency_p95(spark, folder):
    return governance.latency(read(spark, folder, "events"), "value", "ts", "event_id")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_filter(spark, folder):
    log = read(spark, folder, "events").select(F.col("ts").alias("at"), F.col("user_id").alias("user"), F.col("event_type").alias("action"), F.col("event_id").alias("entry_id"))
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return governance.audit(log, action="purchase", start=start, limit=50).select(F.col("entry_id").alias("event_id"), F.col("user").alias("user_id"), F.col("at").alias("ts"))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(avg((event_type = 'error')::INT::DOUBLE), 6) AS error_rate FROM events GROUP BY 1")
def quality_trend(spark, folder):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return read(spark, folder, "events").groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


@query(
    """WITH m AS (SELECT date_trunc('hour', ts) AS "at", max(value) AS cpu, avg(value) AS memory, 100 * avg((event_type = 'error')::INT::DOUBLE) AS error_rate FROM events GROUP BY 1)
       SELECT "at", 'critical' AS severity, 'cpu' AS title FROM m WHERE cpu > 90 UNION ALL SELECT "at", 'critical', 'memory' FROM m WHERE memory > 90 UNION ALL SELECT "at", 'high', 'error_rate' FROM m WHERE error_rate > 10"""
)
def alerts(spark, folder):
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at")
    m = read(spark, folder, "events").groupBy(at).agg(F.max("value").alias("cpu"), F.avg("value").alias("memory"), (100 * F.avg((F.col("event_type") == "error").cast("double"))).alias("error_rate"))
    return governance.alerts(m)


@query(
    """WITH i AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'completed' END AS status, value / 500 AS quality FROM events)
       SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
       round(100 * count(*) FILTER (status = 'completed') / count(*)::DOUBLE, 6) AS success_rate, round(avg(quality), 6) AS mean_quality FROM i"""
)
def ingestion_stats(spark, folder):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("completed")
    return governance.ingestion_stats(read(spark, folder, "events").select(status.alias("status"), (F.col("value") / 500).alias("quality")))


@query("SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def union_counts(spark, folder):
    return agg.table_counts({t: read(spark, folder, t) for t in ("part", "orders", "events")})
