"""Candidates, enrichment and search strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolark.operators import pipeline, quality, relations, semantic
from taxolark.plans.registry import EDGES_SQL, TREE_SQL, edges, query, read, tree
from taxolark.sources.packs import pack

_CANDIDATES = "cand AS (SELECT p_partkey AS term_id, upper(p_name) AS term, p_name AS normalized_term, p_type AS domain, p_retailprice AS score, p_size AS frequency FROM part)"


def _candidates(spark, folder):
    p = read(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("term_id"), F.upper("p_name").alias("term"), F.col("p_name").alias("normalized_term"), F.col("p_type").alias("domain"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("frequency"))


@query(f"WITH {_CANDIDATES} SELECT term_id, term, score FROM cand WHERE (contains(lower(term), 'gizmo') OR contains(normalized_term, 'gizmo')) AND domain = 'PROMO' ORDER BY score DESC, frequency DESC, term LIMIT 20")
def search_candidates(spark, folder):
    return semantic.search_candidates(_candidates(spark, folder), "Gizmo", "PROMO", 20).select("term_id", "term", "score")


@query("SELECT p_partkey, upper(p_name) || ' ' || p_name || ' ' || p_brand_plain || ' ' || p_type AS text FROM (SELECT *, replace(p_brand, '#', ' ') AS p_brand_plain FROM part)")
def candidate_text(spark, folder):
    return read(spark, folder, "part").select("p_partkey", semantic.candidate_text(F.upper("p_name"), F.col("p_name"), F.array("p_brand", "p_type")).alias("text"))


@query("SELECT p_partkey, 'p_name: ' || p_name || ' p_type: ' || p_type AS text FROM part")
def result_text(spark, folder):
    p = read(spark, folder, "part")
    return p.select("p_partkey", semantic.result_text(p, ["p_name", "p_type"]).alias("text"))


@query(f"WITH {_CANDIDATES} SELECT a.term_id AS source, b.term_id AS target, 'variant' AS relation, 0.5::DOUBLE AS strength FROM cand a, cand b WHERE a.normalized_term = 'red rod' AND b.normalized_term = 'blue rod'")
def link_terms(spark, folder):
    pairs = spark.createDataFrame([("Red Rod", "BLUE rod", "variant", 0.5)], "from_term string, to_term string, relation string, strength double")
    return semantic.link_by_term(_candidates(spark, folder), pairs)


@query(
    f"""WITH {TREE_SQL}, a AS (SELECT DISTINCT 'n' || c_nationkey AS category_id, c_mktsegment AS attribute FROM customer), v AS (SELECT DISTINCT c_mktsegment AS attribute, substr(c_mktsegment, 1, 3) AS value FROM customer WHERE c_mktsegment <> 'MACHINERY')
        SELECT category_id, attribute, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (value IS NOT NULL)), ','), '') AS listed FROM tree JOIN a USING (category_id) LEFT JOIN v USING (attribute) GROUP BY 1, 2"""
)
def category_attributes(spark, folder):
    c = read(spark, folder, "customer")
    a = c.select(F.concat(F.lit("n"), "c_nationkey").alias("category_id"), F.col("c_mktsegment").alias("attribute")).distinct()
    v = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("attribute"), F.substring("c_mktsegment", 1, 3).alias("value")).distinct()
    return semantic.attributes_of(tree(spark, folder), a, v).select("category_id", "attribute", F.array_join("values", ",").alias("listed"))


_INSIDE = "((length(split_part({1}, ' ', 1)) > 3 AND contains({0}, split_part({1}, ' ', 1))) OR (length(split_part({1}, ' ', 2)) > 3 AND contains({0}, split_part({1}, ' ', 2))))"


@query(
    f"""WITH {EDGES_SQL}, j AS (SELECT source, target, relation, confidence, a.p_name AS x, b.p_name AS y FROM edges JOIN part a ON source = a.p_partkey JOIN part b ON target = b.p_partkey),
        c AS (SELECT source, target, confidence, CASE WHEN relation = 'synonym' THEN 'known' WHEN confidence > 0.9 OR x = y THEN 'synonym' WHEN {_INSIDE.format('x', 'y')} THEN 'hyponym' WHEN {_INSIDE.format('y', 'x')} THEN 'hypernym'
              WHEN confidence > 0.7 THEN 'similar' WHEN confidence > 0.5 THEN 'related' END AS r FROM j),
        every AS (SELECT source, target, CASE r WHEN 'known' THEN 'synonym' ELSE r END AS relation, round(confidence * CASE r WHEN 'hyponym' THEN 0.9::DOUBLE WHEN 'hypernym' THEN 0.9 WHEN 'related' THEN 0.8 ELSE 1 END, 6) AS confidence FROM c WHERE r IS NOT NULL)
        SELECT source, target, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS k FROM every) WHERE k <= 20"""
)
def discover_relationships(spark, folder):
    p = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    e = edges(spark, folder)
    return semantic.discover(p, e.where("relation = 'synonym'"), e.select("source", "target", F.col("confidence").alias("similarity")))


@query(
    f"""WITH {EDGES_SQL}, r AS (SELECT source, count(*) AS n, sum(confidence) AS c FROM edges GROUP BY 1)
        SELECT count(*) AS total, count(vec_id) AS with_embedding, count(source) AS with_relations, round(coalesce(sum(n), 0) / count(*)::DOUBLE, 6) AS mean_relations, round(coalesce(sum(c) / sum(n), 0), 6) AS mean_confidence
        FROM part LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON p_partkey = vec_id LEFT JOIN r ON p_partkey = source"""
)
def data_quality(spark, folder):
    ids = read(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return semantic.data_quality(ids, read(spark, folder, "embeddings").select(F.col("vec_id").alias("entity_id")), edges(spark, folder))


@query("SELECT count(*) AS total, count(*) FILTER (label < 5) AS active, count(*) FILTER (label >= 5) AS inactive FROM embeddings")
def embedding_stats(spark, folder):
    return semantic.embedding_stats(read(spark, folder, "embeddings").select((F.col("label") < 5).alias("is_active")))


@query(
    f"""WITH {EDGES_SQL}, good AS (SELECT DISTINCT source, target FROM edges WHERE relation IN ('synonym', 'similar') AND confidence > 0.6), seeds AS (SELECT p_partkey AS node FROM part ORDER BY p_size DESC, p_partkey LIMIT 10),
        one AS (SELECT DISTINCT target AS node FROM good JOIN seeds ON source = node WHERE target NOT IN (SELECT node FROM seeds)), two AS (SELECT DISTINCT target AS node FROM good JOIN one ON source = node WHERE target NOT IN (SELECT node FROM seeds) AND target NOT IN (SELECT node FROM one)),
        every AS (SELECT node, 0 AS hops FROM seeds UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) SELECT node AS id, hops, 0.5::DOUBLE AS score FROM every ORDER BY hops, node LIMIT 100"""
)
def graph_traversal_search(spark, folder):
    near = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("score"))
    return semantic.graph_search(near, edges(spark, folder))


@query("WITH n AS (SELECT DISTINCT p_name AS text, length(p_name) / 12.0::DOUBLE AS score FROM part), t AS (SELECT * FROM n WHERE score > 0.7 AND NOT contains('red widget please', text) ORDER BY score DESC, text LIMIT 5) SELECT 'red widget please ' || string_agg(text, ' ' ORDER BY score DESC, text) AS query FROM t")
def contextual_expansion(spark, folder):
    near = read(spark, folder, "part").select(F.col("p_name").alias("text"), (F.length("p_name") / 12.0).alias("score")).distinct()
    return semantic.expanded_query("red widget please", near)


@query("SELECT p_partkey AS id, round(p_size * 0.75::DOUBLE + p_retailprice * 0.25::DOUBLE, 6) AS score FROM part ORDER BY 2 DESC, 1 LIMIT 50")
def multi_modal_search(spark, folder):
    p = read(spark, folder, "part")
    return semantic.multi_modal([(p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("score")), 3), (p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), 1)], 50)


@query("SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT) / 2::DOUBLE AS relevance FROM documents")
def domain_relevance(spark, folder):
    return read(spark, folder, "documents").select("doc_id", semantic.domain_relevance(F.col("text"), ["The", "que"]).alias("relevance"))


@query("WITH f AS (SELECT user_id AS id, avg(CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 1.0 END) AS r FROM events GROUP BY 1) SELECT p_partkey AS id, round(p_size / 50::DOUBLE + 0.1::DOUBLE * coalesce(r, 0), 6) AS score FROM part LEFT JOIN f ON p_partkey = id")
def feedback_scores(spark, folder):
    f = read(spark, folder, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", -1.0).otherwise(1.0).alias("rating"))
    return semantic.with_feedback(read(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score")), f)


@query(
    f"""WITH {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS k FROM edges), s AS (SELECT source, string_agg(target::VARCHAR, ',' ORDER BY k) AS listed FROM r WHERE k <= 5 GROUP BY 1)
        SELECT p_partkey AS id, listed AS near_ids FROM part LEFT JOIN s ON p_partkey = source"""
)
def enhance_products(spark, folder):
    e = edges(spark, folder)
    out = semantic.enhance(read(spark, folder, "part").select(F.col("p_partkey").alias("id")), e, e.where("relation = 'similar'"))
    return out.select("id", F.array_join(F.col("similar").cast("array<string>"), ",").alias("near_ids"))


@query("SELECT text FROM (SELECT DISTINCT p_name AS text FROM part WHERE contains(p_name, 'ol')) ORDER BY NOT starts_with(text, 'ol'), text LIMIT 10")
def entity_suggestions(spark, folder):
    return semantic.suggestions(read(spark, folder, "part"), "OL", "p_name")


@query("SELECT event_id FROM events WHERE event_type = 'view' OR (event_type = 'error' AND user_id % 5 < 3) ORDER BY value DESC, ts, event_id LIMIT 100")
def enrichment_tasks(spark, folder):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").otherwise("done")
    t = read(spark, folder, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), (F.col("user_id") % 5).alias("attempts"), F.col("value").alias("priority"), F.col("ts").alias("created_at"))
    return semantic.tasks_due(t).select(F.col("task_id").alias("event_id"))


_PACK = {
    "domain": "parts",
    "taxonomy_version": "2024.01",
    "input_mapping": {"title": ["p_name"], "description": ["p_type"], "language": ["lang"]},
    "output_schema": {"core_item": ["title"], "attributes": [{"key": "color", "type": "categorical", "required": True, "allow_values": ["red", "blue"]}]},
    "rules": {"blocked_terms": ["gizmo"], "normalize_map": {"rod": "bar"}},
}


@query(
    """WITH i AS (SELECT p_partkey, replace(p_name, 'rod', 'bar') AS title, p_name FROM part WHERE NOT contains(p_name, 'gizmo')),
       q AS (SELECT 'item_' || substr(sha256(title || '|' || p_partkey), 1, 12) AS item_id, title, contains(title, 'red') OR contains(title, 'blue') AS has, length(title) AS l FROM i)
       SELECT item_id, title, has::INT AS n_attributes, round(CASE WHEN has THEN 0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN l < 10 THEN 0.3::DOUBLE WHEN l < 20 THEN 0.6 ELSE 1 END ELSE 0.8::DOUBLE * 0.4::DOUBLE + 0.3::DOUBLE - 0.1::DOUBLE END, 6) AS quality,
       CASE WHEN has THEN 'completed' ELSE 'failed' END AS status FROM q"""
)
def ingest_pipeline(spark, folder):
    raw = read(spark, folder, "part").withColumn("lang", F.lit("en"))
    out = pipeline.ingest(raw, pack(_PACK), "parts", {"red": ("color", "red"), "blue": ("color", "blue")}, "p_partkey")
    return out.select("item_id", "title", F.size("attributes").alias("n_attributes"), "quality", "status")


@query("SELECT p_partkey, list_filter([CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN 'allowed' END], lambda x: x IS NOT NULL)[1] AS fault FROM part")
def attribute_validity(spark, folder):
    a = quality.Attribute("p_type", "categorical", True, ("PROMO", "SMALL"))
    return read(spark, folder, "part").select("p_partkey", F.get(quality.value_errors(F.col("p_type"), a), F.lit(0)).alias("fault"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 4) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS score FROM embeddings, q ORDER BY 2, 1 LIMIT 10")
def nearest_euclidean(spark, folder):
    e = read(spark, folder, "embeddings")
    return semantic.vector_search(e, e.where("vec_id = 4").first()["embedding"], "euclidean")


@query(f"WITH {EDGES_SQL} SELECT source, target, CASE relation WHEN 'synonym' THEN 1.0::DOUBLE WHEN 'similar' THEN 0.7 ELSE 0.5 END AS weight FROM edges")
def relation_weights(spark, folder):
    return edges(spark, folder).select("source", "target", relations.weight(F.col("relation")).alias("weight"))
