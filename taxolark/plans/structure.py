"""Trees, vocabularies, mapping, graphs, ranking, quality, evaluation, windows and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.functions import vector as vf
from taxolark.operators import filters as ff
from taxolark.operators import greedy, mapping, quality, ranking, relations, search, taxonomy, vocabulary
from taxolark.operators.stored import numbered, stored
from taxolark.plans.registry import EDGES_SQL, TERMS_SQL, TREE_SQL, edges, query, read, terms, tree
from taxolark.streaming import streams

# --- trees ---------------------------------------------------------------------------------------


@query(f"WITH {TREE_SQL} SELECT category_id, level::INT AS depth FROM tree WHERE path[1] = 'ASIA' AND level > 0")
def tree_descendants(spark, folder):
    t = tree(spark, folder)
    root = t.where("name = 'ASIA' and level = 0").select("category_id").first()["category_id"]
    return taxonomy.descendants(t, root)


@query(f"WITH {TREE_SQL}, c AS (SELECT path FROM tree WHERE category_id = 'c7') SELECT category_id, name, level FROM tree, c WHERE level < 2 AND tree.path = c.path[1:level + 1] ORDER BY level")
def tree_ancestors(spark, folder):
    return taxonomy.ancestors(tree(spark, folder), "c7").select("category_id", "name", "level")


@query(f"WITH {TREE_SQL} SELECT category_id, name FROM tree WHERE parent_id = (SELECT parent_id FROM tree WHERE category_id = 'c7') AND category_id <> 'c7'")
def tree_siblings(spark, folder):
    return taxonomy.siblings(tree(spark, folder), "c7").select("category_id", "name")


@query(
    f"""WITH {TREE_SQL} SELECT count(*) AS total, max(level)::BIGINT AS max_level, round(avg(level), 6) AS mean_level, count(*) FILTER (parent_id IS NULL) AS roots,
        count(*) FILTER (category_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)) AS leaves,
        count(*) FILTER (parent_id IS NOT NULL AND parent_id NOT IN (SELECT category_id FROM tree)) AS orphans FROM tree"""
)
def tree_stats(spark, folder):
    return taxonomy.stats(tree(spark, folder))


@query(
    f"""WITH {TREE_SQL}, k AS (SELECT parent_id, count(*) AS kids FROM tree WHERE parent_id IS NOT NULL GROUP BY 1)
        SELECT count(*) AS nodes, count(kids) AS internal, round(sum(kids) / count(kids)::DOUBLE, 2) AS branching, round((count(*) - count(kids)) / count(*)::DOUBLE, 6) AS leaf_ratio
        FROM tree LEFT JOIN k ON tree.category_id = k.parent_id"""
)
def tree_statistics(spark, folder):
    return taxonomy.tree_statistics(tree(spark, folder))


@query(f"WITH {TREE_SQL} SELECT level, count(*) AS n FROM tree GROUP BY 1")
def tree_depths(spark, folder):
    return taxonomy.depth_histogram(tree(spark, folder))


@query(f"WITH {TREE_SQL} SELECT a.category_id, count(*) AS size FROM tree a JOIN tree b ON b.path[1:a.level + 1] = a.path GROUP BY 1")
def subtree_size(spark, folder):
    return taxonomy.subtree_size(tree(spark, folder))


@query(
    f"""WITH {TREE_SQL} SELECT a.category_id AS a, b.category_id AS b, CASE WHEN a.path[1] <> b.path[1] THEN '' WHEN a.path[2] <> b.path[2] THEN a.path[1] ELSE array_to_string(a.path[1:2], '/') END AS common
        FROM tree a JOIN tree b ON a.level = 2 AND b.level = 2 AND substr(a.category_id, 2)::BIGINT + 1 = substr(b.category_id, 2)::BIGINT"""
)
def lca(spark, folder):
    t = tree(spark, folder).where("level = 2").select("category_id", "path", F.substring("category_id", 2, 20).cast("long").alias("k"))
    pairs = t.select(F.col("category_id").alias("a"), F.col("path").alias("pa"), (F.col("k") + 1).alias("k")).join(t.select(F.col("category_id").alias("b"), F.col("path").alias("pb"), "k"), "k")
    return pairs.select("a", "b", F.array_join(taxonomy.common_ancestor(F.col("pa"), F.col("pb")), "/").alias("common"))


@query(
    f"""WITH {TREE_SQL}, s AS (SELECT category_id, name, greatest(CASE WHEN lower(name) = 'asia' THEN 1.0::DOUBLE WHEN starts_with(lower(name), 'asia') THEN 0.8 WHEN contains(lower(name), 'asia') THEN 0.6 ELSE 0 END,
        CASE WHEN len(list_filter(path, lambda p: contains(lower(p), 'asia'))) > 0 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM tree)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, name, category_id LIMIT 50"""
)
def category_search(spark, folder):
    return taxonomy.search(tree(spark, folder), " Asia ").select("category_id", "name", "score")


@query(
    f"""WITH {TREE_SQL}, one AS (SELECT * FROM tree WHERE category_id = 'n3'),
        s AS (SELECT b.category_id, round(least(1.0::DOUBLE, CASE WHEN lower(a.name) = lower(b.name) THEN 0.4 WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 0.2 ELSE 0 END::DOUBLE
          + CASE WHEN a.level = b.level THEN 0.2 ELSE 0 END::DOUBLE + 0.3::DOUBLE * (CASE WHEN a.path[1] <> b.path[1] THEN 0 WHEN len(b.path) < 2 OR a.path[2] <> b.path[2] THEN 1 ELSE 2 END) / greatest(len(a.path), len(b.path)) + 0.1::DOUBLE), 6) AS score
          FROM one a JOIN tree b ON a.category_id <> b.category_id)
        SELECT * FROM s WHERE score >= 0.3 ORDER BY score DESC, category_id LIMIT 10"""
)
def category_similarity(spark, folder):
    return taxonomy.similar(tree(spark, folder), "n3", 0.3)


@query(f"WITH {TREE_SQL} SELECT 'crowded' AS issue, parent_id AS category_id FROM tree WHERE parent_id IS NOT NULL GROUP BY 2 HAVING count(*) > 15")
def taxonomy_issues(spark, folder):
    return taxonomy.issues(tree(spark, folder))


@query(f"WITH {TREE_SQL} SELECT row_number() OVER (ORDER BY path, category_id) AS place, category_id FROM tree")
def traverse_pre(spark, folder):
    return _numbered(taxonomy.traverse(tree(spark, folder), "pre_order"), F.col("path"))


@query(f"WITH {TREE_SQL} SELECT row_number() OVER (ORDER BY list_append(path, chr(1114111)), category_id) AS place, category_id FROM tree")
def traverse_post(spark, folder):
    return _numbered(taxonomy.traverse(tree(spark, folder), "post_order").withColumn("path", F.concat("path", F.array(F.lit(taxonomy.LAST)))), F.col("path"))


@query(f"WITH {TREE_SQL} SELECT row_number() OVER (ORDER BY level, path, category_id) AS place, category_id FROM tree")
def traverse_bfs(spark, folder):
    return _numbered(taxonomy.traverse(tree(spark, folder), "breadth_first"), F.col("level"), F.col("path"))


def _numbered(df, *by):
    return numbered(df.select("category_id", *by), [*by, F.col("category_id")]).select("place", "category_id")


@query(
    f"""WITH {TREE_SQL} SELECT category_id, CASE WHEN category_id = 'n5' THEN 'r0' ELSE parent_id END AS parent_id, (len(p) - 1)::INT AS level, array_to_string(p, '/') AS path FROM (
        SELECT *, CASE WHEN path[2] = (SELECT name FROM tree WHERE category_id = 'n5') THEN list_concat((SELECT path FROM tree WHERE category_id = 'r0'), path[2:]) ELSE path END AS p FROM tree)"""
)
def move_category(spark, folder):
    return taxonomy.move(tree(spark, folder), "n5", "r0").select("category_id", "parent_id", "level", F.array_join("path", "/").alias("path"))


@query(
    f"""WITH {TREE_SQL} SELECT category_id, CASE WHEN parent_id = 'n5' THEN 'n6' ELSE parent_id END AS parent_id, CASE WHEN category_id = 'n5' THEN 'merged' ELSE status END AS status, array_to_string(p, '/') AS path FROM (
        SELECT *, CASE WHEN level = 2 AND parent_id = 'n5' THEN list_concat((SELECT path FROM tree WHERE category_id = 'n6'), path[3:]) ELSE path END AS p FROM tree)"""
)
def merge_categories(spark, folder):
    return taxonomy.merge(tree(spark, folder), "n5", "n6").select("category_id", "parent_id", "status", F.array_join("path", "/").alias("path"))


@query(f"WITH {TREE_SQL} SELECT category_id, CASE WHEN category_id = 'n5' OR parent_id = 'n5' THEN 'deprecated' ELSE status END AS status FROM tree")
def delete_category(spark, folder):
    return taxonomy.delete(tree(spark, folder), "n5", recursive=True).select("category_id", "status")


@query(f"WITH {TREE_SQL} SELECT category_id, name, level::INT AS level, array_to_string(path, '/') AS path FROM tree")
def tree_paths(spark, folder):
    return taxonomy.paths(tree(spark, folder)).select("category_id", "name", "level", F.array_join("path", "/").alias("path"))


# --- vocabulary ------------------------------------------------------------------------------------

_VALUES = "(VALUES ('Red  Widget'), ('widget red'), ('red widgit'), ('hot rodd'), ('xyz')) v(value)"
_MATCH_SQL = f"""{TERMS_SQL}, v AS (SELECT value, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS norm FROM {_VALUES}),
  m AS (SELECT value, term_id, CASE WHEN norm = term THEN 1.0::DOUBLE WHEN norm = aliases[1] THEN 0.95 ELSE 1 - levenshtein(norm, term) / greatest(length(norm), length(term))::DOUBLE END AS score,
          CASE WHEN norm = term THEN 0 WHEN norm = aliases[1] THEN 1 ELSE 2 END AS rank FROM v, terms),
  best AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, rank, term_id) AS k FROM m WHERE score >= 0.8),
  found AS (SELECT value, term_id, round(score, 6) AS score, ['exact', 'alias', 'fuzzy'][rank + 1] AS kind FROM best WHERE k = 1)"""


def _values(spark):
    return spark.createDataFrame([("Red  Widget",), ("widget red",), ("red widgit",), ("hot rodd",), ("xyz",)], "value string")


@query(f"WITH {_MATCH_SQL} SELECT * FROM found")
def vocab_match(spark, folder):
    return vocabulary.matches(_values(spark), terms(spark, folder))


@query(
    f"""WITH {_MATCH_SQL} SELECT value, term_id IS NOT NULL AND score >= 0.6 AS valid, coalesce(term_id, -1) AS term_id, coalesce(score, 0.0::DOUBLE) AS score,
        CASE WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.8 THEN 'high' ELSE 'uncertain' END AS confidence, term_id IS NOT NULL AND score < 0.8 AS warning FROM v LEFT JOIN found USING (value)"""
)
def vocab_validate(spark, folder):
    return vocabulary.validate(_values(spark), terms(spark, folder), "strict").withColumn("term_id", F.coalesce("term_id", F.lit(-1)))


@query(f"WITH {TERMS_SQL} SELECT vocabulary_type, count(*) AS terms, count(DISTINCT category_id) AS categories, count(*) FILTER (category_id IS NULL) AS orphans, count(*) FILTER (usage_count > 0) AS used FROM terms GROUP BY 1")
def vocab_stats(spark, folder):
    return vocabulary.stats(terms(spark, folder))


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_PAIRS = f"""g AS (SELECT term_id, term, {_GRAMS.format('term')} AS g FROM terms),
  pairs AS (SELECT a.term_id AS a, b.term_id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 6) AS score FROM g a JOIN g b ON a.term_id < b.term_id)"""


@query(f"WITH {TERMS_SQL}, {_PAIRS} SELECT a, b, score FROM pairs WHERE score > 0.5")
def bigram_pairs(spark, folder):
    return vocabulary.similar_pairs(terms(spark, folder), 0.5)


@query(
    f"""WITH {TERMS_SQL}, {_PAIRS} SELECT count(*) AS terms, round(greatest(0.0::DOUBLE, 1 - (0 + count(*)) / (2 * count(*))::DOUBLE), 6) AS completeness, 1.0::DOUBLE AS consistency, round(count(*) FILTER (usage_count > 0) / count(*)::DOUBLE, 6) AS coverage,
        round(1 - (SELECT count(*) FROM pairs WHERE score > 0.9) / count(*)::DOUBLE, 6) AS redundancy, 1.0::DOUBLE AS hierarchy FROM terms"""
)
def vocab_quality(spark, folder):
    t = terms(spark, folder).withColumns({"description": F.col("term"), "labels": F.lit(None).cast("map<string,string>"), "parent_term_id": F.lit(None).cast("long")})
    return vocabulary.quality(t)


@query(
    f"""WITH {TERMS_SQL}, k AS (SELECT term_id, usage_count, unnest(['prefix_' || term[1:3], 'suffix_' || term[-3:], 'first_' || split_part(term, ' ', 1), 'second_' || split_part(term, ' ', 2)]) AS pattern FROM terms),
        c AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY usage_count DESC, term_id) AS k FROM k)
        SELECT pattern, count(*) AS size, max(term_id) FILTER (k = 1) AS center, round(least(1.0::DOUBLE, (count(*) - 1) / 10::DOUBLE), 6) AS strength FROM c GROUP BY 1 HAVING count(*) > 1"""
)
def cluster_syntactic(spark, folder):
    return vocabulary.cluster_syntactic(terms(spark, folder))


@query(
    f"""WITH {TERMS_SQL}, c AS (SELECT *, CASE WHEN usage_count > 100 THEN 'high' WHEN usage_count > 10 THEN 'medium' WHEN usage_count > 0 THEN 'low' ELSE 'unused' END AS band FROM terms),
        r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY usage_count DESC, term_id) AS k FROM c)
        SELECT band, count(*) AS size, max(term_id) FILTER (k = 1) AS center, round(least(1.0::DOUBLE, (count(*) - 1) / 20::DOUBLE), 6) AS strength FROM r GROUP BY 1"""
)
def cluster_usage(spark, folder):
    return vocabulary.cluster_usage(terms(spark, folder))


@query(f"WITH {TERMS_SQL}, {_PAIRS} SELECT 'merge' AS kind, a AS term_id, b AS other_id, 'medium' AS priority, score AS confidence FROM pairs WHERE score > 0.6")
def recommend_merges(spark, folder):
    t = terms(spark, folder).withColumns({"parent_term_id": F.lit(None).cast("long"), "created_at": F.lit("2024-01-01")})
    return vocabulary.recommendations(t, "2024-02-01", merge=0.6)


@query("WITH b AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS n FROM b x JOIN b y ON x.g = y.g AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 20")
def cooccurrence(spark, folder):
    return vocabulary.cooccurrence(read(spark, folder, "lineitem"), "l_suppkey", "l_orderkey", 20)


@query(
    f"""WITH {TERMS_SQL}, {_PAIRS}, mirrored AS (SELECT a AS x, b AS y, score FROM pairs UNION ALL SELECT b, a, score FROM pairs), s AS (SELECT min(term_id) AS id FROM terms)
        SELECT y AS term_id, 'similar' AS relation, score FROM mirrored, s WHERE x = id AND score > 0.4 AND score > 0.6 ORDER BY score DESC, term_id LIMIT 20"""
)
def related_terms(spark, folder):
    t = terms(spark, folder).withColumn("parent_term_id", F.lit(None).cast("long"))
    return vocabulary.related(t, t.agg(F.min("term_id")).first()[0])


# --- mapping ------------------------------------------------------------------------------------------


@query(
    """SELECT coalesce(source, lang) AS title, lang AS language, map_from_entries([('doc_id', doc_id::VARCHAR)])['doc_id'] AS raw_doc FROM documents"""
)
def map_fields(spark, folder):
    df = read(spark, folder, "documents")
    out = mapping.map_fields(df, {"title": ["missing", "source", "lang"], "language": ["lang"], "description": ["text"], "size": ["n_chars"]})
    return out.select("title", "language", F.col("raw_attributes")["doc_id"].alias("raw_doc"))


@query("SELECT page_id, 'item_' || substr(sha256(url || '|' || page_id), 1, 12) AS item_id FROM pages")
def stable_id(spark, folder):
    return read(spark, folder, "pages").select("page_id", mapping.stable_id(F.col("url"), F.col("page_id").cast("string")).alias("item_id"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name), '(?i)red', 'crimson', 'g'), '(?i)ring', 'band', 'g') AS title FROM part")
def normalize_map(spark, folder):
    return read(spark, folder, "part").select("p_partkey", mapping.normalize(F.col("p_name"), {"RED": "crimson", "ring": "band"}).alias("title"))


@query("SELECT p_partkey, CASE lower(p_type) WHEN 'promo' THEN 'offer' WHEN 'economy' THEN 'basic' ELSE p_type END AS kind FROM part")
def value_map(spark, folder):
    return read(spark, folder, "part").select("p_partkey", mapping.map_value(F.col("p_type"), {"Promo": "offer", "ECONOMY": "basic"}).alias("kind"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)idiot|scum')")
def blocked_filter(spark, folder):
    return read(spark, folder, "documents").where(~mapping.blocked([F.col("text")], ["idiot", "scum"])).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def dedupe(spark, folder):
    return mapping.dedupe(read(spark, folder, "documents"), ["text", "lang"], "doc_id").select("doc_id")


@query("SELECT page_id FROM pages WHERE url IS NOT NULL AND url <> '' AND html IS NOT NULL AND html <> ''")
def skip_missing(spark, folder):
    return read(spark, folder, "pages").where(mapping.complete([F.col("url"), F.col("html")])).select("page_id")


@query(
    """WITH m(from_term, to_term, valid_from, valid_to) AS (VALUES ('click', 'tap', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15'), ('click', 'press', TIMESTAMP '2024-01-15', NULL), ('view', 'look', TIMESTAMP '2024-01-02', NULL), ('view', 'see', TIMESTAMP '2024-01-20', NULL)),
       j AS (SELECT event_id, event_type, to_term, row_number() OVER (PARTITION BY event_id ORDER BY valid_from DESC NULLS LAST) AS k FROM events LEFT JOIN m ON event_type = from_term AND valid_from <= ts AND (valid_to IS NULL OR ts < valid_to))
       SELECT event_id, coalesce(to_term, event_type) AS mapped FROM j WHERE k = 1"""
)
def mapping_as_of(spark, folder):
    rows = [("click", "tap", "2024-01-05", "2024-01-15"), ("click", "press", "2024-01-15", None), ("view", "look", "2024-01-02", None), ("view", "see", "2024-01-20", None)]
    m = spark.createDataFrame(rows, "from_term string, to_term string, valid_from string, valid_to string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})
    return mapping.apply_mappings(read(spark, folder, "events"), m, "event_type", "ts").select("event_id", "mapped")


@query(
    """WITH m AS (SELECT event_type AS from_term, 'user ' || user_id AS to_term, ts AS valid_from, CASE WHEN event_id % 7 > 0 THEN ts + to_hours((value / 20)::INT) END AS valid_to FROM events WHERE value > 140)
       SELECT event_id, coalesce(arg_max(to_term, (valid_from, to_term)) FILTER (valid_from <= ts AND (valid_to IS NULL OR ts < valid_to)), event_type) AS mapped
       FROM events LEFT JOIN m ON event_type = from_term GROUP BY event_id, event_type"""
)
def applied_mappings(spark, folder):
    """Each event's term by the latest mapping that is valid then; mappings overlap, and some are open."""
    e = read(spark, folder, "events")
    hours = F.make_interval(hours=F.rint(F.col("value") / 20).cast("int"))
    m = e.where("value > 140").select(F.col("event_type").alias("from_term"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("to_term"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 7 > 0, F.col("ts") + hours).alias("valid_to"))
    return mapping.apply_mappings(e, m, "event_type", "ts").select("event_id", "mapped")


# --- vectors --------------------------------------------------------------------------------------------

_V = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _vectors(spark, folder):
    return read(spark, folder, "embeddings")


@query(f"WITH e AS ({_V}), q AS (SELECT v AS q FROM e WHERE vec_id = 0) SELECT vec_id, round({_COS.format('v', 'q')}, 6) AS score FROM e, q WHERE {_COS.format('v', 'q')} >= 0 ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk(spark, folder):
    e = _vectors(spark, folder)
    q = tuple(e.where("vec_id = 0").first()["embedding"])
    r = search.Request("semantic", vector=q, similarity=0.0, window=ff.Page(10))
    return search.Engine(e, search.Shape("vec_id", (), vector="embedding")).run(r).select("vec_id", "score")


@query(f"WITH e AS ({_V}), q AS (SELECT v AS q FROM e WHERE vec_id = 1) SELECT vec_id, round({_COS.format('v', 'q')}, 6) AS score FROM e, q WHERE label IN (1, 2, 3) AND {_COS.format('v', 'q')} >= 0.1 ORDER BY 2 DESC, 1 LIMIT 1000")
def cosine_threshold(spark, folder):
    e = _vectors(spark, folder)
    q = tuple(e.where("vec_id = 1").first()["embedding"])
    r = search.Request("semantic", vector=q, similarity=0.1, filters=(ff.Filter("label", "in", [1, 2, 3]),), window=ff.Page(1000))
    return search.Engine(e, search.Shape("vec_id", (), vector="embedding")).run(r).select("vec_id", "score")


@query(
    f"""WITH e AS ({_V}), q AS (SELECT v AS q FROM e WHERE vec_id = 2) SELECT vec_id, round(list_dot_product(v, q), 6) AS dot, round(sqrt(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean,
        round(list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM e, q"""
)
def vector_measures(spark, folder):
    e = _vectors(spark, folder)
    q = vf.literal(e.where("vec_id = 2").first()["embedding"])
    v = F.col("embedding")
    return e.select("vec_id", F.round(vf.dot(v, q), 6).alias("dot"), F.round(vf.euclidean(v, q), 6).alias("euclidean"), F.round(vf.manhattan(v, q), 6).alias("manhattan"))


@query(f"WITH e AS ({_V}) SELECT a.vec_id AS source, b.vec_id AS target, round({_COS.format('a.v', 'b.v')}, 6) AS confidence FROM e a JOIN e b ON a.vec_id <> b.vec_id")
def similarity_matrix(spark, folder):
    e = _vectors(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return relations.similarity_edges(e, e, -2.0)


@query(
    f"""WITH e AS ({_V}), c AS (SELECT -1 - label AS id, arg_min(v, vec_id) AS v FROM e GROUP BY 1), s AS (SELECT vec_id AS source, c.id AS target, round({_COS.format('e.v', 'c.v')}, 6) AS confidence FROM e, c WHERE {_COS.format('e.v', 'c.v')} >= 0.1),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS k FROM s) SELECT source, target, confidence FROM r WHERE k <= 3"""
)
def map_categories_topk(spark, folder):
    e = _vectors(spark, folder)
    one = e.groupBy((-1 - F.col("label").cast("long")).alias("id")).agg(F.min_by("embedding", "vec_id").alias("v"))
    return relations.similarity_edges(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), one, 0.1, 3)


@query(f"WITH e AS ({_V}) SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * 0.75::DOUBLE + p[2] * 0.25::DOUBLE)), 6) AS total FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def multi_model_average(spark, folder):
    a = _vectors(spark, folder).select("vec_id", F.col("embedding").alias("x"))
    b = _vectors(spark, folder).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(vf.total(vf.weighted_average([F.col("x"), F.col("y")], [3, 1])), 6).alias("total"))


# --- graphs ------------------------------------------------------------------------------------------------


_INSIDE = "((length(split_part({1}, ' ', 1)) > 3 AND contains({0}, split_part({1}, ' ', 1))) OR (length(split_part({1}, ' ', 2)) > 3 AND contains({0}, split_part({1}, ' ', 2))))"


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS n FROM part), c AS (SELECT a.n AS source, b.n AS target, CASE WHEN {_INSIDE.format('a.n', 'b.n')} THEN 'hyponym' WHEN {_INSIDE.format('b.n', 'a.n')} THEN 'hypernym' ELSE 'related' END AS relation FROM n a JOIN n b ON a.n <> b.n)
        SELECT *, CASE WHEN relation = 'related' THEN 0.48::DOUBLE ELSE 0.54 END AS confidence FROM c"""
)
def classify_relationships(spark, folder):
    p = read(spark, folder, "part").select("p_name").distinct()
    pairs = p.toDF("source").join(p.toDF("target"), F.col("source") != F.col("target"))
    name, score = relations.classify(F.col("source"), F.col("target"), F.lit(0.6))
    return pairs.select("source", "target", name.alias("relation"), F.round(score, 6).alias("confidence"))


@query(f"WITH {EDGES_SQL}, e AS (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges), d AS (SELECT node, count(*) AS degree FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS node, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / (n - 1)::DOUBLE, 6) AS degree_centrality, round(coalesce(degree, 0) / n::DOUBLE, 6) AS closeness FROM part LEFT JOIN d ON p_partkey = node, n")
def degree_centrality(spark, folder):
    return relations.centrality(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), edges(spark, folder))


@query(f"WITH {EDGES_SQL}, n AS (SELECT count(*) AS nodes FROM part), e AS (SELECT count(*) AS edges FROM edges) SELECT nodes, edges, round(2 * edges / nodes::DOUBLE, 6) AS mean_degree, round(edges / (nodes * (nodes - 1) / 2)::DOUBLE, 6) AS density FROM n, e")
def graph_metrics(spark, folder):
    return relations.metrics(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), edges(spark, folder))


_ONE = "(SELECT min(source) FROM edges)"


@query(
    f"""WITH {EDGES_SQL}, one AS (SELECT DISTINCT target AS node FROM edges WHERE source = {_ONE}), two AS (SELECT DISTINCT target AS node FROM edges WHERE source IN (SELECT node FROM one))
        SELECT {_ONE} AS node, 0 AS hops UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two WHERE node NOT IN (SELECT node FROM one)"""
)
def neighbourhood_2hop(spark, folder):
    e = edges(spark, folder)
    return relations.neighbourhood(e, e.agg(F.min("source")).first()[0])


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, far AS (SELECT max(b.target) AS b FROM edges a JOIN edges b ON a.target = b.source WHERE a.source = {_ONE}),
        walk AS (SELECT {_ONE} AS node, [{_ONE}] AS path, 0.0::DOUBLE AS weight UNION ALL SELECT e.target, list_append(path, e.target), weight + e.confidence FROM edges e JOIN walk ON e.source = node WHERE len(path) <= 4 AND NOT list_contains(path, e.target))
        SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops, round(weight, 6) AS weight, round(weight / (len(path) - 1), 6) AS score FROM walk, far WHERE node = b ORDER BY len(path), walk.path LIMIT 1"""
)
def shortest_path(spark, folder):
    e = edges(spark, folder)
    a = e.agg(F.min("source")).first()[0]
    b = e.where(F.col("source") == a).select(F.col("target").alias("source")).join(e, "source").agg(F.max("target")).first()[0]
    return relations.shortest_path(e, a, b, 4).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT source AS a, target AS b FROM edges WHERE confidence > 0.5 UNION SELECT target, source FROM edges WHERE confidence > 0.5),
        reach AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b, root FROM reach JOIN both_ways ON node = a)
        SELECT node, min(root) AS component FROM reach GROUP BY 1"""
)
def connected_components(spark, folder):
    return relations.components(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), edges(spark, folder).where("confidence > 0.5"))


_RANK = """r{1} AS (SELECT p_partkey AS node, 0.15::DOUBLE / (SELECT count(*) FROM part) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{0} WHERE node NOT IN (SELECT source FROM out)) / (SELECT count(*) FROM part)) AS rank
  FROM part LEFT JOIN (SELECT target, sum(rank / n) AS got FROM edges JOIN out USING (source) JOIN r{0} ON r{0}.node = source GROUP BY 1) g ON p_partkey = g.target)"""


@query(
    f"""WITH {EDGES_SQL}, out AS (SELECT source, count(*) AS n FROM edges GROUP BY 1), r0 AS (SELECT p_partkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM part) AS rank FROM part),
        {', '.join(_RANK.format(i, i + 1) for i in range(3))} SELECT node, round(rank, 9) AS rank FROM r3"""
)
def pagerank(spark, folder):
    return relations.pagerank(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), edges(spark, folder), 3).select("node", F.round("rank", 9).alias("rank"))


@query(
    f"""WITH {EDGES_SQL}, u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), d AS (SELECT a AS node, count(*) AS d FROM u GROUP BY 1),
        t AS (SELECT x.a AS node, count(*) / 2 AS t FROM u x JOIN u y ON x.b = y.a JOIN u z ON y.b = z.a AND z.b = x.a GROUP BY 1)
        SELECT d.node, round(CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) / 2)::DOUBLE ELSE 0.0 END, 6) AS coefficient FROM d LEFT JOIN t USING (node)"""
)
def clustering_coefficient(spark, folder):
    return relations.clustering_coefficient(edges(spark, folder))


@query(
    f"""WITH {EDGES_SQL}, good AS (SELECT DISTINCT source, target FROM edges WHERE relation IN ('synonym', 'similar') AND confidence > 0.4),
        one AS (SELECT DISTINCT target AS node FROM good WHERE source < 50 AND target >= 50), two AS (SELECT DISTINCT target AS node FROM good WHERE source IN (SELECT node FROM one)),
        every AS (SELECT i AS node, 0 AS hops FROM range(50) t(i) UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two WHERE node >= 50 AND node NOT IN (SELECT node FROM one))
        SELECT node, hops FROM every ORDER BY hops, node LIMIT 500"""
)
def expand_relationships(spark, folder):
    return relations.expand(edges(spark, folder), range(50), 2, 0.5, 0.4, 500)


@query(
    f"""WITH {EDGES_SQL}, x AS MATERIALIZED (SELECT source AS n0, target AS n1 FROM edges WHERE relation = 'similar'), y AS MATERIALIZED (SELECT source AS n1, target AS n2 FROM edges WHERE relation = 'related')
        SELECT n0, n1, n2 FROM x JOIN y USING (n1)"""
)
def pattern_match(spark, folder):
    return relations.pattern(edges(spark, folder), ["similar", "related"])


_EIGEN = """x{1} AS MATERIALIZED (SELECT node, CASE WHEN max(x) OVER () > 0 THEN x / max(x) OVER () ELSE 0.0 END AS x FROM (SELECT v.node, v.x + coalesce(g.got, 0) AS x FROM x{0} v LEFT JOIN (SELECT a, sum(x) AS got FROM u JOIN x{0} ON b = node GROUP BY 1) g ON v.node = g.a))"""


@query(
    f"""WITH {EDGES_SQL}, u AS MATERIALIZED (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), x0 AS MATERIALIZED (SELECT p_partkey AS node, (p_partkey IN (SELECT a FROM u))::INT::DOUBLE AS x FROM part),
        {', '.join(_EIGEN.format(i, i + 1) for i in range(4))} SELECT node, round(x, 6) AS centrality FROM x4"""
)
def eigenvector_centrality(spark, folder):
    return relations.eigenvector(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), edges(spark, folder), 4).select("node", F.round("centrality", 6).alias("centrality"))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS MATERIALIZED (SELECT source AS a, target AS b FROM edges WHERE confidence > 0.5 UNION SELECT target, source FROM edges WHERE confidence > 0.5),
        reach AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b, root FROM reach JOIN both_ways ON node = a), l AS (SELECT node, min(root) AS component FROM reach GROUP BY 1),
        n AS (SELECT component, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 3), i AS (SELECT component, avg(confidence) AS mean, count(*) AS n FROM edges JOIN l ON source = node WHERE confidence > 0.5 GROUP BY 1)
        SELECT component, size, round(mean * least(1.0::DOUBLE, i.n / (size * (size - 1) / 2)::DOUBLE), 6) AS cohesion FROM n JOIN i USING (component) ORDER BY size DESC, component LIMIT 50"""
)
def graph_clusters(spark, folder):
    return relations.clusters(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), edges(spark, folder))


@query(f"WITH {EDGES_SQL} SELECT source, target, relation FROM edges WHERE source IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') AND target IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')")
def subgraph(spark, folder):
    own = read(spark, folder, "part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("node"))
    return relations.subgraph(edges(spark, folder), own).select("source", "target", "relation")


# --- ranking -------------------------------------------------------------------------------------------------

_RESULTS = "res AS (SELECT p_partkey AS id, round(p_size / 50::DOUBLE, 6) AS similarity, 0.8::DOUBLE AS confidence, (p_type = 'PROMO')::INT::DOUBLE AS domain, 0.5::DOUBLE AS boost FROM part)"


def _ranked(name: str, sql: str) -> None:
    def run(spark, folder):
        p = read(spark, folder, "part")
        res = p.select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50, 6).alias("similarity"), F.lit(0.8).alias("confidence"), (F.col("p_type") == "PROMO").cast("double").alias("domain"), F.lit(0.5).alias("boost"))
        return ranking.rank(res, edges(spark, folder), name).select("id", "score")

    run.__name__ = f"rank_{name}"
    query(f"WITH {EDGES_SQL}, {_RESULTS}, c AS (SELECT source AS id, count(*) AS n FROM edges GROUP BY 1) SELECT id, round({sql}, 6) AS score FROM res LEFT JOIN c USING (id)")(run)


for _name, _sql in (
    ("popularity", "0.7::DOUBLE * similarity + 0.3::DOUBLE * least(1.0::DOUBLE, coalesce(n, 0) / 10::DOUBLE) + 0.1::DOUBLE"),
    ("freshness", "0.6::DOUBLE * similarity + 0.15::DOUBLE + 0.1::DOUBLE * domain"),
    ("confidence", "0.5::DOUBLE * similarity + 0.1::DOUBLE * least(1.0::DOUBLE, coalesce(n, 0) / 10::DOUBLE) + 0.24::DOUBLE + 0.1::DOUBLE * domain + 0.1::DOUBLE"),
    ("balanced", "0.4::DOUBLE * similarity + 0.2::DOUBLE * least(1.0::DOUBLE, coalesce(n, 0) / 10::DOUBLE) + 0.05::DOUBLE + 0.16::DOUBLE + 0.1::DOUBLE * domain + 0.1::DOUBLE"),
):
    _ranked(_name, _sql)


@query(
    f"""WITH {EDGES_SQL}, near AS (SELECT p_partkey AS id, round(p_size / 50::DOUBLE, 6) AS score FROM part WHERE p_size >= 45), top AS (SELECT * FROM near ORDER BY score DESC, id LIMIT 30),
        led AS (SELECT target AS id, max(score * CASE relation WHEN 'synonym' THEN 1.0::DOUBLE WHEN 'similar' THEN 0.9 ELSE 0.8 END * confidence) AS score FROM top JOIN edges ON id = source WHERE confidence > 0.5 GROUP BY 1)
        SELECT id, score, 0 AS way FROM near UNION ALL SELECT id, round(score, 6), 1 FROM led WHERE score > 0.3 AND id NOT IN (SELECT id FROM near)"""
)
def hybrid_search(spark, folder):
    near = read(spark, folder, "part").where("p_size >= 45").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50, 6).alias("score"))
    return ranking.hybrid(near, edges(spark, folder), relations.weight(F.col("relation"), relations.FOLLOWED), 0.3, 30)


@query(
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size < 5 THEN 'exact' WHEN p_size < 20 THEN 'alias' ELSE 'candidate' END AS match, p_size AS evidence, p_retailprice AS last_seen FROM part)
       SELECT id, match, CASE match WHEN 'exact' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END AS match_rank FROM r ORDER BY match_rank, evidence DESC, last_seen DESC, id"""
)
def hybrid_playbook(spark, folder):
    m = F.when(F.col("p_size") < 5, "exact").when(F.col("p_size") < 20, "alias").otherwise("candidate")
    r = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), m.alias("match"), F.col("p_size").alias("evidence"), F.col("p_retailprice").alias("last_seen"))
    return ranking.playbook(r).select("id", "match", "match_rank")


@query(
    f"""WITH {EDGES_SQL}, seen AS (SELECT DISTINCT o_custkey AS u, l_partkey AS id, max(o_orderdate) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
        s AS (SELECT u, id, row_number() OVER (PARTITION BY u ORDER BY t DESC, id) AS nth FROM seen),
        e AS (SELECT source, target, confidence, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS k FROM edges WHERE confidence >= 0.5),
        o AS (SELECT s.u, target AS id, confidence AS score, nth, k, row_number() OVER (PARTITION BY s.u, target ORDER BY nth, k) AS f FROM s JOIN e ON s.id = source WHERE nth <= 10 AND k <= 5 AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.u = s.u AND x.id = target)),
        p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY nth, k, id) AS place FROM o WHERE f = 1)
        SELECT u AS "user", id, score, place::INT AS place FROM p WHERE place <= 10"""
)
def recommendations(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    seen = o.join(read(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("id")).agg(F.max("o_orderdate").alias("at"))
    return ranking.recommend(seen, edges(spark, folder), least=0.5)


# --- quality and evaluation ---------------------------------------------------------------------------------------

_SCHEMA = (quality.Attribute("kind", "categorical", True, ("widget", "bolt", "gear", "ring")), quality.Attribute("color", "text", pattern="[a-z]+$"))


def _extractions(spark, folder):
    """Extractions made from part names: the second word is a kind, the first a colour, if it is one."""
    w = F.split("p_name", " ")
    color = F.when(w[0].isin("red", "blue"), F.struct(F.lit("color").alias("name"), w[0].alias("value"), F.col("p_name").alias("evidence"), (F.col("p_size") / 50).alias("confidence")))
    kind = F.when(F.col("p_size") > 3, F.struct(F.lit("kind").alias("name"), w[1].alias("value"), F.substring("p_name", 1, 2).alias("evidence"), F.lit(0.9).alias("confidence")))
    term = F.struct(F.col("p_name").alias("term"), F.substring("p_name", 1, 9).alias("context"), F.lit(0.2).alias("confidence"))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.array_compact(F.array(color, kind)).alias("attributes"), F.array(term).alias("terms"))


_ISSUES = """x AS (SELECT p_partkey AS item_id, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_name FROM part),
  issues AS (
    SELECT item_id, 'error' AS severity, 'schema' AS category, 'missing' AS rule, 'kind' AS field FROM x WHERE p_size <= 3
    UNION ALL SELECT item_id, 'warning', 'schema', 'not_allowed', 'kind' FROM x WHERE p_size > 3 AND b NOT IN ('widget', 'bolt', 'gear', 'ring')
    UNION ALL SELECT item_id, 'warning', 'quality', 'short_evidence', 'kind' FROM x WHERE p_size > 3
    UNION ALL SELECT item_id, 'warning', 'quality', 'low_confidence', 'color' FROM x WHERE a IN ('red', 'blue') AND p_size / 50::DOUBLE < 0.3
    UNION ALL SELECT item_id, 'warning', 'quality', 'low_confidence', p_name FROM x
    UNION ALL SELECT item_id, 'warning', 'quality', 'rule_attributes', '' FROM x WHERE (a IN ('red', 'blue'))::INT + (p_size > 3)::INT < 2)"""


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def validate_extraction(spark, folder):
    return quality.issues(_extractions(spark, folder), _SCHEMA, min_attributes=2)


@query(
    f"""WITH {_ISSUES}, n AS (SELECT item_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1),
        s AS (SELECT x.item_id, errors, warnings, a IN ('red', 'blue') AS has_color, p_size > 3 AS has_kind, length(p_name) AS l, p_size FROM x JOIN n USING (item_id)),
        t AS (SELECT *, CASE WHEN errors > 0 THEN 0.8::DOUBLE ELSE 1.0 END AS schema_score, (has_color::INT + has_kind::INT) / 2::DOUBLE AS coverage,
          CASE WHEN NOT has_color AND NOT has_kind THEN 1.0::DOUBLE ELSE (CASE WHEN has_color THEN CASE WHEN l < 10 THEN 0.3::DOUBLE WHEN l < 20 THEN 0.6 ELSE 1 END ELSE 0 END + CASE WHEN has_kind THEN 0.3::DOUBLE ELSE 0 END) / (has_color::INT + has_kind::INT) END AS evidence FROM s)
        SELECT item_id, round(schema_score, 6) AS schema_score, round(coverage, 6) AS coverage, round(evidence, 6) AS evidence, round(greatest(0.0::DOUBLE, schema_score * 0.4::DOUBLE + coverage * 0.3::DOUBLE + evidence * 0.3::DOUBLE - least(errors * 0.1::DOUBLE + warnings * 0.05::DOUBLE, 0.5::DOUBLE)), 6) AS total, errors, warnings,
          round(CASE WHEN has_color AND has_kind THEN (p_size / 50::DOUBLE + 0.9::DOUBLE) / 2 WHEN has_color THEN p_size / 50::DOUBLE WHEN has_kind THEN 0.9::DOUBLE END, 6) AS attribute_confidence, 0.2::DOUBLE AS term_confidence FROM t"""
)
def quality_scores(spark, folder):
    x = _extractions(spark, folder)
    return quality.scores(x, quality.issues(x, _SCHEMA, min_attributes=2), ["kind", "color"])


@query(
    f"""WITH {TERMS_SQL}, c AS (SELECT p_brand || ' ' || p_type AS term, count(*) AS frequency, round(avg(p_size) / 30, 6) AS confidence FROM part GROUP BY 1)
        SELECT term, frequency, confidence FROM c WHERE frequency >= 5 AND confidence >= 0.7 AND lower(term) NOT IN (SELECT lower(term) FROM terms) ORDER BY frequency DESC, confidence DESC, term LIMIT 50"""
)
def elevation_candidates(spark, folder):
    c = read(spark, folder, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("term")).agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("p_size") / 30, 6).alias("confidence"))
    return quality.elevation_candidates(c, terms(spark, folder))


@query(
    """WITH b AS (SELECT event_type AS term, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), a AS (SELECT event_type AS term, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
       x AS (SELECT term, n / (SELECT sum(n) FROM b)::DOUBLE AS x FROM b), y AS (SELECT term, n / (SELECT sum(n) FROM a)::DOUBLE AS y FROM a)
       SELECT term, round(coalesce(x, 0), 6) AS before_share, round(coalesce(y, 0), 6) AS after_share, round(CASE WHEN coalesce(x, 0) > 0 THEN coalesce(y, 0) / x END, 6) AS ratio FROM x FULL JOIN y USING (term)"""
)
def concept_drift(spark, folder):
    e, cut = read(spark, folder, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    count = lambda df: df.groupBy(F.col("event_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return quality.drift(count(e.where(F.col("ts") < cut)), count(e.where(F.col("ts") >= cut)))


@query("SELECT p_name AS norm, count(DISTINCT p_type) AS categories FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def semantic_conflicts(spark, folder):
    return quality.conflicts(read(spark, folder, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("category_id")))


_LISTS = """ranked AS (SELECT p_type AS query, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place, (p_size % 7 = 0)::INT AS relevant FROM part)"""


def _lists(spark, folder):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, folder, "part").select(F.col("p_type").alias("query"), F.row_number().over(w).alias("place"), (F.col("p_size") % 7 == 0).cast("int").alias("relevant"))


@query(f"WITH {_LISTS} SELECT query, round(sum(relevant) / 10::DOUBLE, 6) AS precision FROM ranked WHERE place <= 10 GROUP BY 1")
def precision_at_k(spark, folder):
    return ranking.precision_at(_lists(spark, folder), 10)


@query(f"WITH {_LISTS} SELECT query, round(sum(relevant) FILTER (place <= 50) / sum(relevant)::DOUBLE, 6) AS recall FROM ranked GROUP BY 1")
def recall_at_k(spark, folder):
    lists = _lists(spark, folder)
    return ranking.recall_at(lists, lists.groupBy("query").agg(F.sum("relevant").alias("n")), 50)


@query(f"WITH {_LISTS}, f AS (SELECT query, min(place) FILTER (relevant = 1) AS f FROM ranked GROUP BY 1) SELECT round(avg(coalesce(1 / f::DOUBLE, 0)), 6) AS mrr FROM f")
def mrr(spark, folder):
    return ranking.mrr(_lists(spark, folder))


@query(
    f"""WITH {_LISTS}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevant DESC, place) AS best FROM ranked WHERE place <= 20)
        SELECT query, round(CASE WHEN sum(relevant / log2(best + 1)) > 0 THEN sum(relevant / log2(place + 1)) / sum(relevant / log2(best + 1)) ELSE 0.0 END, 6) AS ndcg FROM t GROUP BY 1"""
)
def ndcg(spark, folder):
    return ranking.ndcg(_lists(spark, folder), 20)


@query("SELECT lang, round(count(quality) / count(*)::DOUBLE, 6) AS coverage, round(avg(quality), 6) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage(spark, folder):
    joined = read(spark, folder, "documents").select("doc_id", "lang").join(read(spark, folder, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("coverage"), F.round(F.avg("quality"), 6).alias("good"))


# --- greedy ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {TERMS_SQL}, {_PAIRS}, near AS (SELECT a, b FROM pairs WHERE score > 0.5), o AS (SELECT term_id, row_number() OVER (ORDER BY term_id) AS k FROM terms),
        walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS lead UNION ALL SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = o.term_id AND list_contains(w.lead, a)) THEN w.lead ELSE list_append(w.lead, o.term_id) END FROM walk w JOIN o ON o.k = w.k + 1),
        l AS (SELECT unnest(lead) AS l FROM walk WHERE k = (SELECT count(*) FROM terms))
        SELECT term_id AS id, CASE WHEN term_id IN (SELECT l FROM l) THEN term_id ELSE (SELECT min(a) FROM near JOIN l ON a = l WHERE b = term_id) END AS leader FROM terms"""
)
def cluster_semantic(spark, folder):
    t = stored(terms(spark, folder))
    pairs = stored(vocabulary.similar_pairs(t, 0.5))
    return greedy.leaders(t.select(F.col("term_id").alias("id")), pairs)


@query(
    f"""WITH RECURSIVE e AS ({_V}), near AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id < y.vec_id AND {_COS.format('x.v', 'y.v')} >= 0.3), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM e),
        walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS lead UNION ALL SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = o.vec_id AND list_contains(w.lead, a)) THEN w.lead ELSE list_append(w.lead, o.vec_id) END FROM walk w JOIN o ON o.k = w.k + 1),
        l AS (SELECT unnest(lead) AS l FROM walk WHERE k = (SELECT count(*) FROM e)),
        m AS (SELECT vec_id, 'label' || label AS kind, CASE WHEN vec_id IN (SELECT l FROM l) THEN vec_id ELSE (SELECT min(a) FROM near JOIN l ON a = l WHERE b = vec_id) END AS leader FROM e),
        n AS (SELECT leader, kind, count(*) AS n, row_number() OVER (PARTITION BY leader ORDER BY count(*) DESC, kind) AS r FROM m GROUP BY 1, 2)
        SELECT leader, sum(n)::BIGINT AS size, round(least(1.0::DOUBLE, sum(n) / 10::DOUBLE), 6) AS confidence, max(kind) FILTER (r = 1) || '_group' AS kind FROM n GROUP BY 1 HAVING sum(n) >= 3 ORDER BY leader LIMIT 50"""
)
def extract_concepts(spark, folder):
    e = _vectors(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(F.lit("label"), F.col("label")).alias("kind"))
    pairs = stored(relations.similarity_edges(e, e, 0.3).where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b")))
    return greedy.concepts(e.select("id", "kind"), pairs)


@query(
    """WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey AS id, p_name AS text, list_sort(list_distinct(string_split(p_name, ' '))) AS w, p_size / 50::DOUBLE AS score, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM part),
        w AS MATERIALIZED (SELECT w, min(k) AS k FROM p GROUP BY 1), s AS MATERIALIZED (SELECT a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS sim FROM w a JOIN w b ON a.k < b.k),
        o AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY k) AS n FROM w),
        walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT x.n + 1, CASE WHEN EXISTS (SELECT 1 FROM s WHERE b = o.k AND sim > 0.9 AND list_contains(x.kept, a)) THEN x.kept ELSE list_append(x.kept, o.k) END FROM walk x JOIN o ON o.n = x.n + 1),
        kept AS (SELECT unnest(kept) AS k FROM walk WHERE n = (SELECT count(*) FROM w))
        SELECT id, text, round(score * coalesce((SELECT product(1 - 0.3::DOUBLE * sim) FROM s WHERE b = p.k AND sim > 0.8 AND a IN (SELECT k FROM kept)), 1), 6) AS score FROM p WHERE k IN (SELECT k FROM kept)"""
)
def diversity_rerank(spark, folder):
    r = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), (F.col("p_size") / 50).alias("score"))
    return ranking.diversify(r)


# --- windows over events, joins and set operations ------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, folder):
    return streams.tumbling(read(spark, folder, "events"), "1 day", "event_type", "value")


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding_window(spark, folder):
    return streams.sliding(read(spark, folder, "events"), "12 hours", "6 hours", "event_type")


@query(
    """WITH g AS (SELECT *, (ts - lag(ts) OVER w > INTERVAL 6 HOUR)::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_window(spark, folder):
    return streams.sessions(read(spark, folder, "events"), "6 hours", "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi(spark, folder):
    o = read(spark, folder, "orders").where("o_totalprice > 400000")
    return read(spark, folder, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, folder):
    return read(spark, folder, "customer").join(read(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_ids(spark, folder):
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id")).subtract(read(spark, folder, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("SELECT p_partkey AS id FROM part WHERE p_size < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def intersect_ids(spark, folder):
    return read(spark, folder, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")).intersect(read(spark, folder, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query(
    """WITH p(name, lo, hi) AS (VALUES ('spring', TIMESTAMP '2024-01-03 06:00', TIMESTAMP '2024-01-09'), ('sale', TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-08 12:00'), ('late', TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-25'))
       SELECT name, count(*) AS n, round(sum(value), 6) AS total FROM p JOIN events ON ts >= lo AND ts < hi GROUP BY 1"""
)
def interval_join(spark, folder):
    rows = [("spring", "2024-01-03 06:00:00", "2024-01-09 00:00:00"), ("sale", "2024-01-08 00:00:00", "2024-01-08 12:00:00"), ("late", "2024-01-25 00:00:00", "2024-02-25 00:00:00")]
    spans = spark.createDataFrame(rows, "name string, lo string, hi string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("lo", "hi")})
    dealt = spans.withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))  # equal on the day, then within the span
    joined = read(spark, folder, "events").withColumn("day", F.to_date("ts")).join(dealt, "day").where("ts >= lo and ts < hi")
    return joined.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1")
def promo_revenue(spark, folder):
    cut = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    sold = read(spark, folder, "lineitem").where(F.col("l_shipdate") < cut).join(read(spark, folder, "part").where("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey"))
    return sold.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#17' AND contains(p_name, 'red') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def list_items(spark, folder):
    from taxolark.sources.items import listing

    return listing(read(spark, folder, "part").where(F.contains("p_name", F.lit("red"))), "p_retailprice", "p_partkey", 20, p_brand="Brand#17").select("p_partkey", "p_brand")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part")
def upsert(spark, folder):
    from taxolark.sources import items

    p = read(spark, folder, "part").select("p_partkey", "p_brand")
    return items.upsert(p, p.where("p_partkey % 10 = 0").withColumn("p_brand", F.lit("new")), "p_partkey")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1")
def latest_state(spark, folder):
    from taxolark.sources import items

    return items.latest(read(spark, folder, "events"), "user_id", "ts").select("user_id", "event_type", "value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey >= 50")
def cascade_delete(spark, folder):
    from taxolark.sources import items

    c = read(spark, folder, "customer")
    return items.delete(c, c.where("c_custkey < 50"), "c_custkey", (read(spark, folder, "orders"), "o_custkey"))[1].select("o_orderkey")


@query("SELECT p_partkey, 'Name: ' || p_name || ', size ' || p_size || '.' AS prompt FROM part")
def render_prompt(spark, folder):
    return read(spark, folder, "part").select("p_partkey", quality.render("Name: {{NAME}}, size {{SIZE}}.", {"NAME": F.col("p_name"), "SIZE": F.col("p_size")}).alias("prompt"))


@query("SELECT p_partkey, 1::INT AS n_attributes, 'kind' AS name, split_part(p_name, ' ', 2) AS value, 0 AS n_terms FROM part")
def parse_response(spark, folder):
    answer = F.concat(F.lit('Sure:\n```json\n{"attributes": [{"name": "kind", "value": "'), F.split("p_name", " ")[1], F.lit('", "evidence": "x", "confidence": 0.5}]}\n```'))
    got = quality.parse_response(answer)
    return read(spark, folder, "part").select("p_partkey", F.size(got["attributes"]).alias("n_attributes"), got["attributes"][0]["name"].alias("name"), got["attributes"][0]["value"].alias("value"), F.size(got["terms"]).alias("n_terms"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'electronic|computer|tech') THEN 'electronics' WHEN regexp_matches(lower(text), 'clothing|apparel|fashion') THEN 'fashion' WHEN regexp_matches(lower(text), 'food|beverage|drink') THEN 'food' WHEN regexp_matches(lower(text), 'home|furniture|decor') THEN 'home' ELSE 'general' END AS domain FROM documents")
def extract_domains(spark, folder):
    return read(spark, folder, "documents").select("doc_id", relations.domain(F.col("text")).alias("domain"))


@query("SELECT p_partkey, CASE WHEN p_size / 50::DOUBLE >= 0.9 THEN 'very_high' WHEN p_size / 50::DOUBLE >= 0.7 THEN 'high' WHEN p_size / 50::DOUBLE >= 0.5 THEN 'medium' WHEN p_size / 50::DOUBLE >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM part")
def confidence_levels(spark, folder):
    return read(spark, folder, "part").select("p_partkey", tf.semantic_level(F.col("p_size") / 50).alias("level"))
