"""Sources and stores, packs, requests, the search driver, models, governance, pipelines and streams over the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.operators import aggregate as agg
from taxolark.operators import filters as ff
from taxolark.operators import governance, mapping, pipeline, quality, relations, search, taxonomy, vocabulary
from taxolark.operators.stored import folder as shared
from taxolark.plans.registry import EDGES_SQL, TERMS_SQL, TREE_SQL, query, read, terms, tree
from taxolark.sources import items, models, packs
from taxolark.streaming import streams


def _place(spark, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def _values(rows: list[tuple]) -> str:
    """SQL of a few rows of texts and numbers."""

    def one(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    return "VALUES " + ", ".join(f"({', '.join(map(one, r))})" for r in rows)


# --- files -----------------------------------------------------------------------------------------


def _json_items(df: DataFrame, key: str, name: str, source: str) -> DataFrame:
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("item_id"), F.col(name).alias("title"), F.lit(source).alias("source"))).alias("value"))


def _as_array(lines: DataFrame) -> DataFrame:
    """One text that holds a JSON array: of the 25 nations, whatever the size of the tables."""
    return lines.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("value"))


@query("SELECT n_nationkey::VARCHAR AS item_id, n_name AS title, 'nations' AS source FROM nation")
def json_file_scan(spark, folder):
    path = _place(spark, "items")
    _as_array(_json_items(read(spark, folder, "nation"), "n_nationkey", "n_name", "nations")).coalesce(1).write.text(path)
    return items.read_file(spark, path).select("item_id", "title", "source")


@query("SELECT n_nationkey::VARCHAR AS item_id, n_name AS title FROM nation UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region WHERE r_regionkey = 0")
def json_directory_scan(spark, folder):
    """An array of objects in one file, one object in another, and a file that the pattern leaves out."""
    path = _place(spark, "items")
    array = _as_array(_json_items(read(spark, folder, "nation"), "n_nationkey", "n_name", "nations"))
    single = _json_items(read(spark, folder, "region").where("r_regionkey = 0"), "r_regionkey", "r_name", "regions")
    for one in (array, single):
        one.coalesce(1).write.mode("append").option("compression", "none").text(path)
    single.write.mode("append").option("compression", "gzip").text(path)
    return items.read_directory(spark, path, "*.txt").select("item_id", "title")


# --- stores ------------------------------------------------------------------------------------------

_ITEMS = "SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_type AS source, p_size FROM part"


def _items(spark, folder) -> DataFrame:
    return read(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("source"), "p_size")


@query(f"WITH i AS ({_ITEMS}) SELECT item_id, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS size, 'pending' AS status FROM i")
def insert_items(spark, folder):
    size = F.map_filter(F.create_map(F.lit("size"), F.col("p_size").cast("string")), lambda k, _: F.col("p_size") % 2 == 0)
    rows = _items(spark, folder).withColumns({"raw_attributes": size, "status": F.lit("done")})
    table = spark.createDataFrame([], "item_id string, raw_attributes map<string,string>, status string")
    return items.insert(table, rows.select("item_id", "raw_attributes", "status")).select("item_id", F.col("raw_attributes")["size"].alias("size"), "status")


@query(f"WITH i AS ({_ITEMS}) SELECT item_id, CASE WHEN item_id = '7' THEN 'completed' ELSE 'pending' END AS status, true AS found, false AS other FROM i")
def update_status(spark, folder):
    store = items.Store(spark, _place(spark, "store"))
    store.stage("items", _items(spark, folder).select("item_id", F.lit("pending").alias("status")))
    store.commit()
    found, other = items.status(store, "items", "item_id", "7", "completed"), items.status(store, "items", "item_id", "none", "completed")
    return store.read("items").withColumns({"found": F.lit(found), "other": F.lit(other)})


@query("SELECT 'items' AS table_name, 2 * count(*) AS n, 2 AS version FROM part UNION ALL SELECT 'nations', count(*), 2 FROM nation")
def transactions(spark, folder):
    """A commit of two tables, an append, and a change rolled back."""
    store = items.Store(spark, _place(spark, "store"))
    store.stage("items", _items(spark, folder))
    store.stage("nations", read(spark, folder, "nation"))
    store.commit()
    store.append("items", _items(spark, folder))
    store.commit()
    store.stage("nations", read(spark, folder, "nation").limit(0))
    store.append("items", _items(spark, folder))
    store.rollback()
    return store.health().withColumn("version", F.lit(store.version()))


@query("SELECT p_partkey::VARCHAR AS item_id, p_name AS title, upper(p_name) AS label, 'added,noted' AS log FROM part")
def schema_migrations(spark, folder):
    """A new store brought up to the third version and down to the second."""
    store = items.Store(spark, _place(spark, "store"))
    items.initialize(store)
    store.append("ingestion_items", _items(spark, folder).select("item_id", "title"))
    store.commit()
    known = [(1, "added", {"label": F.upper("title")}, ["label"]), (2, "noted", {"note": F.lit("x")}, ["note"]), (3, "marked", {"mark": F.lit(1)}, ["mark"])]
    items.migrate(store, "ingestion_items", known)
    items.migrate(store, "ingestion_items", known, to=2)
    rows = store.read("ingestion_items")
    if "mark" in rows.columns or "note" not in rows.columns:
        raise AssertionError("the third version is to be undone, the second not")
    done = items.migrations(store.read("schema_migrations"), [(v, n) for v, n, *_ in known]).where("applied").orderBy("version")
    log = done.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "name"))), lambda x: x["name"]), ",").alias("log"))  # one row
    return rows.select("item_id", "title", "label").crossJoin(F.broadcast(log))


@query(f"WITH {TREE_SQL} SELECT category_id AS source, 'child_of' AS relation, parent_id AS target FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT parent_id, 'parent_of', category_id FROM tree WHERE parent_id IS NOT NULL")
def category_edges(spark, folder):
    return taxonomy.edges(tree(spark, folder))


@query(f"WITH {TREE_SQL} SELECT category_id, CASE WHEN category_id = 'n3' THEN 'Renamed' ELSE name END AS name FROM tree UNION ALL SELECT 'new', 'New'")
def store_category(spark, folder):
    t = tree(spark, folder)
    renamed = t.where("category_id = 'n3'").withColumn("name", F.lit("Renamed"))
    return items.upsert(taxonomy.create(t, "new", "New", "r1"), renamed, "category_id").select("category_id", "name")


@query(f"WITH {TREE_SQL} SELECT category_id, name, level FROM tree WHERE path[1] = 'ASIA' AND level = 1 UNION ALL SELECT category_id, name, level FROM tree WHERE name = 'ASIA' AND path[1] = 'ASIA'")
def category_lookup(spark, folder):
    t = tree(spark, folder)
    return taxonomy.listing(t, domain="ASIA", level=1).select("category_id", "name", "level").unionAll(taxonomy.by_name(t, "ASIA", "ASIA").select("category_id", "name", "level"))


@query(f"WITH {TREE_SQL} SELECT category_id, name FROM tree WHERE path = ['ASIA', (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_name LIMIT 1)]")
def category_by_path(spark, folder):
    t = tree(spark, folder)
    name = t.where("level = 1 and path[0] = 'ASIA'").agg(F.min("name")).first()[0]
    return taxonomy.by_path(t, ["ASIA", name]).select("category_id", "name")


@query(f"WITH {TREE_SQL} SELECT category_id, name, parent_id, level::INT AS level, array_to_string(path, '/') AS path FROM tree UNION ALL SELECT 'x1', 'Atlantis', 'r2', 1, (SELECT r_name FROM region WHERE r_regionkey = 2) || '/Atlantis'")
def create_category(spark, folder):
    return taxonomy.create(tree(spark, folder), "x1", "Atlantis", "r2").select("category_id", "name", "parent_id", F.col("level").cast("int").alias("level"), F.array_join("path", "/").alias("path"))


@query(
    f"""WITH {TREE_SQL}, a AS (SELECT path FROM tree WHERE category_id = 'c1'), b AS (SELECT path FROM tree WHERE category_id = 'c2'),
        n AS (SELECT a.path AS a, b.path AS b, CASE WHEN a.path[1] <> b.path[1] THEN 0 WHEN a.path[2] <> b.path[2] THEN 1 ELSE 2 END AS s FROM a, b),
        w AS (SELECT category_id, CASE WHEN path = a[1:len(path)] AND len(path) >= s THEN len(a) - len(path) WHEN path = b[1:len(path)] AND len(path) > s THEN len(a) + len(path) - 2 * s END AS place FROM tree, n WHERE s > 0)
        SELECT place::INT AS place, category_id FROM w WHERE place IS NOT NULL"""
)
def category_path(spark, folder):
    return taxonomy.path_between(tree(spark, folder), "c1", "c2")


@query("SELECT n_nationkey AS id, n_name AS name, 'main' AS served, false AS graph_healthy FROM nation")
def storage_fallback(spark, folder):
    """A table preferred from a place that is down is served by the one that is always there."""

    def down(_: str) -> DataFrame:
        raise ConnectionError("the graph store doesn't answer")

    catalog = items.Catalog(lambda t: read(spark, folder, t), graph=down)
    catalog.prefer("nation", "graph")
    health = {r["place"]: r["healthy"] for r in catalog.health(spark, "nation").collect()}  # a row for each place
    return catalog.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(catalog.served("nation")).alias("served"), F.lit(health["graph"]).alias("graph_healthy"))


@query(
    """WITH d AS (SELECT doc_id, text, lang, source FROM documents), e AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(lang) > 1 AND lang = 'fr' THEN 'title' END, CASE WHEN length(text) > 5000 THEN 'description' END, CASE WHEN source = 'src5' THEN 'source' END, CASE WHEN lang = 'de' THEN 'language' END], lambda x: x IS NOT NULL)) AS field FROM d)
       SELECT field, count(*) AS n FROM e GROUP BY 1"""
)
def bulk_load(spark, folder):
    """Items with planted faults: the valid ones pass, each fault of the others is named."""
    d = read(spark, folder, "documents")
    made = d.select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.when(F.col("lang") == "fr", " ").otherwise("title").alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("source") != "src5", F.col("source")).alias("source"),
        F.when(F.col("lang") == "de", "german").otherwise(F.col("lang")).alias("language"),
    )
    _, bad = mapping.bulk_split(made, mapping.item_errors())
    return bad.select(F.explode("errors").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


# --- packs and taxonomy files -------------------------------------------------------------------------------

_PACK = {
    "domain": "parts",
    "taxonomy_version": "2024.01",
    "input_mapping": {"title": ["p_name"], "description": ["p_type"], "language": ["lang"]},
    "output_schema": {"core_item": ["title"], "attributes": [{"key": "color", "type": "categorical", "required": True}, {"key": "size", "type": "numeric"}]},
    "attribute_hints": {"color": {"allow_values": ["red", "blue"], "max_length": 9}},
}


def _written(text: str) -> str:
    """A file of the driver's own, which alone reads packs."""
    import tempfile
    from pathlib import Path

    at = Path(tempfile.mkdtemp(prefix="taxolark-")) / "parts"
    at.mkdir()
    (at / "domain.yaml").write_text(text, encoding="utf-8")
    return str(at.parent)


@query("SELECT * FROM (" + _values([("parts", "2024.01", "color", "categorical", True, "red,blue", 9), ("parts", "2024.01", "size", "numeric", False, "", None)]) + ") t(domain, version, key, kind, required, allowed, max_length)")
def pack_attributes(spark, folder):
    """A pack loaded from a folder found by a scan: its attributes with the hints laid over them."""
    loader = packs.Loader(2)
    found = packs.scan(_written(json.dumps(_PACK)))
    p = loader.load(found[0])
    rows = [(p.domain, p.taxonomy_version, a.key, a.kind, a.required, ",".join(a.allowed), a.max_length) for a in p.attributes()]
    return spark.createDataFrame(rows, "domain string, version string, key string, kind string, required boolean, allowed string, max_length int")


@query("SELECT * FROM (" + _values([("core_wins", "a", "text"), ("core_wins", "b", "date"), ("domain_wins", "a", "numeric"), ("domain_wins", "b", "date"), ("merge", "a", "numeric"), ("merge", "b", "date"), ("strict", "", "a: type differ")]) + ") t(strategy, key, kind)")
def pack_merge(spark, folder):
    core, own, rows = {"a": {"type": "text"}}, {"a": {"type": "numeric"}, "b": {"type": "date"}}, []
    for strategy in ("core_wins", "domain_wins", "merge", "strict"):
        try:
            rows += [(strategy, k, v["type"]) for k, v in packs.merge(core, own, strategy).items()]
        except packs.PackError as e:
            rows.append((strategy, "", str(e)))
    return spark.createDataFrame(rows, "strategy string, key string, kind string")


@query("SELECT * FROM (" + _values([("taxonomy_version must look like 2024.01",), ("input_mapping has no language",), ("hints for unknown attribute nope",)]) + ") t(problem)")
def pack_problems(spark, folder):
    bad = _PACK | {"taxonomy_version": "1.0", "input_mapping": {"title": ["a"], "description": ["b"]}, "attribute_hints": {"nope": {}, "color": {"allow_values": ["x"]}}}
    return spark.createDataFrame([(x,) for x in packs.problems(bad)], "problem string")


@query("SELECT n_nationkey::VARCHAR AS category_id, n_name AS name, 'r' || n_regionkey AS parent_id, 1 AS level FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL, 0 FROM region")
def taxonomy_file(spark, folder):
    """A nested category file of regions and nations, made flat."""
    nested = [{"id": f"r{r['r_regionkey']}", "name": r["r_name"], "children": []} for r in read(spark, folder, "region").collect()]  # 5 and 25 rows at any size
    by = {n["id"]: n for n in nested}
    for n in read(spark, folder, "nation").collect():
        by[f"r{n['n_regionkey']}"]["children"].append({"id": str(n["n_nationkey"]), "name": n["n_name"]})
    rows = taxonomy.flatten(json.loads(packs.export({"categories": nested}))["categories"])
    return spark.createDataFrame([r[:4] for r in rows], "category_id string, name string, parent_id string, level int")


# --- requests ------------------------------------------------------------------------------------------------------

_SHAPE = search.Shape("p_partkey", ("p_name",), "p_type")


@query("SELECT * FROM (" + _values([("Filter 0: field is empty",), ("Filter 1: operator 'near' is unknown",), ("Filter 2: in needs a list",), ("Filter 3: between needs two values",), ("Filter 4: eq needs a value",), ("query type 'odd' is unknown",), ("fuzzy threshold must be within 0 and 1",)]) + ") t(problem)")
def request_problems(spark, folder):
    filters = (ff.Filter(" ", "eq", 1), ff.Filter("a", "near", 1), ff.Filter("a", "in", "x"), ff.Filter("a", "between", [1]), ff.Filter("a", "eq"), ff.Filter("a", "is_null"))
    return spark.createDataFrame([(x,) for x in search.problems(search.Request("odd", filters=filters, fuzzy=2.0))], "problem string")


@query("SELECT * FROM (" + _values([(0, "p_type", "eq", "promo"), (1, "p_name", "contains", "red"), (2, "p_size", "gt", "5")]) + ") t(place, field, operator, value)")
def request_optimized(spark, folder):
    """Filters once, cheap ones first, fields and values in normal form."""
    r = search.Request("exact", "x", filters=(ff.Filter("p_size", "gt", 5), ff.Filter(" P_Name ", "contains", "RED"), ff.Filter("p_type", "eq", "PROMO"), ff.Filter("p_size", "gt", 5)))
    own = [ff.normal(f) for f in search.optimize(r).filters]
    return spark.createDataFrame([(i, f.field, f.operator, str(f.value)) for i, f in enumerate(own)], "place int, field string, operator string, value string")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size > 40")
def entity_types(spark, folder):
    r = search.Request("exact", "x", entity_types=("PROMO", "SMALL"), filters=(ff.Filter("p_size", "gt", 40),))
    return search.narrowed(read(spark, folder, "part"), r, _SHAPE).select("p_partkey")


@query("SELECT * FROM (" + _values([(1, "exact", True, False), (2, "exact", True, True), (3, "fuzzy", True, False), (4, "exact", True, False), (5, "semantic", False, False)]) + ") t(n, kind, success, cached)")
def search_history(spark, folder):
    """A request served from the cache, one after the cache has run out, and one that fails."""
    now = [0.0]
    driver = search.Driver(search.Engine(read(spark, folder, "part"), _SHAPE), ttl=60, clock=lambda: now[0])
    exact, fuzzy = search.Request("exact", "hot rod"), search.Request("fuzzy", "hot rodd")
    for at, r in ((1.0, exact), (2.0, exact), (3.0, fuzzy), (100.0, exact)):
        now[0] = at
        driver.run(r)
    try:
        now[0] = 101.0
        driver.run(search.Request("semantic"))
    except ValueError:
        pass
    w = driver.history().selectExpr("case when at < 50 then int(at) else int(at) - 96 end as n", "kind", "success", "cached")
    return w


@query("SELECT p_partkey::VARCHAR AS id, p_type AS entity_type, 1.0::DOUBLE AS score, '{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' AS data FROM part WHERE p_name = 'hot rod' ORDER BY p_partkey LIMIT 50")
def api_results(spark, folder):
    r = search.Request("exact", "Hot Rod", window=ff.Page(50))
    return search.api_shape(search.Engine(read(spark, folder, "part"), _SHAPE).run(r), _SHAPE, ["p_name", "p_size"])


@query("SELECT true AS success, count(*) AS total, least(2, count(*)) AS listed FROM part WHERE p_name = 'hot rod'")
def api_response(spark, folder):
    """A page of two, and how many there are in all."""
    r = search.Request("exact", "Hot Rod", window=ff.Page(2))
    answer = search.api_response(search.Engine(read(spark, folder, "part"), _SHAPE), r, ["p_name"])
    listed = F.size(F.from_json("response", "results array<struct<id: string>>")["results"])
    return answer.select("success", "total", listed.cast("long").alias("listed"))


@query("SELECT lang AS kind, count(*) AS documents, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')))::BIGINT AS sections, sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS words, max(doc_id) AS updated FROM documents GROUP BY 1")
def document_stats(spark, folder):
    return agg.document_stats(read(spark, folder, "documents"), "lang", "text", "doc_id")


@query(
    """SELECT event_id, lag(value) OVER w AS previous, lead(value) OVER w AS next, ntile(4) OVER w::INT AS tile, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running,
       round(avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def window_frames(spark, folder):
    return agg.frames(read(spark, folder, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "previous", "next", "tile", "running", "moving")


@query("SELECT p_partkey, round(sin(p_size) + cos(p_size) * atan2(p_size, 2), 6) AS wave, round(sqrt(p_size) + ln(p_size) + exp(p_size / 50::DOUBLE), 6) AS grown, (p_size & 12) | (p_size << 1) AS bits, xor(p_size, 5) AS turned FROM part")
def math_functions(spark, folder):
    n = F.col("p_size")
    wave = F.sin(n) + F.cos(n) * F.atan2(n.cast("double"), F.lit(2.0))
    grown = F.sqrt(n) + F.ln(n) + F.exp(n / 50)
    return read(spark, folder, "part").select("p_partkey", F.round(wave, 6).alias("wave"), F.round(grown, 6).alias("grown"), n.bitwiseAND(12).bitwiseOR(F.shiftleft(n, 1)).alias("bits"), n.bitwiseXOR(F.lit(5)).alias("turned"))


# --- vocabulary --------------------------------------------------------------------------------------------------------

_HANGING = f"""{TERMS_SQL}, types AS (SELECT vocabulary_type, min(term_id) AS up FROM terms GROUP BY 1),
  h AS (SELECT term_id, CASE WHEN term_id <> up THEN up WHEN up <> (SELECT min(term_id) FROM terms) THEN (SELECT min(term_id) FROM terms) END AS parent_term_id FROM terms JOIN types USING (vocabulary_type))"""


def _hanging(spark, folder) -> DataFrame:
    """Terms under the first of their type, and these under the first of all."""
    t = terms(spark, folder)
    up = t.groupBy("vocabulary_type").agg(F.min("term_id").alias("up"))
    top = t.agg(F.min("term_id").alias("top"))  # one row
    parent = F.when(F.col("term_id") != F.col("up"), F.col("up")).when(F.col("up") != F.col("top"), F.col("top"))
    return t.join(up, "vocabulary_type").crossJoin(F.broadcast(top)).select("term_id", parent.alias("parent_term_id"))


@query(
    f"""WITH RECURSIVE {_HANGING}, r AS (SELECT term_id, parent_term_id, term_id AS root_id, 0 AS depth, [term_id] AS path FROM h WHERE parent_term_id IS NULL
        UNION ALL SELECT h.term_id, h.parent_term_id, r.root_id, r.depth + 1, list_append(r.path, h.term_id) FROM h JOIN r ON h.parent_term_id = r.term_id)
        SELECT term_id, root_id, depth, array_to_string(path, '>') AS path FROM r"""
)
def vocabulary_hierarchy(spark, folder):
    h = vocabulary.Hierarchy(_hanging(spark, folder))
    return h.reached.select("term_id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {_HANGING}, t AS (SELECT min(term_id) AS top FROM terms) SELECT term_id, 1 AS distance FROM h, t WHERE parent_term_id = top UNION ALL SELECT h.term_id, 2 FROM h JOIN h u ON h.parent_term_id = u.term_id, t WHERE u.parent_term_id = top")
def term_descendants(spark, folder):
    h = _hanging(spark, folder)
    return vocabulary.Hierarchy(h).descendants(h.agg(F.min("term_id")).first()[0], 2)


@query("SELECT DISTINCT p_name AS value, CASE WHEN contains(p_name, 'red') THEN 'colour' WHEN regexp_matches(p_name, 'rod$') THEN 'bar' END AS term FROM part")
def rule_match(spark, folder):
    return vocabulary.rule_matches(read(spark, folder, "part").select(F.col("p_name").alias("value")).distinct(), [("RED", "colour"), ("rod$", "bar")])


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, b AS MATERIALIZED (SELECT source AS a, target AS b, confidence AS score FROM edges UNION ALL SELECT target, source, confidence FROM edges),
        r8 AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b.b, root FROM r8 JOIN b ON node = a WHERE score >= 0.8), r6 AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b.b, root FROM r6 JOIN b ON node = a WHERE score >= 0.6)
        SELECT node, 0.8::DOUBLE AS level, min(root) AS cluster FROM r8 GROUP BY 1 UNION ALL SELECT node, 0.6::DOUBLE, min(root) FROM r6 GROUP BY 1"""
)
def hierarchical_clusters(spark, folder):
    from taxolark.operators.stored import stored
    from taxolark.plans.registry import edges

    e = stored(edges(spark, folder).select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("confidence").alias("score")))
    return vocabulary.hierarchical(read(spark, folder, "part").select(F.col("p_partkey").alias("node")), e, [0.6, 0.8])


# --- models, governance, pipelines, streams ------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN length('extract ' || p_name)::VARCHAR END AS response FROM part")
def model_answers(spark, folder):
    """A client that refuses some prompts: after its tries their answer is null."""

    def client(p: str) -> str:
        if p.endswith("!"):
            raise RuntimeError("refused")
        return str(len(p))

    prompts = read(spark, folder, "part").select("p_partkey", F.concat(F.lit("extract "), "p_name", F.when(F.col("p_size") % 10 == 0, "!").otherwise("")).alias("prompt"))
    return models.complete(prompts, "prompt", client, retries=2, wait=0).select("p_partkey", "response")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE length(p_name)::DOUBLE END AS first, CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS second FROM part")
def model_embeddings(spark, folder):
    texts = read(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(" ").alias("t"))
    out = models.embed(texts, "t", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    return out.select("p_partkey", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


@query("SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def pending_embeddings(spark, folder):
    have = read(spark, folder, "embeddings").select(F.col("vec_id").alias("entity_id"), (F.col("label") < 5).alias("is_active"))
    return models.pending(read(spark, folder, "part").select(F.col("p_partkey").alias("entity_id")), have)


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey % 4 >= 2")
def access_levels(spark, folder):
    level = F.element_at(F.array(*map(F.lit, governance.LEVELS)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return governance.allowed(read(spark, folder, "customer").select("c_custkey", level.alias("level"), (F.col("c_acctbal") > 0).alias("is_active")), "admin").select("c_custkey")


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) WHERE last_seen > TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 24 HOUR")
def valid_sessions(spark, folder):
    last = read(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return governance.sessions_valid(last, "2024-01-29 12:00:00").select("user_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def recorded_metrics(spark, folder):
    """Metrics recorded in two goes, and the last thousand read back."""
    log, e = governance.MetricLog(spark, _place(spark, "metrics")), read(spark, folder, "events")
    metrics = e.select(F.col("event_type").alias("name"), "value", F.col("ts").alias("at"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("key"))
    log.record(metrics.where("name <> 'error'"))
    log.record(metrics.where("name = 'error'"))
    return log.last(1000).select(F.col("key").cast("long").alias("event_id"))


@query("SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def metric_summary(spark, folder):
    log, e = governance.MetricLog(spark, _place(spark, "metrics")), read(spark, folder, "events")
    log.record(e.select(F.col("event_type").alias("name"), "value", F.col("ts").alias("at"), F.col("event_id").alias("key")))
    return log.summary("2024-01-10").select("name", "n", F.round("mean", 6).alias("mean"), "least", "most")


@query("SELECT p_partkey AS item_id, p_name AS title, [p_brand, p_type] AS path, p_size AS size FROM part")
def exported_items(spark, folder):
    """Items written as JSON lines and as one CSV row each, read back from both: the nested field from the first, numbers from the second."""
    at, p = _place(spark, "export"), read(spark, folder, "part")
    own = p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("path"), F.col("p_size").alias("size"))
    items.export(own, f"{at}/json", "json")
    items.export(own.withColumn("path", F.array_join("path", "/")), f"{at}/csv", "csv")
    told = spark.read.schema(own.schema).json(f"{at}/json").select("item_id", "title", "path")
    flat = spark.read.schema("item_id long, title string, path string, size int").csv(f"{at}/csv", header=True, escape='"', multiLine=True)
    return told.join(flat.select("item_id", "size"), "item_id")


@query("SELECT p_partkey, upper(p_name) AS name FROM part WHERE p_size > 25")
def named_pipeline(spark, folder):
    p = pipeline.Pipelines()
    p.register("large", lambda df: df.where("p_size > 25"))
    p.register("shout", lambda df: df.select("p_partkey", F.upper("p_name").alias("name")))
    return p.run("shout", p.run("large", read(spark, folder, "part")))


@query("SELECT event_id, event_type = 'error' AS failed FROM events")
def stream_ingest(spark, folder):
    """Events as a stream of files: the failed ones go to a folder of their own, the rest arrives."""
    at = _place(spark, "stream")
    source = read(spark, folder, "events").select("event_id", "event_type")
    source.write.parquet(f"{at}/in")
    stream = streams.read(spark, f"{at}/in", source.schema)
    q = streams.ingest(stream, lambda b: b.withColumn("errors", F.when(F.col("event_type") == "error", F.array(F.lit("error")))), f"{at}/good", f"{at}/bad", f"{at}/checkpoint")
    q.awaitTermination()
    good, bad = spark.read.parquet(f"{at}/good"), spark.read.parquet(f"{at}/bad")
    return good.select("event_id", F.lit(False).alias("failed")).unionAll(bad.select("event_id", F.lit(True)))


@query(
    f"""WITH {TERMS_SQL}, c AS (SELECT p_brand || ' ' || p_type AS term, count(*) AS frequency, round(avg(p_size) / 30, 6) AS confidence FROM part GROUP BY 1)
        SELECT term, CASE WHEN frequency >= 5 AND confidence >= 0.7 THEN 'elevate' WHEN frequency < 3 THEN 'deprecate' ELSE 'keep' END AS status FROM c"""
)
def candidate_workflow(spark, folder):
    """Candidates taken in, scored, then elevated, kept or deprecated."""
    c = read(spark, folder, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("term")).agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("p_size") / 30, 6).alias("confidence"))
    p = pipeline.Pipelines()
    p.register("elevate", lambda df: df.withColumn("status", F.when((F.col("frequency") >= 5) & (F.col("confidence") >= 0.7), "elevate")))
    p.register("deprecate", lambda df: df.withColumn("status", F.coalesce("status", F.when(F.col("frequency") < 3, "deprecate"), F.lit("keep"))))
    return p.run("deprecate", p.run("elevate", c)).select("term", "status")


@query(f"WITH {TREE_SQL} SELECT category_id, length(name) AS size, len(path) = level + 1 AS sound FROM tree")
def row_constraints(spark, folder):
    """Rows whose path, level and name agree: none of the tree is in the list of issues of that kind."""
    t = tree(spark, folder)
    bad = taxonomy.issues(t, crowded=10**9).select("category_id").distinct().withColumn("bad", F.lit(True))
    return t.join(bad, "category_id", "left").select("category_id", F.length("name").alias("size"), F.col("bad").isNull().alias("sound"))


@query("SELECT c_custkey, c_acctbal > 1000 AND c_mktsegment <> 'MACHINERY' AS fine FROM customer")
def attribute_rules(spark, folder):
    """Values against an attribute's type and allowed values."""
    segment = quality.Attribute("c_mktsegment", "categorical", True, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))
    df = read(spark, folder, "customer")
    return df.select("c_custkey", ((F.size(quality.value_errors(F.col("c_mktsegment"), segment)) == 0) & (F.col("c_acctbal") > 1000)).alias("fine"))


@query(f"WITH {EDGES_SQL} SELECT source, target, confidence FROM edges WHERE relation = 'synonym'")
def synonym_edges(spark, folder):
    from taxolark.plans.registry import edges

    return relations.pattern(edges(spark, folder), ["synonym"]).toDF("source", "target").join(edges(spark, folder).select("source", "target", "confidence"), ["source", "target"])
