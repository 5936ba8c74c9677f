"""Category trees as DataFrames: (category_id, name, parent_id, level, path, status, ...).

``path`` is the array of names from the root to the category itself; paths are trusted
where an operator says so, and rebuilt by a bounded recursion where it doesn't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The deepest level there can be: a path holds ten names at most.
MAX_LEVEL = 9
#: Sorts after every name.
LAST = "\U0010ffff"


def _view(df: DataFrame) -> str:
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def paths(nodes: DataFrame, depth: int = MAX_LEVEL) -> DataFrame:
    """Level and path of (category_id, name, parent_id), by recursion from the roots; orphans are not reached."""
    v = _view(nodes.select("category_id", "name", "parent_id"))
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE t(category_id, name, parent_id, level, path) MAX RECURSION LEVEL {depth + 2} AS (
              SELECT category_id, name, parent_id, 0, array(name) FROM {v} WHERE parent_id IS NULL
              UNION ALL
              SELECT c.category_id, c.name, c.parent_id, t.level + 1, concat(t.path, array(c.name)) FROM {v} c JOIN t ON c.parent_id = t.category_id WHERE t.level < {depth})
            SELECT * FROM t"""
    )


def descendants(tree: DataFrame, root: str, depth: int = MAX_LEVEL) -> DataFrame:
    """(category_id, depth) below a category, by parents."""
    v = _view(tree.select("category_id", "parent_id"))
    return tree.sparkSession.sql(
        f"""WITH RECURSIVE t(category_id, depth) MAX RECURSION LEVEL {depth + 2} AS (
              SELECT category_id, 1 FROM {v} WHERE parent_id = :root
              UNION ALL
              SELECT c.category_id, t.depth + 1 FROM {v} c JOIN t ON c.parent_id = t.category_id WHERE t.depth < {depth})
            SELECT * FROM t""",
        args={"root": root},
    )


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor_id, category_id, distance): every category with itself and all above it."""
    up = tree.select(F.col("category_id").alias("id"), F.col("parent_id").alias("up"))
    own = tree.select(F.col("category_id").alias("ancestor_id"), "category_id", F.lit(0).alias("distance"))
    out, edge = own, own
    for i in range(1, MAX_LEVEL + 1):
        edge = edge.join(up, F.col("ancestor_id") == F.col("id")).where("up is not null").select(F.col("up").alias("ancestor_id"), "category_id", F.lit(i).alias("distance"))
        out = out.unionByName(edge)
    return out


def ancestors(tree: DataFrame, category: str) -> DataFrame:
    """Rows above a category, root first: those whose path begins its path (paths are trusted)."""
    one = F.broadcast(tree.where(F.col("category_id") == category).select(F.col("path").alias("_own")).limit(1))
    above = (F.size("path") < F.size("_own")) & (F.slice(F.col("_own"), F.lit(1), F.size("path")) == F.col("path"))
    return tree.join(one, above).drop("_own").orderBy(F.size("path"))


def breadcrumbs(tree: DataFrame, category: str) -> DataFrame:
    return ancestors(tree, category).unionByName(tree.where(F.col("category_id") == category)).orderBy("level")


def children(tree: DataFrame, category: str) -> DataFrame:
    return tree.where(F.col("parent_id") == category).orderBy("name")


def siblings(tree: DataFrame, category: str) -> DataFrame:
    """Other categories under the same parent; roots are siblings of each other."""
    one = F.broadcast(tree.where(F.col("category_id") == category).select(F.col("parent_id").alias("_p")).limit(1))
    return tree.join(one, F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("category_id") != category)).drop("_p")


def subtree(tree: DataFrame, path: list[str]) -> DataFrame:
    """Categories whose path begins with a path (paths are trusted)."""
    return tree.where(F.slice("path", 1, len(path)) == F.array(*map(F.lit, path)))


def by_path(tree: DataFrame, path: list[str]) -> DataFrame:
    return tree.where(F.col("path") == F.array(*map(F.lit, path)))


def subtree_size(tree: DataFrame) -> DataFrame:
    """(category_id, size): itself and all below; each category counts once for every beginning of its path."""
    starts = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice(F.col("path"), F.lit(1), i))
    counts = tree.select(F.explode(starts).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    return tree.select("category_id", "path").join(counts, "path").select("category_id", "size")


def traverse(tree: DataFrame, order: str) -> DataFrame:
    """Rows in breadth-first, pre-order or post-order, siblings by name (paths are trusted)."""
    if order == "breadth_first":
        return tree.orderBy("level", "path", "category_id")
    if order == "pre_order":
        return tree.orderBy("path", "category_id")
    if order == "post_order":
        return tree.orderBy(F.concat("path", F.array(F.lit(LAST))), "category_id")
    raise ValueError(f"order {order!r} is unknown")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))
    return state["n"]


def common_ancestor(a: Column, b: Column) -> Column:
    """The path that two paths share."""
    return F.slice(a, F.lit(1), common_prefix(a, b))


def search(tree: DataFrame, query: str, descriptions: bool = True, limit: int = 50) -> DataFrame:
    """Scored by name (equal 1, beginning .8, inside .6), else label .5; description .4 and path .3 at least."""
    q = query.lower().strip()
    if not q:
        return tree.withColumn("score", F.lit(1.0)).orderBy("name").limit(limit)
    name = F.lower("name")
    label = F.exists(F.map_values("labels"), lambda x: F.contains(F.lower(x), F.lit(q))) if "labels" in tree.columns else F.lit(False)
    by_name = F.when(name == q, 1.0).when(F.startswith(name, F.lit(q)), 0.8).when(F.contains(name, F.lit(q)), 0.6).when(label, 0.5).otherwise(0.0)
    parts = [by_name, F.when(F.exists("path", lambda x: F.contains(F.lower(x), F.lit(q))), 0.3).otherwise(0.0)]
    if descriptions and "description" in tree.columns:
        parts.append(F.when(F.contains(F.lower("description"), F.lit(q)), 0.4).otherwise(0.0))
    return tree.withColumn("score", F.greatest(*parts)).where("score > 0").orderBy(F.desc("score"), "name", "category_id").limit(limit)


def similarity(a: str, b: str) -> Column:
    """Of two joined trees with column prefixes: .4 equal name or .2 containment, .2 level, .3 shared path, .1 status; 1 at most."""
    x, y = F.lower(f"{a}name"), F.lower(f"{b}name")
    name = F.when(x == y, 0.4).when(F.contains(x, y) | F.contains(y, x), 0.2).otherwise(0.0)
    low = lambda p: F.transform(p, lambda e: F.lower(e))
    shared = common_prefix(low(F.col(f"{a}path")), low(F.col(f"{b}path"))) / F.greatest(F.size(f"{a}path"), F.size(f"{b}path"))
    level = F.when(F.col(f"{a}level") == F.col(f"{b}level"), 0.2).otherwise(0.0)
    status = F.when(F.col(f"{a}status") == F.col(f"{b}status"), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), name + level + shared * 0.3 + status)


def similar(tree: DataFrame, category: str, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    """(category_id, score) of the categories most like one."""
    cols = ("category_id", "name", "level", "path", "status")
    one = tree.where(F.col("category_id") == category).select(*[F.col(c).alias(f"a_{c}") for c in cols]).limit(1)
    rest = tree.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    scored = rest.join(F.broadcast(one), F.col("a_category_id") != F.col("b_category_id")).withColumn("score", F.round(similarity("a_", "b_"), 6))
    return scored.where(F.col("score") >= threshold).select(F.col("b_category_id").alias("category_id"), "score").orderBy(F.desc("score"), "category_id").limit(limit)


def by_name(tree: DataFrame, name: str, domain: str | None = None) -> DataFrame:
    """Categories of a name, of a domain (the first name of the path) if it is given."""
    out = tree.where(F.col("name") == name)
    return out if domain is None else out.where(F.get("path", F.lit(0)) == domain)


def listing(tree: DataFrame, domain: str | None = None, parent_id: str | None = None, level: int | None = None) -> DataFrame:
    """Categories of a domain, parent and level, as far as given, by level, then name, then id."""
    if domain is not None:
        tree = tree.where(F.get("path", F.lit(0)) == domain)
    if parent_id is not None:
        tree = tree.where(F.col("parent_id") == parent_id)
    if level is not None:
        tree = tree.where(F.col("level") == level)
    return tree.orderBy("level", "name", "category_id")


def edges(tree: DataFrame) -> DataFrame:
    """(source, relation, target): each category's two edges to its parent, one either way."""
    up = tree.where("parent_id is not null")
    return up.select(F.col("category_id").alias("source"), F.lit("child_of").alias("relation"), F.col("parent_id").alias("target")).unionAll(up.select("parent_id", F.lit("parent_of"), "category_id"))


def path_between(tree: DataFrame, source: str, target: str) -> DataFrame:
    """(place, category_id): the way from one category up to the common ancestor and down to another (paths are trusted); no rows if there is none."""
    ends = tree.where(F.col("category_id").isin(source, target)).select("category_id", "path")
    a = ends.where(F.col("category_id") == source).select(F.col("path").alias("a")).limit(1)
    b = ends.where(F.col("category_id") == target).select(F.col("path").alias("b")).limit(1)
    both = F.broadcast(a.crossJoin(b).withColumn("shared", common_prefix(F.col("a"), F.col("b"))).where("shared > 0"))  # one row each
    depth = F.size("path")
    on_a = (depth <= F.size("a")) & (F.slice(F.col("a"), F.lit(1), depth) == F.col("path")) & (depth >= F.col("shared"))
    on_b = (depth <= F.size("b")) & (F.slice(F.col("b"), F.lit(1), depth) == F.col("path")) & (depth > F.col("shared"))
    place = F.when(on_a, F.size("a") - depth).otherwise(F.size("a") + depth - 2 * F.col("shared"))
    return tree.join(both, on_a | on_b).select(place.cast("int").alias("place"), "category_id").orderBy("place")


# --- changes: each returns the new tree ------------------------------------------------


def create(tree: DataFrame, category_id: str, name: str, parent_id: str | None = None) -> DataFrame:
    """The tree with a category more; an error if the parent is missing, the name taken or the path too long."""
    row = tree.where(F.col("category_id") == parent_id).select("level", "path").first() if parent_id is not None else None
    if parent_id is not None and row is None:
        raise ValueError(f"parent {parent_id!r} doesn't exist")
    if not tree.where((F.lower("name") == name.lower()) | (F.col("category_id") == category_id)).isEmpty():
        raise ValueError(f"category {name!r} exists")
    level, path = (0, [name]) if row is None else (row["level"] + 1, [*row["path"], name])
    if level > MAX_LEVEL:
        raise ValueError("the path is too long")
    new = {"category_id": category_id, "name": name, "parent_id": parent_id, "level": level, "path": path, "status": "active"}
    one = tree.sparkSession.createDataFrame([tuple(new.get(f.name) for f in tree.schema.fields)], tree.schema)
    return tree.unionByName(one)


def move(tree: DataFrame, category_id: str, parent_id: str | None) -> DataFrame:
    """The tree with a category and all below it under another parent; under itself or its own descendants is an error."""
    own = tree.where(F.col("category_id") == category_id).select("path", "name").first()
    if own is None:
        raise ValueError(f"category {category_id!r} doesn't exist")
    up: list[str] = []
    if parent_id is not None:
        row = tree.where(F.col("category_id") == parent_id).select("path").first()
        if row is None:
            raise ValueError(f"parent {parent_id!r} doesn't exist")
        up = row["path"]
        if up[: len(own["path"])] == own["path"]:
            raise ValueError("a category can't move below itself")
    at, new = len(own["path"]), [*up, own["name"]]
    inside = F.slice("path", 1, at) == F.array(*map(F.lit, own["path"]))
    path = F.when(inside, F.concat(F.array(*map(F.lit, new)), F.slice(F.col("path"), F.lit(at + 1), F.size("path")))).otherwise(F.col("path"))
    parent = F.when(F.col("category_id") == category_id, F.lit(parent_id)).otherwise(F.col("parent_id"))
    return tree.withColumns({"path": path, "parent_id": parent}).withColumn("level", F.size("path") - 1)


def merge(tree: DataFrame, source: str, target: str) -> DataFrame:
    """The tree with a category merged into another: its children move, it is marked, labels are united (the source's win)."""
    s = tree.where(F.col("category_id") == source).select("path").first()
    t = tree.where(F.col("category_id") == target).select("path").first()
    if s is None or t is None or source == target:
        raise ValueError("source and target must be two categories")
    at = len(s["path"])
    below = (F.slice("path", 1, at) == F.array(*map(F.lit, s["path"]))) & (F.size("path") > at)
    path = F.when(below, F.concat(F.array(*map(F.lit, t["path"])), F.slice(F.col("path"), F.lit(at + 1), F.size("path")))).otherwise(F.col("path"))
    out = tree.withColumns(
        {
            "path": path,
            "parent_id": F.when(F.col("parent_id") == source, F.lit(target)).otherwise(F.col("parent_id")),
            "status": F.when(F.col("category_id") == source, F.lit("merged")).otherwise(F.col("status")),
            "merged_into": F.when(F.col("category_id") == source, F.lit(target)),
        }
    ).withColumn("level", F.size("path") - 1)
    if "labels" in tree.columns:
        theirs = tree.where(F.col("category_id") == source).select(F.col("labels").alias("theirs")).limit(1)
        out = out.join(F.broadcast(theirs)).withColumn(
            "labels", F.when(F.col("category_id") == target, F.map_concat(F.map_filter("labels", lambda k, _: ~F.coalesce(F.map_contains_key("theirs", k), F.lit(False))), "theirs")).otherwise(F.col("labels"))
        ).drop("theirs")
    return out


def delete(tree: DataFrame, category_id: str, recursive: bool = False) -> DataFrame:
    """The tree with a category marked deprecated, with all below it if recursive; else children are an error."""
    gone = descendants(tree, category_id).select("category_id")
    if not recursive and not gone.isEmpty():
        raise ValueError("the category has children")
    gone = gone.unionAll(tree.where(F.col("category_id") == category_id).select("category_id")).withColumn("gone", F.lit(True))
    return tree.join(gone, "category_id", "left").withColumn("status", F.when(F.col("gone"), "deprecated").otherwise(F.col("status"))).drop("gone")


# --- figures and checks -----------------------------------------------------------------


def stats(tree: DataFrame) -> DataFrame:
    """One row: total, max_level, mean_level, roots, leaves, orphans."""
    parents = tree.where("parent_id is not null").select(F.col("parent_id").alias("p")).distinct().withColumn("has", F.lit(1))
    known = tree.select(F.col("category_id").alias("k")).distinct().withColumn("known", F.lit(1))
    joined = tree.join(parents, F.col("category_id") == F.col("p"), "left").join(known, F.col("parent_id") == F.col("k"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.max("level").cast("long").alias("max_level"),
        F.round(F.avg("level"), 6).alias("mean_level"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count_if(F.col("has").isNull()).alias("leaves"),
        F.count_if(F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("orphans"),
    )


def tree_statistics(tree: DataFrame) -> DataFrame:
    """One row: nodes, internal nodes, branching factor (children per internal node), share of leaves."""
    kids = tree.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("kids"))
    joined = tree.join(kids.withColumnRenamed("parent_id", "p"), F.col("category_id") == F.col("p"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("kids").isNotNull()).alias("internal"),
        F.round(F.sum("kids") / F.count_if(F.col("kids").isNotNull()), 2).alias("branching"),
        F.round(F.count_if(F.col("kids").isNull()) / F.count(F.lit(1)), 6).alias("leaf_ratio"),
    )


def depth_histogram(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def issues(tree: DataFrame, crowded: int = 15) -> DataFrame:
    """(issue, category_id): orphans, wrong levels and paths, duplicate names, crowded parents, roots without children, too deep."""
    up = tree.select(F.col("category_id").alias("k"), F.col("level").alias("up_level"), F.col("path").alias("up_path"))
    joined = tree.join(up, F.col("parent_id") == F.col("k"), "left")
    parts = [
        joined.where("parent_id is not null and k is null").select(F.lit("orphan").alias("issue"), "category_id"),
        joined.where("k is not null and level <> up_level + 1").select(F.lit("level"), "category_id"),
        joined.where("k is not null and slice(path, 1, size(path) - 1) <> up_path").select(F.lit("path"), "category_id"),
        joined.where("size(path) <> level + 1 or element_at(path, -1) <> name").select(F.lit("path_shape"), "category_id"),
        tree.join(tree.groupBy("parent_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("parent_id").alias("p"), F.col("name").alias("m")), F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m"))).select(F.lit("duplicate_name"), "category_id"),
        tree.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).where(f"parent_id is not null and n > {crowded}").select(F.lit("crowded"), F.col("parent_id")),
        tree.where(f"level > {MAX_LEVEL}").select(F.lit("too_deep"), "category_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def placement(tree: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """(category_id, score): where a new category would fit, by words shared with names on the path."""
    from taxolark.functions.text import words

    wanted = F.array_distinct(words(F.lower(F.lit(name))))
    own = F.array_distinct(words(F.lower(F.array_join("path", " "))))
    score = F.size(F.array_intersect(own, wanted)) / F.size(F.array_union(own, wanted))
    return tree.withColumn("score", F.round(score, 6)).where("score > 0").select("category_id", "score").orderBy(F.desc("score"), "category_id").limit(limit)


def cytoscape(tree: DataFrame) -> DataFrame:
    """(element): nodes and edges as JSON, for graph drawing."""
    nodes = tree.select(F.to_json(F.struct(F.struct(F.col("category_id").alias("id"), F.col("name").alias("label"), "level").alias("data"))).alias("element"))
    edges = tree.where("parent_id is not null").select(F.to_json(F.struct(F.struct(F.col("parent_id").alias("source"), F.col("category_id").alias("target")).alias("data"))).alias("element"))
    return nodes.unionAll(edges)


def flatten(nested: list[dict]) -> list[tuple[str, str, str | None, int, list[str], list[str]]]:
    """Rows (category_id, name, parent_id, level, path, attributes) of a nested category file; levels start at 0."""
    out, todo = [], [(c, None, []) for c in reversed(nested)]
    while todo:
        node, parent, up = todo.pop()
        path = [*up, node["name"]]
        out.append((str(node["id"]), node["name"], parent, len(path) - 1, path, list(node.get("attributes") or [])))
        todo += [(c, str(node["id"]), path) for c in reversed(node.get("children") or [])]
    return out
