"""Named queries over the tables of a folder, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name; without SQL it is tested otherwise."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- the reference notions in terms of the tables -----------------------------------------

TREE_SQL = """tree AS (
  SELECT 'r' || r_regionkey AS category_id, r_name AS name, NULL::VARCHAR AS parent_id, 0 AS level, [r_name] AS path, 'active' AS status FROM region
  UNION ALL
  SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 1, [r_name, n_name], 'active' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey, 2, [r_name, n_name, c_name], 'active' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations and customers as a category tree."""
    r, n, c = (read(spark, folder, t) for t in ("region", "nation", "customer"))
    rn = F.broadcast(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows at any size
    a = F.lit("active").alias("status")
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("category_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.array("r_name").alias("path"), a)
    mid = rn.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"), F.lit(1), F.array("r_name", "n_name"), a)
    low = c.join(rn, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey"), "c_name", F.concat(F.lit("n"), "c_nationkey"), F.lit(2), F.array("r_name", "n_name", "c_name"), a)
    return top.unionAll(mid).unionAll(low)


TERMS_SQL = """terms AS (
  SELECT min(p_partkey) AS term_id, p_name AS term, split_part(p_name, ' ', 2) AS vocabulary_type, min(p_type) AS category_id,
         [split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)] AS aliases, (count(l_partkey))::BIGINT AS usage_count
  FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_name)"""


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as a vocabulary, used as often as they are sold; the alias has the words the other way round."""
    p, sold = read(spark, folder, "part"), read(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("sold"))
    w = F.split("p_name", " ")
    named = p.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_name").agg(F.min("p_partkey").alias("term_id"), F.min("p_type").alias("category_id"), F.coalesce(F.sum("sold"), F.lit(0)).cast("long").alias("usage_count"))
    return named.select("term_id", F.col("p_name").alias("term"), w[1].alias("vocabulary_type"), "category_id", F.array(F.concat_ws(" ", w[1], w[0])).alias("aliases"), "usage_count")


EDGES_SQL = """basket AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
together AS MATERIALIZED (SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS n FROM basket a JOIN basket b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
edges AS MATERIALIZED (
  SELECT source, target, CASE WHEN p.p_brand = q.p_brand THEN 'synonym' WHEN p.p_type = q.p_type THEN 'similar' ELSE 'related' END AS relation, least(1.0::DOUBLE, n / 4.0::DOUBLE) AS confidence
  FROM together JOIN part p ON source = p.p_partkey JOIN part q ON target = q.p_partkey)"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Parts bought together in two orders or more; brand and type tell the relation.

    Parts meet pairs by a shuffle at any size: a compressed table that is small enough to
    be broadcast can take hundreds of MB in every task that counts pairs.
    """
    from taxolark.operators.vocabulary import cooccurrence

    pairs = cooccurrence(read(spark, folder, "lineitem"), "l_partkey", "l_orderkey", 2).toDF("source", "target", "n")
    part = read(spark, folder, "part").select("p_partkey", "p_brand", "p_type").hint("merge")
    p, q = part.toDF("source", "pb", "pt"), part.toDF("target", "qb", "qt")
    relation = F.when(F.col("pb") == F.col("qb"), "synonym").when(F.col("pt") == F.col("qt"), "similar").otherwise("related")
    return pairs.join(p, "source").join(q, "target").select("source", "target", relation.alias("relation"), F.least(F.lit(1.0), F.col("n") / 4.0).alias("confidence"))
