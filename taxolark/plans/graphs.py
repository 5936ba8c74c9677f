"""Directed graphs and spanning forests over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolark.operators import digraph, forest
from taxolark.operators.stored import stored
from taxolark.plans.registry import EDGES_SQL, edges, query, read

HANDOVERS_SQL = """turns AS (SELECT user_id AS source, lead(user_id) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS target FROM events),
handovers AS MATERIALIZED (SELECT source, target, least(1.0::DOUBLE, count(*) / 4.0::DOUBLE) AS confidence FROM turns WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2),
users AS MATERIALIZED (SELECT DISTINCT user_id AS node FROM events), strong AS MATERIALIZED (SELECT source, target FROM handovers WHERE confidence > 0.5)"""


def handovers(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Users, and who acts next after whom in a kind of event on a day: directed, with circles."""
    e = read(spark, folder, "events")
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    turns = e.select(F.col("user_id").alias("source"), F.lead("user_id").over(day).alias("target")).where("target is not null and source <> target")
    counted = turns.groupBy("source", "target").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 4.0).alias("confidence"))
    return e.select(F.col("user_id").alias("node")).distinct(), stored(counted)


_REACH_SQL = "reach AS (SELECT node AS x, node AS y FROM users UNION SELECT x, target FROM reach JOIN strong ON y = source)"


@query(f"WITH RECURSIVE {HANDOVERS_SQL}, {_REACH_SQL} SELECT y AS node, min(x) AS cluster FROM reach GROUP BY 1")
def directed_clusters(spark, folder):
    """Clusters that follow the edges' directions."""
    return digraph.clusters(*handovers(spark, folder))


@query(
    f"""WITH RECURSIVE {HANDOVERS_SQL}, {_REACH_SQL}, l AS (SELECT y AS node, min(x) AS cluster FROM reach GROUP BY 1), n AS (SELECT cluster, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 2),
        i AS (SELECT a.cluster, avg(confidence) AS mean, count(*) AS n FROM handovers JOIN l a ON source = a.node JOIN l b ON target = b.node WHERE confidence > 0.5 AND a.cluster = b.cluster GROUP BY 1)
        SELECT cluster, size, round(coalesce(mean * least(1.0::DOUBLE, i.n / (size * (size - 1) / 2)::DOUBLE), 0.0::DOUBLE), 6) AS cohesion FROM n LEFT JOIN i USING (cluster) ORDER BY size DESC, cluster LIMIT 50"""
)
def directed_cluster_figures(spark, folder):
    users, links = handovers(spark, folder)
    return digraph.cluster_figures(digraph.clusters(users, links), links, least_size=2)


@query(f"WITH RECURSIVE {HANDOVERS_SQL}, {_REACH_SQL} SELECT a.x AS node, min(a.y) AS component FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x GROUP BY 1")
def strong_components(spark, folder):
    users, links = handovers(spark, folder)
    return digraph.strong_components(users, links.where("confidence > 0.5"))


def _level(x: str, level: float) -> str:
    return f"{x} AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b.b, root FROM {x} JOIN b ON node = a WHERE score >= {level})"


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, b AS MATERIALIZED (SELECT source AS a, target AS b, confidence AS score FROM edges UNION ALL SELECT target, source, confidence FROM edges),
        {_level('r5', 0.5)}, {_level('r7', 0.75)}, {_level('r9', 1.0)} SELECT node, 0.5::DOUBLE AS level, min(root) AS cluster FROM r5 GROUP BY 1
        UNION ALL SELECT node, 0.75::DOUBLE, min(root) FROM r7 GROUP BY 1 UNION ALL SELECT node, 1.0::DOUBLE, min(root) FROM r9 GROUP BY 1"""
)
def forest_cuts(spark, folder):
    """Three cuts of one spanning forest."""
    pairs = stored(edges(spark, folder).select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("confidence").alias("score")))
    nodes = read(spark, folder, "part").select(F.col("p_partkey").alias("node"))
    tree = stored(forest.spanning_forest(pairs))
    out = None
    for level in (0.5, 0.75, 1.0):
        one = forest.cut(nodes, tree, level).select("node", F.lit(level).alias("level"), "cluster")
        out = one if out is None else out.unionAll(one)
    return out


_WAYS_SQL = f"""{HANDOVERS_SQL},
d(x, y, h) USING KEY (x, y) AS (
  SELECT node, node, 0 FROM users
  UNION SELECT d.x, target, min(d.h + 1) FROM d JOIN strong ON d.y = source LEFT JOIN recurring.d r ON r.x = d.x AND r.y = target WHERE r.h IS NULL GROUP BY d.x, target),
w(x, y, h, s) AS (
  SELECT node, node, 0, 1.0::DOUBLE FROM users
  UNION ALL SELECT w.x, target, w.h + 1, sum(w.s) FROM w JOIN strong ON w.y = source JOIN d ON d.x = w.x AND d.y = target AND d.h = w.h + 1 GROUP BY w.x, target, w.h)"""


@query(
    f"""WITH RECURSIVE {_WAYS_SQL}, n AS (SELECT count(*) AS n FROM users),
        b AS (SELECT p.y AS node, sum(p.s * q.s / r.s) AS b FROM w p JOIN w q ON p.y = q.x JOIN w r ON r.x = p.x AND r.y = q.y WHERE p.h + q.h = r.h AND p.h > 0 AND q.h > 0 GROUP BY 1),
        c AS (SELECT y AS node, count(*) AS met, sum(h) AS far FROM w WHERE h > 0 GROUP BY 1)
        SELECT node, round(coalesce(b, 0.0::DOUBLE) / greatest(1, (n - 1) * (n - 2)), 6) AS betweenness, round(coalesce(met / greatest(1, n - 1)::DOUBLE * met / far, 0.0::DOUBLE), 6) AS closeness
        FROM users LEFT JOIN b USING (node) LEFT JOIN c USING (node), n"""
)
def exact_centrality(spark, folder):
    """Betweenness and closeness from all users at once."""
    users, links = handovers(spark, folder)
    found = digraph.centrality(users, links.where("confidence > 0.5"))
    return found.select("node", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"))
