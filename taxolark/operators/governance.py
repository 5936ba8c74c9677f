"""Audit logs, system metrics, alerts, and access levels as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = {"read": 1, "write": 2, "admin": 3, "system": 4}


def level_rank(level: Column) -> Column:
    out = None
    for name, n in LEVELS.items():
        out = F.when(level == name, n) if out is None else out.when(level == name, n)
    return out.otherwise(0)


def allowed(users: DataFrame, level: str) -> DataFrame:
    """Active users (level, is_active) who may do what a level may."""
    return users.where(F.col("is_active") & (level_rank(F.col("level")) >= LEVELS[level]))


def audit(log: DataFrame, user=None, action: str | None = None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Entries (at, user, action, entry_id) that match, newest first."""
    for c, v in (("user", user), ("action", action)):
        if v is not None:
            log = log.where(F.col(c) == v)
    if start is not None:
        log = log.where(F.col("at") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("at") <= F.lit(end))
    return log.orderBy(F.desc("at"), F.desc("entry_id")).limit(limit)


def latency(log: DataFrame, took: str, at: str, tie: str, last: int = 100) -> DataFrame:
    """(mean, p95, n) over the last entries; p95 is the twentieth part from the top, and needs five entries."""
    recent = log.orderBy(F.desc(at), F.desc(tie)).limit(last).withColumn("down", F.row_number().over(Window.orderBy(F.desc(took), F.desc(tie))))  # at most `last` rows
    n = F.count(F.lit(1))
    top = F.max(F.when(F.col("down") == 5, F.col(took)))
    return recent.agg(F.round(F.avg(took), 6).alias("mean"), F.round(F.when(n >= 5, top), 6).alias("p95"), n.alias("n"))


def alerts(metrics: DataFrame) -> DataFrame:
    """(at, severity, title): what system metrics (at, cpu, memory, error_rate) raise."""
    rules = (("cpu", 90, "critical"), ("memory", 90, "critical"), ("error_rate", 10, "high"))
    found = F.array_compact(F.array(*[F.when(F.col(c) > cut, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("title"))) for c, cut, s in rules]))
    return metrics.select("at", F.explode(found).alias("a")).select("at", "a.severity", "a.title")


def health(metrics: DataFrame) -> DataFrame:
    """(at, status): critical above 90 percent of anything, warning above 75."""
    top = F.greatest("cpu", "memory")
    return metrics.select("at", F.when(top > 90, "critical").when(top > 75, "warning").otherwise("healthy").alias("status"))


def ingestion_stats(items: DataFrame) -> DataFrame:
    """One row of items (status, quality): total, completed, failed, skipped, success in percent, mean quality."""
    n = F.count(F.lit(1))
    state = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "skipped")]
    return items.agg(n.alias("total"), *state, F.round(100 * F.count_if(F.col("status") == "completed") / n, 6).alias("success_rate"), F.round(F.avg("quality"), 6).alias("mean_quality"))


def sessions_valid(sessions: DataFrame, now, hours: int = 24) -> DataFrame:
    """Sessions (last_seen) that have not been idle for so long."""
    return sessions.where(F.col("last_seen") > F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours)))


class MetricLog:
    """Recorded metrics in a folder that all machines share, a partition for each day; what is recorded is only added to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, metrics: DataFrame) -> None:
        """Adds rows (name string, value double, at timestamp, key string); rows without name, value or time are no metrics."""
        own = metrics.select("name", F.col("value").cast("double").alias("value"), F.col("at").cast("timestamp").alias("at"), F.col("key").cast("string").alias("key"))
        own = own.where("name is not null and value is not null and at is not null").withColumn("day", F.to_date("at"))
        own.write.mode("append").partitionBy("day").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("name string, value double, at timestamp, key string, day date").parquet(self.path)

    def last(self, n: int, name: str | None = None) -> DataFrame:
        """The newest rows, ties by key: only the last days that hold so many are read."""
        rows = self.rows() if name is None else self.rows().where(F.col("name") == name)
        held, since = 0, None
        for r in rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(n).collect():  # a day holds a row at least
            held, since = held + r["n"], r["day"]
            if held >= n:
                break
        own = rows if since is None else rows.where(F.col("day") >= F.lit(since))
        return own.orderBy(F.desc("at"), F.desc("key")).limit(n).drop("day")

    def summary(self, since=None) -> DataFrame:
        """(name, n, mean, least, most, p95) of the days from one on."""
        rows = self.rows() if since is None else self.rows().where(F.col("day") >= F.lit(since).cast("date"))
        return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", 0.95, 10_000).alias("p95"))
