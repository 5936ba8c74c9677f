"""Tables written between the rounds of a loop: computed once, kept through lost executors, dropped when read no more."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of each application the folder of its tables; of each open scope the tables made in it.
_roots: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one in a local session without it, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="taxolark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written and read again; they are deleted by ``drop``, at the end of the innermost ``scope``, or when the driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _roots[app])
    path = f"{_roots[app]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored"] = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what was ``stored`` inside, for a driver that lives long: results are to be written or collected before.

    ``with scope(): relations.pagerank(nodes, edges).write.parquet(path)``
    """
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


def kept(df: DataFrame) -> DataFrame:
    """A table that was ``stored`` in the innermost scope and is read after it: it belongs to the scope around, if there is one."""
    _scopes[-1].remove(df)
    if len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


def drop(*tables: DataFrame) -> None:
    """Of tables from ``stored`` that no later plan reads; others are left alone."""
    for df in tables:
        if (path := df.__dict__.pop("_stored", None)) is not None:
            _delete(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder with all that it holds, if it is there."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Rows with their number from 1 in an order over all rows.

    Rows are dealt by range and numbered within their part; only the parts' sizes are
    added up in one place. Ties are numbered in any order, so the order should have none.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # a row for each part
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(offsets, "_part").withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("long")).drop("_part", "_before")


def running(df: DataFrame, key: str, order: Sequence[Column], value: Column, name: str = "upto") -> DataFrame:
    """Rows with the sum of a value up to the row among the rows of its key.

    Rows are dealt by range of key and order, so a key of any size is spread over tasks;
    into a part that goes on with a key the sums of the parts before are carried.
    """
    dealt = stored(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(key, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("_of"), F.col("_part").alias("_at"), F.sum("_sum").over(earlier).alias("_before")).where("_before is not null")
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_own", F.sum(value).over(inside))
    out = found.join(F.broadcast(carried), (F.col(key) == F.col("_of")) & (F.col("_part") == F.col("_at")), "left")  # a row for each part at most
    return out.select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias(name))
