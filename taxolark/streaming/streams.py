"""Continuous ingestion and windows over event streams; batch DataFrames take the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(form).load(path)


def event_time(df: DataFrame, at: str = "ts") -> DataFrame:
    """The time column as a timestamp, which watermarks need."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], good: str, bad: str, checkpoint: str, once: bool = True, callback: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes each batch's valid rows to one folder and the others to another, so that one bad record stops nothing.

    A batch's rows go to folders named by its number and replace what a failed attempt
    left there, so each is written once. ``transform`` marks a batch: rows whose ``errors``
    are empty or null are valid. It is computed once, even if it is costly or gives other
    rows each time: the marked batch is written first, and both folders are made from that.
    """

    def sink(batch: DataFrame, number: int) -> None:
        marked = f"{bad}/marked={number}"
        transform(batch).write.mode("overwrite").parquet(marked)
        rows = batch.sparkSession.read.parquet(marked)
        fine = F.coalesce(F.size("errors"), F.lit(0)) <= 0
        valid = rows.where(fine).drop("errors")
        valid.write.mode("overwrite").parquet(f"{good}/batch={number}")
        rows.where(~fine).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        if callback is not None:
            callback(batch.sparkSession.read.schema(valid.schema).parquet(f"{good}/batch={number}"), number)
        path = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(marked)
        path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, every: str, by: str, value: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """(start, by, n, total) in windows that follow each other; rows later than the watermark are left out of a stream."""
    if late is not None:
        events = events.withWatermark(at, late)
    w = events.groupBy(F.window(at, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", F.round("total", 6).alias("total"))


def sliding(events: DataFrame, length: str, step: str, by: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """(start, by, n) in windows that overlap."""
    if late is not None:
        events = events.withWatermark(at, late)
    w = events.groupBy(F.window(at, length, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, by: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """(by, start, n): stretches of events of one key without a longer gap."""
    if late is not None:
        events = events.withWatermark(at, late)
    w = events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(by, F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
