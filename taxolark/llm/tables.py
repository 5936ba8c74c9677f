"""Small helpers shared by the operators: input columns, Arrow batches, running sums, tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of texts that a worker takes apart at once; the session's bound on an Arrow batch, and what it is set to.
SLICE_BYTES = 8 << 20
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> DataFrame:
    """The columns named c0, c1, ... by position, so that no two names can clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by position, so that no other column can clash with them.

    A name that differs only in case from a wanted one, or a second column of the
    same name, would make a lookup by name ambiguous; the first exact match counts.
    Every operator reads its input through here, so this is where Arrow batches are
    bounded: always alike, and only in a session that sets no bound of its own.
    """
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    return flat(df).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``rows`` rows and about SLICE_BYTES bytes at most; a row is never cut.

    Spark bounds a batch by bytes (see BATCH); the cut keeps what Python makes of one
    small, whatever the session's settings are.
    """
    for b in batches:
        each = max(1, min(rows, int(b.num_rows * SLICE_BYTES / max(1, b.nbytes))))
        for at in range(0, b.num_rows, each):
            yield b.slice(at, each)


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks under a key: one thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Shelf:
    """Tables written to the shared folder in spark.checkpoint.dir, which cut lineage.

    A written table is computed once and survives lost executors. ``drop`` removes
    what is no longer read; the rest goes when the driver ends. Where the setting is
    missing, a local session uses a temporary folder and any other raises.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="taxolark-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_shelved"] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Of tables that no later plan reads."""
        for df in tables:
            self._delete(df.__dict__.pop("_shelved"))

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None and self.spark.sparkContext._jsc.sc().isStopped() is False:
            self._delete(self.base)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def before(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], shelf: Shelf) -> DataFrame:
    """Rows with, under each name, the sum of a column over all rows before them in the order.

    Rows are dealt by range and numbered sums are taken within each part; only the
    parts' totals, a row for each, are summed up in one place.
    """
    dealt = shelf.put(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = totals.select("part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"o_{n}") for n in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = [(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"o_{n}")).alias(n) for n, c in sums.items()]
    return dealt.join(F.broadcast(offsets), "part").select(*df.columns, *running)  # as many rows as there are parts
