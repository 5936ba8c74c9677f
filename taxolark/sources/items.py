"""Reading raw items, and tables that are appended to, upserted and deleted from."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("raw_category", T.StringType()),
        T.StructField("raw_attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_file(spark: SparkSession, path: str, schema: T.StructType = ITEM) -> DataFrame:
    """A file that holds one JSON array of objects, or one object; an error if there is none."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_directory(spark: SparkSession, path: str, pattern: str = "*.json", schema: T.StructType = ITEM) -> DataFrame:
    """All files of a folder that match: objects and arrays of objects alike."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(path)


def listing(items: DataFrame, at: str, key: str, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    """Rows by equality filters, newest first."""
    for name, value in equal.items():
        if value is not None:
            items = items.where(F.col(name) == value)
    return items.orderBy(F.desc(at), key).offset(offset).limit(limit)


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """An append-only log as a table: of each key the newest row, unless that is a deletion (``deleted``)."""
    newest = Window.partitionBy(key).orderBy(F.desc(at))
    out = log.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
    return out.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in log.columns else out


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the rows of ``changes`` in place of those of equal key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def delete(table: DataFrame, keys: DataFrame, key: str, *dependent: tuple[DataFrame, str]) -> list[DataFrame]:
    """The table without some keys, and each dependent table without rows that refer to them."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    return [t.join(gone, F.col(c) == F.col("_gone"), "left_anti") for t, c in ((table, key), *dependent)]


def set_status(table: DataFrame, key: str, value, status: str) -> DataFrame:
    return table.withColumn("status", F.when(F.col(key) == value, F.lit(status)).otherwise(F.col("status")))


def insert(table: DataFrame, rows: DataFrame, maps: Sequence[str] = ("raw_attributes", "metadata")) -> DataFrame:
    """The table with new items: empty maps become null, the status is 'pending' whatever the row says."""
    own = rows.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in maps if c in rows.columns}).withColumn("status", F.lit("pending"))
    return table.unionByName(own, allowMissingColumns=True)


class Store:
    """Named tables under a folder. A commit writes new parts beside the old and then names them.

    A table is a list of part folders. A commit writes a new pointer file with the next
    number, which lists all tables' parts, by one rename that fails if the number is
    taken; readers take the pointer with the highest number. So a reader sees all of a
    commit or nothing, a crash at any point loses nothing, and of two writers one is
    told. ``append`` adds a part; ``compact`` makes one part of many.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.staged: dict[str, list[str]] = {}
        self.written: list[str] = []

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        path, fs = self._fs()
        if not fs.exists(path(f"{self.root}/commits")):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(path(f"{self.root}/commits"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def current(self) -> dict[str, list[str]]:
        """Each table's parts."""
        if not (n := self.version()):
            return {}
        out: dict[str, list[str]] = {}
        for r in self.spark.read.text(f"{self.root}/commits/{n}").collect():  # a line for each part
            name, part = r["value"].split("\t", 1)
            out.setdefault(name, []).append(part)
        return out

    def names(self) -> list[str]:
        return sorted(self.current())

    def read(self, name: str) -> DataFrame:
        """A committed table; parts may have columns that others lack."""
        parts = [self.spark.read.parquet(p) for p in self.current()[name]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.written.append(path)
        return path

    def stage(self, name: str, df: DataFrame) -> None:
        """Writes a new version, which counts from the next commit on."""
        self.staged[name] = [self._write(name, df)]

    def append(self, name: str, df: DataFrame) -> None:
        """Writes only the new rows, as a part more."""
        have = self.staged.get(name) or self.current().get(name, [])
        self.staged[name] = [*have, self._write(name, df)]

    def compact(self, name: str) -> None:
        self.stage(name, self.read(name))

    def commit(self) -> None:
        path, fs = self._fs()
        n = self.version() + 1
        now = self.current() | self.staged
        fs.mkdirs(path(f"{self.root}/commits"))
        new = path(f"{self.root}/commits/.new-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray("".join(f"{k}\t{p}\n" for k, v in sorted(now.items()) for p in v).encode()))
        out.close()
        if fs.exists(path(f"{self.root}/commits/{n}")) or not fs.rename(new, path(f"{self.root}/commits/{n}")):
            fs.delete(new, False)
            raise RuntimeError(f"commit {n} was made by another writer: read again")
        self.staged, self.written = {}, []

    def rollback(self) -> None:
        """Drops what was staged since the last commit."""
        path, fs = self._fs()
        for p in self.written:
            fs.delete(path(p), True)
        self.staged, self.written = {}, []

    def health(self) -> DataFrame:
        from taxolark.operators.aggregate import table_counts

        return table_counts({n: self.read(n) for n in self.names()})


#: The columns of the tables of a new store.
TABLES = {
    "ingestion_items": "item_id string, title string, description string, raw_category string, raw_attributes map<string,string>, source string, language string, metadata map<string,string>, status string, created_at timestamp, updated_at timestamp",
    "extraction_results": "item_id string, attributes array<struct<name:string,value:string,evidence:string,confidence:double>>, terms array<struct<term:string,context:string,confidence:double>>, metadata map<string,string>, created_at timestamp",
    "mappings": "from_term string, to_term string, relation_type string, valid_from timestamp, valid_to timestamp",
    "schema_migrations": "version int, name string, applied_at timestamp",
}


def initialize(store: Store) -> list[str]:
    """Creates the tables that a store lacks; their names."""
    missing = [t for t in TABLES if t not in store.current()]
    for t in missing:
        store.stage(t, store.spark.createDataFrame([], TABLES[t]))
    if missing:
        store.commit()
    return missing


def migrate(store: Store, table: str, known: Sequence[tuple[int, str, dict[str, Column], Sequence[str]]], to: int | None = None) -> list[tuple[str, int]]:
    """Brings a table up or down to a version; what was done.

    ``known``: (version, name, columns added, columns that going down takes away), by
    version. Up adds the columns, down drops them; the log and the table change in one commit.
    """
    log, rows, done = store.read("schema_migrations"), store.read(table), []
    have = {r["version"] for r in log.select("version").collect()}  # a row for each version
    target = max(v for v, *_ in known) if to is None else to
    for version, name, added, _ in sorted(known, key=lambda m: m[0]):
        if version <= target and version not in have:
            rows = rows.withColumns(added)
            log = log.unionByName(store.spark.createDataFrame([(version, name)], "version int, name string").withColumn("applied_at", F.current_timestamp()))
            done.append(("up", version))
    for version, _, _, dropped in sorted(known, key=lambda m: -m[0]):
        if version > target and version in have:
            rows, log = rows.drop(*dropped), log.where(F.col("version") != version)
            done.append(("down", version))
    if done:
        store.stage(table, rows)
        store.stage("schema_migrations", log)
        store.commit()
    return done


def status(store: Store, table: str, key: str, value, to: str) -> bool:
    """Sets a row's status and commits; whether there is such a row."""
    rows = store.read(table)
    if rows.where(F.col(key) == value).isEmpty():
        return False
    store.stage(table, set_status(rows, key, value, to))
    store.commit()
    return True


class Catalog:
    """Tables from several places under one name: the first place that has a table and can be read serves it.

    Each place is a function from a table's name to a DataFrame, which raises if it has
    none or is down. The first place is the one that always is there; the others are tried
    first for the tables they are preferred for.
    """

    def __init__(self, main: Callable[[str], DataFrame], **others: Callable[[str], DataFrame]):
        self.places = {"main": main} | others
        self.preferred: dict[str, str] = {}

    def prefer(self, table: str, place: str) -> None:
        if place not in self.places:
            raise ValueError(f"no place {place!r}")
        self.preferred[table] = place

    def order(self, table: str) -> list[str]:
        first = self.preferred.get(table, "main")
        return [first, *[p for p in self.places if p != first]]

    def read(self, table: str) -> DataFrame:
        wrong = []
        for place in self.order(table):
            try:
                return self.places[place](table)
            except Exception as e:  # a place that is down is passed over, and named if none is left
                wrong.append(f"{place}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        raise LookupError(f"{table} can't be read: {'; '.join(wrong)}")

    def served(self, table: str) -> str:
        """The place that a read takes."""
        for place in self.order(table):
            try:
                self.places[place](table)
                return place
            except Exception:
                continue
        raise LookupError(f"{table} is nowhere")

    def health(self, spark: SparkSession, table: str) -> DataFrame:
        """(place, healthy): which places can serve a table."""
        rows = []
        for place, f in self.places.items():
            try:
                f(table)
                rows.append((place, True))
            except Exception:
                rows.append((place, False))
        return spark.createDataFrame(rows, "place string, healthy boolean")


def migrations(applied: DataFrame, known: Sequence[tuple[int, str]]) -> DataFrame:
    """(version, name, applied): the known schema versions and whether a log (version) has them."""
    own = applied.sparkSession.createDataFrame(list(known), "version int, name string")
    done = applied.select(F.col("version").cast("int").alias("v")).distinct()
    return own.join(done, F.col("version") == F.col("v"), "left").select("version", "name", F.col("v").isNotNull().alias("applied")).orderBy("version")


def upgrade(df: DataFrame, steps: Sequence[dict[str, Column]], version: int) -> DataFrame:
    """A table brought from a version to the last: each step adds or replaces columns."""
    for step in steps[version:]:
        df = df.withColumns(step)
    return df


def export(df: DataFrame, path: str, form: str = "json") -> None:
    """Rows written to a folder as JSON lines, CSV with a header, or parquet; nulls are left out of JSON and empty in CSV."""
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif form in ("json", "parquet"):
        getattr(writer, form)(path)
    else:
        raise ValueError(f"form {form!r} is unknown")
