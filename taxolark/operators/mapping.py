"""Raw records to the core shape: field mapping, ids, normalization, blocking, deduplication, term versions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from taxolark.functions.text import quoted
from taxolark.operators.stored import stored


def map_fields(df: DataFrame, mapping: dict[str, Sequence[str]]) -> DataFrame:
    """Each target from the first of its sources that isn't null; other columns that aren't null go to ``raw_attributes``."""
    used = {s for sources in mapping.values() for s in sources}
    have = set(df.columns)
    targets = [F.coalesce(*[F.col(s) for s in sources if s in have], F.lit(None)).alias(t) for t, sources in mapping.items()]
    rest = [c for c in df.columns if c not in used]
    if rest:
        pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
        raw = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    else:
        raw = F.create_map().cast("map<string,string>")
    return df.select(*targets, raw.alias("raw_attributes"))


def stable_id(title: Column, uri: Column) -> Column:
    """'item_' and twelve hex digits of the SHA-256 of title|uri; a missing part is empty."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(uri, F.lit("")))
    return F.concat(F.lit("item_"), F.substring(F.sha2(whole, 256), 1, 12))


def normalize(text: Column, table: dict[str, str]) -> Column:
    """Trimmed, then each key of the table replaced by its value in turn, whatever its case."""
    out = F.trim(text)
    for key, value in table.items():
        out = F.regexp_replace(out, F.lit(f"(?i){quoted(key)}"), F.lit(value.replace("\\", "\\\\").replace("$", "\\$")))
    return out


def map_value(value: Column, table: dict[str, str], general: dict[str, str] | None = None) -> Column:
    """The general replacements, then the value that the table has for the whole text, whatever its case."""
    out = normalize(value, general or {})
    lookup = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(lookup, F.lower(out)), out)


def blocked(columns: Sequence[Column], terms: Sequence[str]) -> Column:
    """Whether any of the columns holds any of the terms, whatever its case."""
    if not terms:
        return F.lit(False)
    pattern = "(?i)" + "|".join(map(quoted, terms))
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))
    return out


def complete(columns: Sequence[Column]) -> Column:
    """Whether none is null or blank."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & (c.cast("string") != "")
    return out


def dedupe(df: DataFrame, by: Sequence[str], first: str) -> DataFrame:
    """Of rows that agree in ``by`` the one with the smallest ``first``; no columns, no change."""
    if not by:
        return df
    w = Window.partitionBy(*by).orderBy(first)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def adapt(df: DataFrame, mapping: dict[str, Sequence[str]], source: str, normalize_map: dict[str, str] | None = None, block: Sequence[str] = (), uri: str | None = None, language: str = "auto") -> DataFrame:
    """Items of a source: mapped, blocked rows and rows without title left out, normalized, with ids, language and metadata."""
    own = df.withColumn("_uri", F.col(uri).cast("string") if uri else F.lit(None).cast("string"))
    out = map_fields(own, mapping | {"_uri": ["_uri"]})
    for c in ("title", "description", "language"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.where(~blocked([F.col("title"), F.col("description")], block) & complete([F.trim("title")]))
    out = out.withColumns({c: normalize(F.col(c), normalize_map or {}) for c in ("title", "description")})
    return out.select(
        stable_id(F.col("title"), F.col("_uri")).alias("item_id"),
        *[F.col(c) for c in mapping],
        F.col("raw_attributes"),
        F.lit(source).alias("source"),
        *([] if "language" in mapping else [F.lit(language).alias("language")]),
        F.create_map(F.lit("source_uri"), F.coalesce("_uri", F.lit(""))).alias("metadata"),
    )


#: Rows of a task that looks for valid mappings.
STRETCH = 250_000


def apply_mappings(items: DataFrame, mappings: DataFrame, term: str = "term", at: str = "at") -> DataFrame:
    """Items with ``mapped``: the term that theirs maps to at the time, from the latest mapping then valid; computes at once.

    Mappings (from_term, to_term, valid_from, valid_to): valid from the first until before
    the second, or on. A term without one keeps its name; a deprecated one maps to null.

    Items and mappings are dealt by range of term and time together, so a term of any
    history is spread over tasks. A mapping is carried into the part where its validity
    ends; of those that outlast a part, only the latest counts there.
    """
    kept = items.select(F.col(term).alias("_k"), F.col(at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("_item"))
    usable = mappings.where("from_term is not null and valid_from is not null and (valid_to is null or valid_from < valid_to)")
    known = usable.select(F.col("from_term").alias("_k"), F.col("valid_from").alias("_t"), F.col("valid_to").alias("_end"), F.struct("to_term").alias("_to"))
    both = stored(known.withColumn("_side", F.lit(0)).unionByName(kept.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    order = [F.asc_nulls_first("_t"), F.asc("_side"), F.asc_nulls_first("_to")]
    dealt = stored(both.repartitionByRange(1 + both.count() // STRETCH, "_k", *order).withColumn("_part", F.spark_partition_id()))
    bounds = dealt.where("_k is not null and _t is not null").groupBy("_k", "_part").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    # a term's parts; two terms with several share no more than one, so there are fewer than twice the parts
    spans = bounds.groupBy(F.col("_k").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_part", "lo", "hi"))).alias("_spans")).where(F.size("_spans") > 1)
    lasts = F.col("_end").isNull
    over = dealt.where("_side = 0").join(F.broadcast(spans), F.col("_k") == F.col("_of"))
    over = over.withColumn("_spans", F.filter("_spans", lambda s: (s["_part"] > F.col("_part")) & (lasts() | (F.col("_end") > s["lo"])))).where(F.size("_spans") > 0)
    over = stored(over.withColumn("_last", F.element_at("_spans", -1)))
    ending = over.where("_end is not null and _end <= _last.hi").select("_k", "_t", "_end", "_to", F.col("_last._part").alias("_part"))
    whole = over.select("_k", "_part", F.struct("_t", "_to").alias("_best"), F.filter("_spans", lambda s: lasts() | (F.col("_end") > s["hi"]))["_part"].alias("_covers"))
    whole = whole.groupBy("_k", "_part", "_covers").agg(F.max("_best").alias("_best")).select("_k", "_best", F.explode("_covers").alias("_part")).groupBy("_k", "_part").agg(F.max("_best").alias("_best"))
    covers = whole.select("_k", "_best._t", "_best._to", "_part")
    carried = ending.unionByName(covers, allowMissingColumns=True).withColumn("_side", F.lit(0))
    rows = dealt.unionByName(carried, allowMissingColumns=True)

    def latest(rows: pa.Table) -> pa.Table:
        """A term's items of a part with the latest mapping that is valid then: a stack from which go those that end before a later one."""
        to = rows["_to"].combine_chunks()
        rows = rows.append_column("_name", pa.chunked_array([to.field("to_term")]))
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("_t", "ascending"), ("_side", "ascending"), ("_name", "ascending")], null_placement="at_start"))
        end = pc.rank(pa.chunked_array([*rows["_t"].chunks, *rows["_end"].chunks]), sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_pylist()
        n, stack, hit, asked = rows.num_rows, [], [], []
        timed = rows["_t"].is_valid().to_pylist()
        for i, side in enumerate(rows["_side"].to_pylist()):
            if side:
                while stack and timed[i] and end[n + stack[-1]] <= end[i]:
                    stack.pop()
                asked.append(i)
                hit.append(stack[-1] if stack and timed[i] else None)
            else:
                while stack and end[n + stack[-1]] <= end[n + i]:
                    stack.pop()
                stack.append(i)
        found = pa.array(hit, type=pa.int64())
        return pa.table({"_item": rows["_item"].take(pa.array(asked, type=pa.int64())), "_hit": found.is_valid(), "_name": rows["_name"].take(found)})

    kinds = StructType([StructField("_item", kept.schema["_item"].dataType), StructField("_hit", BooleanType()), StructField("_name", mappings.schema["to_term"].dataType)])
    met = rows.where("_k is not null").groupBy("_k", "_part").applyInArrow(latest, kinds)
    met = met.unionByName(dealt.where("_k is null").select("_item", F.lit(False).alias("_hit"), F.lit(None).cast(kinds["_name"].dataType).alias("_name")))
    return met.select("_item.*", F.when(F.col("_hit"), F.col("_name")).otherwise(F.col(f"_item.`{term}`")).alias("mapped"))


def bulk_split(items: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their ``errors``."""
    marked = items.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def item_errors() -> Column:
    """What is wrong with an item: lengths, blanks and the language code."""
    bad = [
        (F.col("item_id").isNull() | (F.trim("item_id") == "") | (F.length("item_id") > 255), "item_id"),
        (F.col("title").isNull() | (F.trim("title") == "") | (F.length("title") > 1000), "title"),
        (F.coalesce(F.length("description") > 5000, F.lit(False)), "description"),
        (F.coalesce(F.length("source") > 100, F.lit(True)), "source"),
        (~F.coalesce(F.rlike("language", F.lit("^([a-z]{2}(-[A-Z]{2})?|auto)$")), F.lit(False)), "language"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in bad]))
