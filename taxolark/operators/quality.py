"""Checks and scores of extractions, and what is proposed from them.

An extraction has item_id, attributes array<struct<name, value, evidence, confidence>> and
terms array<struct<term, context, confidence>>.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """What a domain expects of an attribute."""

    key: str
    kind: str = "text"
    required: bool = False
    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    max_length: int | None = None


def value_errors(value: Column, a: Attribute) -> Column:
    """Names of the rules that a value breaks; a null value only breaks ``required``."""
    checks = [(value.isNull() | (F.trim(value) == ""), "required")] if a.required else []
    if a.kind == "categorical" and a.allowed:
        checks.append((~value.isin(*a.allowed), "allowed"))
    if a.kind == "text" and a.max_length:
        checks.append((F.length(value) > a.max_length, "length"))
    if a.kind == "text" and a.pattern:
        checks.append((~F.rlike(value, F.lit(f"^(?:{a.pattern})")), "pattern"))
    if a.kind == "numeric":
        checks.append((value.try_cast("double").isNull() & value.isNotNull(), "number"))
    if a.kind == "boolean":
        checks.append((~F.lower(value).isin("true", "false", "1", "0"), "boolean"))
    if a.kind == "date":
        checks.append((value.try_cast("date").isNull() & value.isNotNull(), "date"))
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks])) if checks else F.array().cast("array<string>")


def issues(extractions: DataFrame, schema: Sequence[Attribute], required: Sequence[str] = (), min_attributes: int = 0, min_terms: int = 0) -> DataFrame:
    """(item_id, severity, category, rule, field): everything found, one row each.

    One pass: each extraction gives the array of its own issues.
    """

    def issue(severity: str, category: str, rule: str, field: Column | None = None) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(rule).alias("rule"), (field if field is not None else F.lit("")).alias("field"))

    names = F.transform("attributes", lambda a: a["name"])
    texts = F.transform("terms", lambda t: F.lower(t["term"]))
    keys = F.array(*[F.lit(a.key) for a in schema]) if schema else F.array().cast("array<string>")
    allowed = {a.key: a.allowed for a in schema if a.kind == "categorical" and a.allowed}
    patterns = {a.key: a.pattern for a in schema if a.pattern}

    def of_attribute(a: Column) -> Column:
        found = [
            (~F.array_contains(keys, a["name"]), issue("warning", "schema", "unexpected", a["name"])),
            *[((a["name"] == k) & ~a["value"].isin(*v), issue("warning", "schema", "not_allowed", a["name"])) for k, v in allowed.items()],
            *[((a["name"] == k) & ~F.rlike(a["value"], F.lit(f"^(?:{p})")), issue("warning", "format", "pattern", a["name"])) for k, p in patterns.items()],
            (F.trim(a["value"]) == "", issue("error", "quality", "empty_value", a["name"])),
            (F.length(F.trim(a["evidence"])) < 3, issue("warning", "quality", "short_evidence", a["name"])),
            ((a["confidence"] < 0) | (a["confidence"] > 1), issue("error", "format", "confidence_range", a["name"])),
            ((a["confidence"] >= 0) & (a["confidence"] < 0.3), issue("warning", "quality", "low_confidence", a["name"])),
        ]
        return F.array_compact(F.array(*[F.when(c, i) for c, i in found]))

    def of_term(t: Column) -> Column:
        found = [
            (F.trim(t["term"]) == "", issue("error", "quality", "empty_term")),
            (F.length(F.trim(t["context"])) < 5, issue("warning", "quality", "short_context", t["term"])),
            ((t["confidence"] < 0) | (t["confidence"] > 1), issue("error", "format", "confidence_range", t["term"])),
            ((t["confidence"] >= 0) & (t["confidence"] < 0.3), issue("warning", "quality", "low_confidence", t["term"])),
        ]
        return F.array_compact(F.array(*[F.when(c, i) for c, i in found]))

    def repeated(values: Column) -> Column:
        return F.filter(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)) > 1)

    whole = [
        *[F.when(~F.array_contains(names, k), issue("error", "schema", "missing", F.lit(k))) for k in [a.key for a in schema if a.required]],
        F.when((F.size("attributes") == 0) & (F.size("terms") == 0), issue("warning", "quality", "nothing")),
        *[F.when(~F.array_contains(names, k), issue("error", "schema", "rule_required", F.lit(k))) for k in required],
        F.when(F.size("attributes") < min_attributes, issue("warning", "quality", "rule_attributes")),
        F.when(F.size("terms") < min_terms, issue("warning", "quality", "rule_terms")),
    ]
    every = F.concat(
        F.array_compact(F.array(*whole)),
        F.flatten(F.transform("attributes", of_attribute)),
        F.flatten(F.transform("terms", of_term)),
        F.transform(repeated(names), lambda n: issue("error", "consistency", "duplicate_attribute", n)),
        F.transform(repeated(texts), lambda n: issue("warning", "consistency", "duplicate_term", n)),
    )
    return extractions.select("item_id", F.explode(every).alias("i")).select("item_id", "i.severity", "i.category", "i.rule", "i.field")


def scores(extractions: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(item_id, schema_score, coverage, evidence, total, errors, warnings, attribute_confidence, term_confidence)."""
    per = found.groupBy("item_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if((F.col("severity") == "error") & (F.col("category") == "schema")).alias("schema_errors"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("errors", "warnings", "schema_errors")}
    df = extractions.join(per, "item_id", "left").withColumns(zero)
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))
    size = lambda a: F.length(F.trim(a["evidence"]))
    grade = F.transform("attributes", lambda a: F.when(size(a) == 0, 0.0).when(size(a) < 10, 0.3).when(size(a) < 20, 0.6).otherwise(1.0))
    covered = F.size(F.array_intersect(F.transform("attributes", lambda a: a["name"]), F.array(*map(F.lit, keys)))) / len(keys) if keys else F.lit(1.0)
    schema = F.greatest(F.lit(0.2), 1 - F.least(F.col("schema_errors") * 0.2, F.lit(0.8)))
    df = df.withColumns({"schema_score": schema, "coverage": covered, "evidence": F.coalesce(mean(grade), F.lit(1.0))})
    fault = F.least(F.col("errors") * 0.1 + F.col("warnings") * 0.05, F.lit(0.5))
    total = F.greatest(F.lit(0.0), F.col("schema_score") * 0.4 + F.col("coverage") * 0.3 + F.col("evidence") * 0.3 - fault)
    conf = lambda c: mean(F.filter(F.transform(c, lambda x: x["confidence"].cast("double")), lambda x: x.isNotNull()))
    rounded = [F.round(c, 6).alias(n) for n, c in (("schema_score", F.col("schema_score")), ("coverage", F.col("coverage")), ("evidence", F.col("evidence")), ("total", total))]
    return df.select("item_id", *rounded, "errors", "warnings", F.round(conf("attributes"), 6).alias("attribute_confidence"), F.round(conf("terms"), 6).alias("term_confidence"))


def elevation_candidates(candidates: DataFrame, vocabulary: DataFrame, frequency: int = 5, confidence: float = 0.7, most: int = 50) -> DataFrame:
    """Candidates (term, frequency, confidence) that are frequent and certain and no term of the vocabulary (term) yet."""
    good = candidates.where((F.col("frequency") >= frequency) & (F.col("confidence") >= confidence))
    known = vocabulary.select(F.lower(F.col("term")).alias("known")).distinct()
    return good.join(known, F.lower("term") == F.col("known"), "left_anti").orderBy(F.desc("frequency"), F.desc("confidence"), "term").limit(most)


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, before_share, after_share, ratio) of terms (term, n) counted in two periods."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        whole = df.agg(F.sum("n").alias("whole"))
        return df.crossJoin(F.broadcast(whole)).select("term", (F.col("n") / F.col("whole")).alias(name))  # whole is one row

    b, a = shares(before, "before_share"), shares(after, "after_share")
    joined = b.join(a, "term", "full")
    x, y = F.coalesce("before_share", F.lit(0.0)), F.coalesce("after_share", F.lit(0.0))
    return joined.select("term", F.round(x, 6).alias("before_share"), F.round(y, 6).alias("after_share"), F.round(F.when(x > 0, y / x), 6).alias("ratio"))


def conflicts(terms: DataFrame) -> DataFrame:
    """(norm, categories): one normalized term in several categories."""
    from taxolark.functions.text import normalize_term

    return terms.groupBy(normalize_term(F.col("term")).alias("norm")).agg(F.count_distinct("category_id").alias("categories")).where("categories > 1")


def parse_response(response: Column) -> Column:
    """A model's answer as attributes and terms: out of its code fence if it has one; null if it is no JSON object."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(response))
    shape = "attributes array<struct<name:string,value:string,evidence:string,confidence:double>>, terms array<struct<term:string,context:string,confidence:double>>"
    got = F.from_json(body, shape)
    empty_a, empty_t = F.array().cast("array<struct<name:string,value:string,evidence:string,confidence:double>>"), F.array().cast("array<struct<term:string,context:string,confidence:double>>")
    return F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")), F.struct(F.coalesce(got["attributes"], empty_a).alias("attributes"), F.coalesce(got["terms"], empty_t).alias("terms")))


def render(template: str, values: dict[str, Column]) -> Column:
    """A prompt: each {{NAME}} of the template replaced by a column."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    out = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("{{" + p + "}}") for i, p in enumerate(parts)]
    return F.concat(*out)


def mock_extract(title: Column, words: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    """The deterministic stand-in for a model: for each word found in a title an attribute, and a term for each title."""
    none = F.lit(None).cast("struct<name:string,value:string,evidence:string,confidence:double>")
    hits = [
        F.when(F.contains(F.lower(title), F.lit(w)), F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), title.alias("evidence"), F.lit(0.9).alias("confidence"))).otherwise(none)
        for w, (n, v) in words.items()
    ]
    term = F.struct(F.lower(title).alias("term"), title.alias("context"), F.lit(0.8).alias("confidence"))
    return F.array_compact(F.array(*hits)), F.array(term)
