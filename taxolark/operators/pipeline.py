"""Ingestion from raw records to scored extractions, as one lazy plan; and pipelines by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolark.operators import quality
from taxolark.sources.packs import Pack

#: Least total quality of an item that counts as completed.
LEAST = 0.6


def ingest(raw: DataFrame, pack: Pack, source: str, words: dict[str, tuple[str, str]], uri: str | None = None, least: float = LEAST) -> DataFrame:
    """(item_id, title, attributes, terms, quality, status): items adapted by a pack, extracted by the stand-in model, validated and scored."""
    items = pack.adapt(raw, source, uri)
    attributes, terms = quality.mock_extract(F.col("title"), words)
    found = items.select("item_id", "title", attributes.alias("attributes"), terms.alias("terms"))
    schema = pack.attributes()
    scored = quality.scores(found, quality.issues(found, schema), [a.key for a in schema]).select("item_id", F.col("total").alias("quality"))
    return found.join(scored, "item_id").withColumn("status", F.when(F.col("quality") >= least, "completed").otherwise("failed"))


class Pipelines:
    """Functions of DataFrames by name."""

    def __init__(self):
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        self.known[name] = f

    def names(self) -> list[str]:
        return sorted(self.known)

    def run(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.known:
            raise ValueError(f"no pipeline {name!r}; there are {', '.join(self.names())}")
        return self.known[name](df)
