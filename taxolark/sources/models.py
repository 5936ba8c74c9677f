"""Hooks for external models: completion and embedding clients over batches of rows.

The clients themselves need a network; the hooks take any callable. Deterministic
stand-ins need none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complete(df: DataFrame, prompt: str, client: Callable[[str], str], out: str = "response", retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows with a client's answer to each prompt; after so many tries, each waiting twice as long, the answer is null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [_tried(client, p, retries, wait) for p in b[prompt]]
            yield b

    return df.mapInPandas(run, schema)


def _tried(client: Callable[[str], str], prompt: str, retries: int, wait: float) -> str | None:
    for i in range(retries):
        try:
            return client(prompt)
        except Exception:  # whatever a client raises counts as one try
            if i + 1 < retries:
                time.sleep(wait * 2**i)
    return None


def embed(df: DataFrame, text: str, provider: Callable[[list[str]], Sequence[Sequence[float]]], d: int, out: str = "embedding") -> DataFrame:
    """Rows with a provider's vectors; zeros for blank texts; a provider's error is the job's."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [t if isinstance(t, str) and t.strip() else None for t in b[text]]
            got = iter(provider([t for t in own if t is not None]))
            b[out] = [[0.0] * d if t is None else [float(x) for x in next(got)] for t in own]
            yield b

    return df.mapInPandas(run, schema)


def pending(entities: DataFrame, embeddings: DataFrame, key: str = "entity_id", force: bool = False) -> DataFrame:
    """Entities without an active embedding; all if forced."""
    if force:
        return entities
    return entities.join(embeddings.where(F.col("is_active")).select(key).distinct(), key, "left_anti")
