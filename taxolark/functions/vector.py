"""Vector functions on array columns, in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column, clip: bool = False) -> Column:
    """0 if the lengths differ or either norm is 0."""
    scale = norm(a) * norm(b)
    out = F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out)) if clip else out


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


MEASURES = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan}
#: Measures of which less is nearer.
DISTANCES = ("euclidean", "manhattan")


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def weighted_average(vectors: Sequence[Column], weights: Sequence[float]) -> Column:
    """The vector average of several models, weights taken relative to their sum."""
    whole = float(sum(weights))
    out = F.transform(_double(vectors[0]), lambda x: x * (weights[0] / whole))

    def add(out: Column, v: Column, share: float) -> Column:
        return F.zip_with(out, _double(v), lambda x, y: x + y * share)

    for v, w in zip(vectors[1:], weights[1:], strict=True):
        out = add(out, v, w / whole)
    return out


def hashed_embedding(text: Column, d: int = 64) -> Column:
    """A deterministic embedding: words hashed to signed positions, scaled to norm 1; zeros for a blank text."""
    own = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    spots = F.transform(own, lambda w: F.pmod(F.xxhash64(w), F.lit(d)).cast("int"))
    signs = F.transform(own, lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.arrays_zip(spots.alias("at"), signs.alias("sign"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(p["at"] == i, p["sign"]).otherwise(0.0)))
    size = norm(raw)
    return F.when(size > 0, F.transform(raw, lambda x: x / size)).otherwise(F.array_repeat(F.lit(0.0), d))
