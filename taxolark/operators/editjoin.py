"""Joins of texts by edit distance: only texts that share a segment meet.

A text that is at most k edits from another keeps one of its k + 1 segments whole, near
its place. The texts of one side are cut into segments, those of the other give the
pieces that could be such a segment: of its length, and shifted no further than the
edits allow. A segment that very many texts share says little; texts that hold such a
one are cut in halves: the edits that their beginnings need are counted, each distinct
pair of beginnings once, and the ends meet on a segment that the edits left over spare;
without any left, on the whole end. If the beginnings are too many, such texts are cut
into k + 2 segments, of which two stay whole, and meet on both.

The pieces of a long text are very many. Pairs with a long one meet on their rarest
bigrams instead: an edit spoils two at most, so what is near shares one of the first few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolark.operators.stored import stored

#: Pairs that one segment may bring together before pairs of segments are asked for.
CROWD = 20_000
#: Pairs of beginnings that are compared for texts with a segment that very many share.
HEADS = 20_000_000
#: Longest text that is cut into segments, if the threshold lets bigrams serve for longer ones.
LONG, BIGRAMS_FROM = 40, 0.6


def edits(length: int, threshold: float) -> int:
    """The most edits that a longer text of this length allows."""
    return int((1 - threshold) * length + 1e-9)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of nearly equal segments of a text; the later ones are the longer."""
    short, more = divmod(length, parts)
    sizes = [short + (i >= parts - more) for i in range(parts)]
    ends = [sum(sizes[: i + 1]) for i in range(parts)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def lengths(length: int, threshold: float) -> range:
    """Lengths of texts that can be near one of this length."""
    return range(length - edits(length, threshold), int(length / threshold + 1e-9) + 1)


def own_keys(text: str, threshold: float, pairs: bool, others: frozenset[int]) -> Iterator[str]:
    """Keys of a text that is cut: length, edits, segment or two, and what they hold. ``others``: the lengths of the other side's texts."""
    n = len(text)
    for k in sorted({edits(max(n, m), threshold) for m in lengths(n, threshold) if m in others}):
        whole = [(i, text[a:b]) for i, (a, b) in enumerate(cuts(n, k + 1 + pairs))]
        if not pairs:
            yield from (f"{n}:{k}:{i}:{s}" for i, s in whole)
        else:
            yield from (f"{n}:{k}:{i}:{j}:{len(s)}:{s}{t}" for i, s in whole for j, t in whole if i < j)


def other_keys(text: str, threshold: float, pairs: bool, others: frozenset[int]) -> Iterator[str]:
    """Keys under which a text can meet a cut one: pieces shifted by x, where |x| and the shift of what follows make no more than k edits."""
    n = len(text)
    for m in lengths(n, threshold):
        if m not in others:
            continue
        k, longer = edits(max(n, m), threshold), n - m
        pieces = []
        for a, b in cuts(m, k + 1 + pairs):
            low, high = max(0, a - (k - longer) // 2), min(n - (b - a), a + (k + longer) // 2)
            pieces.append(dict.fromkeys(text[p : p + b - a] for p in range(low, high + 1)))
        if not pairs:
            yield from (f"{m}:{k}:{i}:{s}" for i, found in enumerate(pieces) for s in found)
        else:
            yield from (f"{m}:{k}:{i}:{j}:{len(s)}:{s}{t}" for i, found in enumerate(pieces) for s in found for j in range(i + 1, len(pieces)) for t in pieces[j])


def unshared(length: int, threshold: float) -> int:
    """How many of a text's bigrams, the rarest first, must be looked at to meet every text near it."""
    shared = min(m - 1 - 2 * edits(m, threshold) for m in range(length, int(length / threshold + 1e-9) + 1))
    return length - shared


def _numbered_bigrams(texts: DataFrame, threshold: float) -> DataFrame:
    """(text, gram, need): the bigrams of a text, the n-th of equal ones with its number, and how many of the rarest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in whole.column(0).to_pylist():
                seen: dict[str, int] = {}
                grams = []
                for i in range(len(t) - 1):
                    g = t[i : i + 2]
                    seen[g] = seen.get(g, 0) + 1
                    grams.append(f"{g}{seen[g]}")
                columns = [[t] * len(grams), grams, [unshared(len(t), threshold)] * len(grams)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["text", "gram", "need"])

    return texts.select("text").mapInArrow(run, "text string, gram string, need int")


def _near_long(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(x, y): pairs of texts that may be near, those with a text longer than LONG among them."""
    a, b = (t.where(F.length("text") >= int(LONG * threshold)) for t in (left, right))
    grams = stored(_numbered_bigrams(a, threshold).withColumn("own", F.lit(False)).unionAll(_numbered_bigrams(b, threshold).withColumn("own", F.lit(True))))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("own", "text").orderBy("df", "gram")
    first = grams.join(spread, "gram").withColumn("place", F.row_number().over(rare)).where("place <= need")
    return first.where("not own").select("gram", F.col("text").alias("x")).join(first.where("own").select("gram", F.col("text").alias("y")), "gram").select("x", "y")


def _keyed(texts: DataFrame, name: str, own: bool, threshold: float, pairs: bool, others: frozenset[int]) -> DataFrame:
    """(key long, text): the text's keys, hashed; two keys of one hash only bring more texts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = own_keys if own else other_keys
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                keys, back = [], []
                for t in whole.column(0).slice(at, 512).to_pylist():
                    found = list(dict.fromkeys(make(t, threshold, pairs, others)))
                    keys += found
                    back += [t] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array(back, type=pa.string())], names=["key", name])

    return texts.select(F.col("text").alias(name)).mapInArrow(run, f"key string, {name} string").select(F.xxhash64("key").alias("key"), name)


def _by_halves(xs: DataFrame, ys: DataFrame, threshold: float, of_y: frozenset[int]) -> DataFrame | None:
    """(x, y): pairs of texts (text) that may be near, all near ones among them; None if their beginnings are too many to compare.

    A text y of n characters is cut behind the first half, and x wherever the edits allow:
    near texts have a cut for which the edits of the halves add up to those of the whole.
    """
    m, n = F.length("x"), F.col("n")
    k = F.floor((1 - threshold) * F.greatest(m, n) + 1e-9).cast("int")
    half = F.floor(n / 2).cast("int")
    sized = xs.select(F.col("text").alias("x"), F.explode(F.array(*[F.lit(i) for i in sorted(of_y)])).alias("n")).withColumn("k", k).where(F.abs(m - n) <= F.col("k"))
    cut = sized.select("x", "n", "k", F.explode(F.sequence(F.greatest(F.lit(0), half - F.col("k")), F.least(m, half + F.col("k")))).alias("p"))
    cut = cut.select("x", "n", "k", F.substr("x", F.lit(1), F.col("p")).alias("hx"), F.substr("x", F.col("p") + 1).alias("tail"))
    own = ys.select(F.col("text").alias("y"), F.length("text").alias("n"))
    own = own.select("y", "n", F.substr("y", F.lit(1), half).alias("hy"), F.substr("y", half + 1).alias("tail"))
    one, other = stored(cut.select("n", "k", "hx").distinct()), stored(own.select("n", "hy").distinct())
    sizes = one.groupBy("n").agg(F.count(F.lit(1)).alias("c")).join(other.groupBy("n").agg(F.count(F.lit(1)).alias("d")), "n")
    if (sizes.agg(F.sum(F.col("c") * F.col("d"))).first()[0] or 0) > HEADS:
        return None
    heads = one.join(other, "n").withColumn("rest", F.col("k") - F.levenshtein("hx", "hy")).where("rest >= 0")
    heads = stored(heads.select("n", "k", "hx", "hy", "rest"))
    asked = cut.join(heads, ["n", "k", "hx"]).where(F.abs(F.length("tail") - (n - half)) <= F.col("rest")).select("x", "tail", "n", "hy", "rest")
    known = own.join(heads.select("n", "hy", "rest").distinct(), ["n", "hy"]).select("y", "tail", "n", "hy", "rest")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                keys, back = [], []
                for t, tail, n, head, rest in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                    whole_length = n - n // 2
                    if whole_length <= rest:  # no segment need stay whole
                        found = ["*"]
                    else:
                        slack = rest if name == "x" else 0
                        found = [f"{i}:{tail[p : p + b - a]}" for i, (a, b) in enumerate(cuts(whole_length, rest + 1)) for p in range(max(0, a - slack), min(len(tail) - (b - a), a + slack) + 1)]
                    for f in dict.fromkeys(found):
                        keys.append(f"{n}:{rest}:{len(head)}:{head}:{f}")
                        back.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array(back, type=pa.string())], names=["key", name])

        return rows.mapInArrow(run, f"key string, {name} string").select(F.xxhash64("key").alias("key"), name)

    return keyed(asked, "x").join(keyed(known, "y"), "key").select("x", "y")


def near_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(x, y, score): pairs of texts (text) by Levenshtein similarity of at least the threshold, which lies above 0; computes at once.

    The similarity is 1 - edits / longer length, in code points, as the texts are; two
    empty texts have 1. Each pair of distinct texts is returned once; nulls are near nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    left, right = (t.select("text").where("text is not null").distinct() for t in (left, right))
    by_grams = threshold >= BIGRAMS_FROM
    a, b = (t.where(F.length("text") <= LONG) if by_grams else t for t in (left, right))
    of_a, of_b = (frozenset(r[0] for r in t.select(F.length("text")).distinct().collect()) for t in (a, b))  # lengths
    other, own = stored(_keyed(a, "x", False, threshold, False, of_b)), stored(_keyed(b, "y", True, threshold, False, of_a))
    sizes = other.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(own.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    crowd = stored(sizes.where(F.col("n") * F.col("m") > CROWD).select("key"))
    met = other.join(own.join(crowd, "key", "left_anti"), "key").select("x", "y")
    if not crowd.isEmpty():
        xs = other.join(crowd, "key", "left_semi").select(F.col("x").alias("text")).distinct()
        ys = own.join(crowd, "key", "left_semi").select(F.col("y").alias("text")).distinct()
        halves = _by_halves(xs, ys, threshold, of_b)
        met = met.unionAll(halves if halves is not None else _keyed(xs, "x", False, threshold, True, of_b).join(_keyed(ys, "y", True, threshold, True, of_a), "key").select("x", "y"))
    if by_grams:
        met = met.unionAll(_near_long(left, right, threshold))
    longest = F.greatest(F.length("x"), F.length("y"))
    most = F.floor((1 - threshold) * longest + 1e-9).cast("int")
    close = F.abs(F.length("x") - F.length("y")) <= most
    score = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("x", "y") / longest)
    # most pairs that meet aren't near, so they are compared before repeated ones are left out
    return met.where(close).withColumn("score", score).where(F.col("score") >= threshold).select("x", "y", "score").distinct()


def near_pairs(rows: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b, score): pairs a < b of one table's rows whose texts, in lower case, are that near; computes at once.

    Equal texts are pairs too. Rows without key or text have none.
    """
    own = rows.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("text")).where("id is not null and text is not null")
    near = near_texts(own, own, threshold)
    a, b = own.select(F.col("id").alias("a"), F.col("text").alias("x")), own.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return near.join(a, "x").join(b, "y").where("a < b").select("a", "b", F.round("score", 6).alias("score")).distinct()


def best_matches(values: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """(value, term, score): for each distinct text of ``values`` its nearest of ``terms`` (text each), the first by name of equals; computes at once."""
    near = near_texts(values.select(F.lower("text").alias("text")), terms.select(F.lower("text").alias("text")), threshold)
    best = near.groupBy("x").agg(F.min_by(F.struct("y", "score"), F.struct(-F.col("score"), F.col("y"))).alias("best"))
    return best.select(F.col("x").alias("value"), F.col("best.y").alias("term"), F.round("best.score", 6).alias("score"))


