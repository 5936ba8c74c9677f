"""As-of joins, stored indexes, edit-distance joins, sketches, table functions and state on tables made here, against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolark.functions import tables
from taxolark.operators import asof, editjoin, search, sketches, textindex, vocabulary
from taxolark.operators.completions import Completions
from taxolark.operators.textindex import TextIndex
from taxolark.operators.vectorindex import VectorIndex
from taxolark.plans import all_queries, all_sql
from taxolark.streaming import stateful, streams


def plan(df):
    return df._jdf.queryExecution().toString()


# --- as of ------------------------------------------------------------------------------------------------


def last_known(left, right, forward=False, exact=True):
    out = {}
    for key, t, n in left:
        fits = [(s, v) for k, s, v in right if None not in (key, t, s) and k == key and ((s >= t if exact else s > t) if forward else (s <= t if exact else s < t))]
        out[n] = (min(fits) if forward else max(fits))[1] if fits else None
    return out


@pytest.mark.parametrize(("forward", "exact"), [(False, True), (False, False), (True, True), (True, False)])
def test_as_of(spark, forward, exact):
    rng = random.Random(5)
    # one key holds most rows and goes over all parts; times tie; keys and times may be null
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(key(), rng.choice([None, *range(300)]), n) for n in range(2000)]
    right = [(key(), rng.choice([None, *range(0, 300, 3)]), v) for v in range(400)]
    a, b = spark.createDataFrame(left, "key string, t int, n int"), spark.createDataFrame(right, "key string, s int, v int")
    got = asof.as_of(a.repartition(7), b, "t", "s", by=["key"], take=["v"], tie=["v"], forward=forward, exact=exact)
    assert got.columns == ["key", "t", "n", "v"]
    rows = got.collect()
    assert len(rows) == len(left) and {r["n"]: r["v"] for r in rows} == last_known(left, right, forward, exact)


def test_as_of_spreads_a_hot_key(spark):
    a = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    b = spark.range(0, 20_000, 100).select(F.lit(1).alias("k"), F.col("id").alias("s"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.as_of(a, b, "t", "s", by=["k"], take=["v"]).withColumn("part", F.spark_partition_id())
        parts = got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") != F.floor(F.col("t") / 100) * 100).alias("wrong")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(p["n"] for p in parts) < 12_000 and sum(p["n"] for p in parts) == 20_000 and not any(p["wrong"] for p in parts)


def test_as_of_within_and_empty(spark):
    a = spark.createDataFrame([(1, 5), (2, 50)], "n int, t int")
    b = spark.createDataFrame([(1, 10, "x"), (40, 45, "y")], "s int, e int, v string")
    got = asof.as_of(a, b, "t", "s", take=["v", "e"], within=F.col("t") < F.col("e"))
    assert {r["n"]: (r["v"], r["e"]) for r in got.collect()} == {1: ("x", 10), 2: (None, None)}
    assert [r["v"] for r in asof.as_of(a, b.limit(0), "t", "s", take=["v"]).collect()] == [None, None]
    assert asof.as_of(a.limit(0), b, "t", "s", take=["v"]).collect() == []


# --- vectors -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 16)) * 4
    return middles[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))


def table(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")


def nearest(vectors, ids, q, k):
    gaps = np.sqrt(((vectors - q) ** 2).sum(axis=1))
    return [int(ids[i]) for i in np.lexsort((ids, gaps))[:k]]


def test_vector_index(spark, cloud, tmp_path):
    rows = table(spark, cloud)
    bad = spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [float("nan")] * 16), (None, [1.0] * 16)], "id long, v array<double>")
    VectorIndex.build(rows.unionByName(bad), str(tmp_path / "i"), lists=40)
    index = VectorIndex(spark, str(tmp_path / "i"))  # as another session would find it
    asked = rows.where("id < 30").select(F.col("id").alias("query"), "v")
    certain = index.search(asked, 5).collect()
    want = {q: nearest(cloud, np.arange(3000), cloud[q], 5) for q in range(30)}
    got = {q: [r["id"] for r in sorted(certain, key=lambda r: r["rank"]) if r["query"] == q] for q in range(30)}
    assert got == want and index.rows().count() == 3000
    few = index.search(asked, 5, probes=3).collect()
    recall = sum(r["id"] in want[r["query"]] for r in few) / 150
    assert recall >= 0.9
    # an id of a list is read from its partition alone
    assert "PartitionFilters: [list" in plan(index.rows().where(F.col("list").isin([1, 2])))


def test_vector_index_changes(spark, cloud, tmp_path):
    index = VectorIndex.build(table(spark, cloud[:500]), str(tmp_path / "i"), lists=10)
    index.delete(spark.range(0, 100))
    index.upsert(table(spark, cloud[2000:2100], first=450))  # 50 in place of others, 50 new
    now = {**{i: cloud[i] for i in range(100, 450)}, **{450 + i: cloud[2000 + i] for i in range(100)}}
    index = VectorIndex(spark, str(tmp_path / "i"))
    ids = np.array(sorted(now))
    vectors = np.array([now[i] for i in ids])
    assert sorted(r["id"] for r in index.rows().select("id").collect()) == ids.tolist()
    got = index.search(table(spark, vectors[:5]).withColumnRenamed("id", "query"), 4).collect()
    for n in range(5):
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == n] == nearest(vectors, ids, vectors[n], 4)
    index.delete(spark.createDataFrame([(int(i),) for i in ids], "id long"))
    assert index.rows().count() == 0 and index.search(table(spark, vectors[:2]).withColumnRenamed("id", "query"), 4).collect() == []
    with pytest.raises(ValueError, match="vector to begin with"):
        VectorIndex.build(table(spark, []), str(tmp_path / "none"))


# --- texts ------------------------------------------------------------------------------------------------------


def test_text_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(1500)] + [(9001, None), (9002, ""), (9003, "THE  the\nW1")]
    df = spark.createDataFrame(docs, "id long, text string")
    index = TextIndex.build(df, "id", "text", str(tmp_path / "t"))
    for q in ("w1 w2", "the", "w3 THE nothing", "nothing", "w1 w1 w39"):
        assert index.search(q, limit=15).collect() == search.bm25(df, "id", "text", q, limit=15).collect(), q
    extra = spark.createDataFrame([(5, "w1 w1 w1"), (20_000, "w2 the"), (20_001, "w1")], "id long, text string")
    index.add(extra, "id", "text")
    index.remove(spark.createDataFrame([(7,), (8,), (20_001,)], "key long"))
    changed = df.where("id not in (5, 7, 8)").unionByName(extra.where("id <> 20001"))
    again = TextIndex(spark, str(tmp_path / "t"))
    for _ in range(2):
        for q in ("w1 w2", "the w5"):
            assert again.search(q, limit=12).collect() == search.bm25(changed, "id", "text", q, limit=12).collect(), q
        again.merge()
    assert again.figures().count() == 1


def test_text_index_reads_its_words_only(spark, tmp_path):
    # the word of the best documents is rare elsewhere, so most slots promise too little
    docs = spark.range(6000).select("id", F.when(F.col("id") < 20, "rare rare rare").otherwise(F.concat(F.lit("common filler text that is long rare "), F.repeat(F.lit("x "), 50))).alias("text"))
    index = TextIndex.build(docs, "id", "text", str(tmp_path / "t"))
    told = plan(index.heads(["rare"]))
    scan = next(x for x in told.splitlines()[::-1] if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(bucket" in scan and "EqualTo(word,rare)" in scan and "postings" not in scan.split("ReadSchema")[1]
    assert [r["key"] for r in index.search("rare").collect()] == list(range(10))


def test_text_index_writes_blocks_once(spark, tmp_path, monkeypatch):
    for name, most in (("SLOT", 16), ("WORDS", 500), ("SPAN", 2), ("FIRST", 1)):
        monkeypatch.setattr(textindex, name, most)
    rng = random.Random(9)
    rows = [(i, None if i % 40 == 0 else " ".join(rng.choice(["a", "b", "c", f"x{i % 7}"]) for _ in range(rng.randrange(12)))) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[5], (None, "a a"), (999, "lone a")], "id long, text string")
    index = TextIndex.build(df, "id", "text", str(tmp_path / "t"))
    files = lambda: sorted(index.blocks().inputFiles())
    first = files()
    # a block knows places, not keys; a removal notes documents and writes no block anew
    assert [f.name for f in index.blocks().schema["postings"].dataType.elementType] == ["at", "n"]
    index.remove(spark.createDataFrame([(i,) for i in (*range(0, 300, 3), 999, 5000)], "key long"))
    assert files() == first and index.docs().count() == 200 and index.gone().count() == 101
    index.add(extra := spark.createDataFrame([(1, "b b"), (700, "a x1")], "id long, text string"), "id", "text")
    left = df.where("id % 3 <> 0 and id <> 1").dropDuplicates(["id"]).unionByName(extra)
    for _ in range(2):
        for q in ("a x1", "lone", "lone b", "c"):
            assert index.search(q, limit=9).collect() == search.bm25(left, "id", "text", q, limit=9).collect(), q
        index.merge()
    assert index.gone().isEmpty() and index.docs().count() == index.figures().first()["docs"] == 201 and index.blocks().where("word = 'lone'").isEmpty()
    index.remove(index.docs().select("key"))
    assert index.search("a b").isEmpty()
    index.merge()
    assert index.search("a b").isEmpty() and index.blocks().isEmpty()


# --- edits -------------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - levenshtein(a, b) / longest


def made_texts(rng, n, alphabet, shortest, longest):
    out = []
    for _ in range(n):
        t = list(rng.choice(out)) if out and rng.random() < 0.6 else [rng.choice(alphabet) for _ in range(rng.randrange(shortest, longest))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = [rng.choice(alphabet)] * rng.randrange(2)
        out.append("".join(t))
    return out


@pytest.mark.parametrize(("threshold", "shortest", "longest"), [(0.8, 0, 12), (0.6, 0, 14), (0.45, 0, 9), (0.75, 30, 70), (1.0, 0, 5)])
def test_near_texts(spark, threshold, shortest, longest):
    rng = random.Random(int(threshold * 100) + longest)
    texts = made_texts(rng, 240, "abcdé", shortest, longest)
    a, b = texts[:140], texts[100:]
    got = editjoin.near_texts(*(spark.createDataFrame([(t,) for t in [*x, None]], "text string") for x in (a, b)), threshold)
    found = [(r["x"], r["y"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(x, y) for x in a for y in b if similar(x, y) >= threshold}


def test_near_texts_with_a_shared_beginning(spark, monkeypatch):
    monkeypatch.setattr(editjoin, "CROWD", 50)
    rng = random.Random(9)
    texts = sorted({f"product-{rng.randrange(10**6):06d}" for _ in range(300)} | {"product-000111", "product-000112"})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["x"], r["y"]) for r in editjoin.near_texts(df, df, 0.9).collect()}
    assert got == {(x, y) for x in texts for y in texts if similar(x, y) >= 0.9}


def test_a_common_bigram_is_no_key(spark):
    """All terms share their first letters; what meets on segments is a small part of all pairs."""
    texts = [f"xx{i * 7919 % 100_000:05d}zz" for i in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    own, other = editjoin._keyed(df, "y", True, 0.8, False, frozenset({9})), editjoin._keyed(df, "x", False, 0.8, False, frozenset({9}))
    assert own.join(other, "key").count() < 1500 * 1500 / 10


def test_vocabulary_matches_by_edits(spark):
    terms = spark.createDataFrame([(1, "red widget", ["crimson widget"]), (2, "blue gadget", []), (3, "red widgets", [])], "term_id long, term string, aliases array<string>")
    values = spark.createDataFrame([("Red  Widget",), ("crimson widget",), ("bleu gadget",), ("red widgat",), ("zzz",), (None,)], "value string")
    got = {r["value"]: (r["term_id"], r["kind"]) for r in vocabulary.matches(values, terms).collect()}
    assert got == {"Red  Widget": (1, "exact"), "crimson widget": (1, "alias"), "bleu gadget": (2, "fuzzy"), "red widgat": (1, "fuzzy")}


# --- completions ------------------------------------------------------------------------------------------------------


def test_completions(spark, tmp_path):
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("abcA ") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "text string")
    index = Completions.build(df, str(tmp_path / "c"), keep=4, begins=False)

    def check(known):
        for partial in ("a", "AB", "ab c", "abcabc", "abcaabcb", "", "zz", known[3].lower()):
            want = sorted((t.lower().find(partial.lower()) + 1, t) for t in known if partial and partial.lower() in t.lower())[:4]
            assert [(r["place"], r["text"]) for r in index.suggest(partial).collect()] == want, partial

    check(texts)
    index.add(spark.createDataFrame([("zza",), ("abcaabcbx",), (texts[1],)], "text string"))
    index.remove(spark.createDataFrame([(t,) for t in texts[::3]], "text string"))
    check(sorted(({*texts} - {*texts[::3]}) | {"zza", "abcaabcbx"}))
    assert "PartitionFilters: [isnotnull(shard" in plan(index.suggest("ab"))


# --- sketches --------------------------------------------------------------------------------------------------------


def test_sketches_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("at"), (F.hash("id") % 10_000).cast("double").alias("v"), (F.col("id") % 7001).alias("item"))
    days = sketches.daily(rows, "at", ["g"], "v", "item").cache()
    assert days.count() > 15
    ranks = (0.01, 0.25, 0.5, 0.75, 0.99)
    exact = {g: np.sort([r["v"] for r in rows.where(F.col("g") == g).select("v").collect()]) for g in range(3)}
    for r in sketches.over(days, ["g"], ranks=ranks).collect():
        own = exact[r["g"]]
        for rank, q in zip(ranks, r["quantiles"], strict=True):
            assert abs(np.searchsorted(own, q) / len(own) - rank) < 0.027  # twice the stated error
        assert r["n"] == len(own) and abs(r["mean"] - own.mean()) < 1e-6 and abs(r["items"] - 7001) < 0.025 * 7001
    for r in sketches.rank_of(days, ["g"], 0.0).collect():
        assert abs(r["rank"] - np.searchsorted(exact[r["g"]], 0.0, "right") / len(exact[r["g"]])) < 0.027
    one = sketches.over(days, ["g"], "2023-11-16", "2023-11-16").collect()
    assert {r["g"]: r["n"] for r in one} == {r["g"]: r["n"] for r in rows.where("to_date(at) = date'2023-11-16'").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sketches.over(days.limit(0), ["g"]).collect() == []


def test_estimates_are_held_against_exact_figures(spark):
    rng = random.Random(11)
    values = {"a": [float(rng.randrange(40)) for _ in range(500)] + [None] * 60, "b": [rng.gauss(0, 1) for _ in range(301)] + [float("nan")] * 9, None: [1.0] * 50, "none": [None] * 5, "one": [3.5]}
    items = {g: [rng.choice((None, *range(len(v)))) for v in [vs] for _ in vs] for g, vs in values.items()}
    rows = spark.createDataFrame([(g, v, i) for g, vs in values.items() for v, i in zip(vs, items[g], strict=True)], "g string, v double, item long")
    ranks = (0.0, 0.1, 0.5, 0.97)

    def exact(vs, share):
        """The smallest value up to which that share of them lies."""
        return next(x for k, x in enumerate(vs, 1) if k >= share * len(vs))

    asked = []
    for shift in (0.0, -0.6, 0.6, 2.0):
        for g, vs in values.items():
            own, users = sorted(v for v in vs if v is not None and v == v), len({i for i in items[g] if i is not None})
            q = [exact(own, r) + shift for r in ranks] if own else None
            near = all(exact(own, max(0.0, r - 0.03)) <= x <= exact(own, min(1.0, r + 0.03)) for r, x in zip(ranks, q, strict=True)) if own else True
            asked.append((g, shift, q, float(round(users * (1 + shift / 20))), near, abs(round(users * (1 + shift / 20)) - users) <= 0.05 * users))
    assert {a[4] for a in asked} == {a[5] for a in asked} == {True, False}
    for shift in (0.0, -0.6, 0.6, 2.0):
        found = spark.createDataFrame([(g, len(values[g]), None, q, i) for g, s, q, i, *_ in asked if s == shift], "g string, n long, mean double, quantiles array<double>, items double")
        got = sketches.within(found, rows, ["g"], "v", "item", ranks)
        assert {r["g"]: (r["quantiles_near"], r["items_near"]) for r in got.collect()} == {a[0]: a[4:] for a in asked if a[1] == shift}


def test_daily_sketches_keep_no_values_for_each_user(spark, folder):
    got = all_queries()["daily_sketches"](spark, folder)
    nodes = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    of_users = [n for n in nodes if "user_id" in n.split("Aggregate")[-1] and "Aggregate" in n]
    assert of_users and not [n for n in of_users if "value" in n]


def test_daily_sketches_over_nulls(spark, folder, tmp_path):
    """Null types are a group; null values are counted as rows but not in the mean; a type may have no values at all."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type"))
    value = F.when((F.col("event_type") != "click") & (F.col("event_id") % 3 > 0), F.col("value"))
    rows.withColumns({"event_type": kind, "value": value}).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in all_queries()["daily_sketches"](spark, str(tmp_path)).select("event_type", "n", "mean", "quantiles_near", "users_near").collect()]
    assert sorted(got, key=str) == sorted(con.execute(all_sql()["daily_sketches"]).fetchall(), key=str) and len(got) == 5


# --- table functions, aggregates, state ------------------------------------------------------------------------------


def test_streaks_over_batches(spark):
    tables.register(spark)
    rows = spark.range(30_000).select((F.col("id") % 2).cast("string").alias("key"), F.when(F.col("id") < 25_000, "a").when(F.col("id") < 25_010, F.lit(None)).otherwise("b").alias("kind"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"))
    got = spark.sql("SELECT key, kind, n FROM streaks(TABLE(SELECT * FROM {rows}) PARTITION BY key ORDER BY at)", rows=rows).collect()
    assert sorted((r["key"], r["kind"] or "", r["n"]) for r in got) == [("0", "", 5), ("0", "a", 12_500), ("0", "b", 2495), ("1", "", 5), ("1", "a", 12_500), ("1", "b", 2495)]


def test_decayed(spark):
    tables.register(spark, half_life=10.0)
    rows = spark.createDataFrame([("x", 8.0, 0.0), ("x", 1.0, 20.0), ("x", None, 30.0), ("y", None, 1.0), ("z", 3.0, 5.0)], "k string, v double, t double")
    got = spark.sql("SELECT k, s.total AS total, decayed_total(s, 30D) AS later FROM (SELECT k, decayed(v, t) AS s FROM {rows} GROUP BY k)", rows=rows)
    assert {r["k"]: (r["total"], r["later"]) for r in got.collect()} == {"x": (3.0, 1.5), "y": (None, None), "z": (3.0, pytest.approx(3 * 2**-2.5))}
    whole = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.lit(1.0).alias("v"), (F.col("id") % 100).cast("double").alias("t"))
    want = 200 * sum(2 ** ((t - (98 if k == 0 else 99)) / 10) for k in (0,) for t in range(0, 100, 2)) * 2
    got = {r["k"]: r["total"] for r in tables.decayed(whole, ["k"], "v", "t", 10.0).collect()}
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want)


def test_stateful_sessions_go_on_after_a_restart(spark, tmp_path):
    kind = "user string, ts timestamp, value double, kind string"
    source, out = tmp_path / "in", [str(tmp_path / n) for n in ("closed", "late", "checkpoint")]

    def arrive(*rows):
        df = spark.createDataFrame([(u, s, v, k) for u, s, v, k in rows], "user string, s long, value double, kind string")
        df.select("user", F.timestamp_seconds("s").alias("ts"), "value", "kind").coalesce(1).write.mode("append").parquet(str(source))
        found = stateful.sessions(streams.read(spark, str(source), spark.createDataFrame([], kind).schema), "user", "ts", "value", "kind", 60_000, 30_000, trail=2)
        stateful.start(found, *out).awaitTermination()

    t = 1_700_000_000
    arrive(("a", t, 1.0, "x"), ("a", t + 50, 2.0, "y"), ("b", t + 10, 5.0, "x"), (None, t, 1.0, "x"), ("a", None, 1.0, "x"))
    # the next rows: one out of order but in time, one that begins a session, one that is too late
    arrive(("a", t + 30, 4.0, "z"), ("b", t + 200, 1.0, "y"))
    arrive(("a", t + 20, 9.0, "w"), ("b", t + 500, 1.0, None))
    closed = {(r["key"], r["nth"]): (r["n"], r["total"], r["trail"]) for r in spark.read.parquet(out[0]).collect()}
    assert closed == {("a", 0): (3, 7.0, "z>y"), ("b", 0): (1, 5.0, "x"), ("b", 1): (1, 1.0, "y")}
    assert [(r["key"], r["total"], r["trail"]) for r in spark.read.parquet(out[1]).collect()] == [("a", 9.0, "w")]


# --- what a session and a driver need ---------------------------------------------------------------------------------


def test_workers_have_the_package_from_any_folder(tmp_path):
    """The driver alone knows where the package lies."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from taxolark.session import session
from taxolark.operators import editjoin
spark = session("far", spark__master="local[1]", spark__ui__enabled="false", spark__driver__memory="1g", spark__sql__shuffle__partitions="1")
df = spark.createDataFrame([("abcd",), ("abce",)], "text string")
print("pairs", editjoin.near_texts(df, df, 0.7).count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "pairs 4" in out.stdout, out.stderr[-2000:]


def test_tables_of_a_scope_go_with_it(spark):
    import os

    from taxolark.operators import relations
    from taxolark.operators.stored import _roots, scope, stored

    outer = stored(spark.range(3))
    nodes, edges = spark.range(5).toDF("node"), spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "source long, target long, confidence double")
    place = _roots[spark.sparkContext.applicationId].removeprefix("file:")
    before = set(os.listdir(place))
    with scope():
        assert relations.components(nodes, edges).where("component = 0").count() == 3 and relations.pagerank(nodes, edges).count() == 5
        assert set(os.listdir(place)) > before
    assert set(os.listdir(place)) == before and outer.count() == 3


def test_metric_log(spark, tmp_path):
    from taxolark.operators.governance import MetricLog

    log = MetricLog(spark, str(tmp_path / "m"))
    rows = spark.range(400).select(F.lit("took").alias("name"), F.col("id").cast("double").alias("value"), F.timestamp_seconds(1_700_000_000 + 3600 * F.col("id")).alias("at"), F.col("id").alias("key"))
    log.record(rows.where("id < 300"))
    log.record(rows.where("id >= 300").unionByName(spark.createDataFrame([(None, 1.0, None, 1), ("took", None, None, 2)], "name string, value double, at timestamp, key long")))
    assert [float(r["value"]) for r in log.last(5).collect()] == [399.0, 398.0, 397.0, 396.0, 395.0]
    assert log.last(1000, "took").count() == 400 and log.last(3, "other").count() == 0
    one = log.summary().first()
    assert (one["n"], one["mean"], one["least"], one["most"], one["p95"]) == (400, 199.5, 0.0, 399.0, 379.0)


def test_texts_with_a_part_that_all_share_meet_by_halves(spark, monkeypatch):
    monkeypatch.setattr(editjoin, "CROWD", 3)
    rng = random.Random(12)
    words = ["".join(rng.choice("ab0") for _ in range(rng.randrange(9))) for _ in range(60)]
    a = [f"customer#00{w}" for w in words] + ["".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(40)]
    b = [f"supplier#00{w[::-1]}" for w in words] + [f"custmer#00{w[1:]}" for w in words[:20]] + ["", "ab", "ba"]
    pairs = lambda t: spark.createDataFrame([(x,) for x in t], "text string")
    for threshold, most in ((0.7, 10**9), (0.5, 10**9), (0.7, -1)):
        monkeypatch.setattr(editjoin, "HEADS", most)
        got = [(r["x"], r["y"]) for r in editjoin.near_texts(pairs(a), pairs(b), threshold).collect()]
        both = pairs(a).distinct().crossJoin(pairs(b).distinct().toDF("y"))
        longest = F.greatest(F.length("text"), F.length("y"))
        want = both.where((longest == 0) | (1 - F.levenshtein("text", "y") / longest >= threshold))
        assert sorted(got) == sorted(tuple(r) for r in want.collect())
