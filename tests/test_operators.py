"""Operators on small tables made here: known values, nulls, ties, and what SQL over the given tables can't show."""

import os
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from taxolark.functions import text as tf
from taxolark.functions import vector as vf
from taxolark.operators import aggregate as agg
from taxolark.operators import filters as ff
from taxolark.operators import governance, greedy, mapping, quality, ranking, relations, search, semantic, stored, taxonomy, vocabulary
from taxolark.sources import items, models, packs
from taxolark.streaming import streams


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  Red  Widget ", "red widget"),
        ("phone w/ case", "phone with case"),
        ("phone w/o case", "phone without case"),
        ("salt & pepper", "salt and pepper"),
        ("a + b", "a plus b"),
        ("sz_large clr", "sz large color"),
        ("t-shirt (blue)!", "t-shirt blue"),
        ("", ""),
    ],
)
def test_normalize_term(spark, raw, want):
    assert one(spark, tf.normalize_term(F.lit(raw))) == want


def test_levenshtein_similarity(spark):
    pairs = [("", "", 1.0), ("a", "", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("Same", "sAME", 1.0), ("é", "e", 0.0)]
    for a, b, want in pairs:
        assert one(spark, tf.levenshtein_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_within_similarity_agrees(spark):
    words = ["red widget", "red widgit", "rd widget", "blue rod", "", "r", "red widgets and more"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for t in (0.0001, 0.3, 0.5, 0.8, 0.95, 1.0):
        for q in ("red widget", "r"):
            near = df.select(tf.within_similarity(F.col("w"), q, t).alias("a"), (tf.levenshtein_similarity(F.col("w"), F.lit(q)) >= t).alias("b"), "w").collect()
            assert all(bool(r["a"]) == r["b"] for r in near if r["w"]), (t, q, near)


def test_bigram_jaccard(spark):
    for a, b, want in [("ab", "ab", 1.0), ("a", "b", 1.0), ("a", "ab", 0.0), ("night", "nacht", 1 / 7), ("", "", 1.0)]:
        assert one(spark, tf.bigram_jaccard(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_keywords_phrases_clean(spark):
    t = F.lit('The "Quick" brown fox, and the quick dog!')
    assert one(spark, tf.keywords(t)) == ["quick", "brown", "fox", "quick", "dog"]
    assert "quick dog!" in one(spark, tf.phrases(t)) and "the quick" not in one(spark, tf.phrases(t))
    assert one(spark, tf.phrases(F.lit("one"))) == []
    assert one(spark, tf.clean_for_embedding(F.lit("  café —  中文!! ok...  x "))) == "café 中文 ok. x"


def test_units(spark):
    got = one(spark, tf.extract_units(F.lit("1.5 kg and 20CM, 3 oz")))
    assert [(u["measure"], u["number"], u["unit"]) for u in got] == [("weight", 1.5, "kg"), ("weight", 3.0, "oz"), ("length", 20.0, "CM"), ("volume", 3.0, "oz")]


def test_attribute_normalization(spark):
    assert one(spark, tf.attribute_name(F.lit("Screen Size-value!"))) == "screen_size_value"
    assert one(spark, tf.attribute_value(F.lit(" YES "), "boolean")) == "true"
    assert one(spark, tf.attribute_value(F.lit("$1,200.50"), "numeric")) == "1200.50"
    assert one(spark, tf.attribute_value(F.lit("BLUE"), "categorical", None, ["Blue"])) == "Blue"


def test_vectors(spark):
    a, b, z = vf.literal([1, 0]), vf.literal([0, 2]), vf.literal([0, 0])
    assert one(spark, vf.cosine(a, b)) == 0.0 and one(spark, vf.cosine(a, a)) == 1.0 and one(spark, vf.cosine(a, z)) == 0.0
    assert one(spark, vf.cosine(a, vf.literal([1, 0, 0]))) == 0.0
    assert one(spark, vf.euclidean(a, b)) == pytest.approx(5**0.5) and one(spark, vf.manhattan(a, b)) == 3.0
    assert one(spark, vf.weighted_average([a, b], [1, 1])) == [0.5, 1.0]
    assert one(spark, vf.norm(vf.hashed_embedding(F.lit("some words here")))) == pytest.approx(1.0)
    assert set(one(spark, vf.hashed_embedding(F.lit("  ")))) == {0.0}


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, "Ab"), (2, None), (3, " "), (4, "xyz")], "id int, s string")

    def ids(*f):
        return [r["id"] for r in ff.apply(df, [ff.Filter(*x) for x in f]).orderBy("id").collect()]

    assert ids(("s", "ne", "ab")) == [2, 3, 4] and ids(("s", "eq", "AB")) == [1]
    assert ids(("s", "not_in", ["ab"])) == [2, 3, 4] and ids(("s", "not_contains", "y")) == [1, 2, 3]
    assert ids(("s", "is_null")) == [2, 3] and ids(("s", "is_not_null")) == [1, 4]
    assert ids(("s", "regex", r"^\S+$")) == [1, 4] and ids(("id", "between", [2, 3])) == [2, 3]
    assert ids(("S ", "eq", "ab")) == [1]  # field names are trimmed and lower case
    assert ff.problems([ff.Filter("", "eq", 1), ff.Filter("a", "in", 3), ff.Filter("a", "between", [1]), ff.Filter("a", "zz", 1), ff.Filter("a", "eq")]) != []
    assert ff.normal(ff.Filter("a", "eq", "X", weight=99)).weight == 10.0


def test_sort_nulls_and_pages(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "id int, v int")
    assert [r["id"] for r in ff.order(df, [ff.Sort("v")], "id").collect()] == [4, 2, 3, 1]
    assert [r["id"] for r in ff.order(df, [ff.Sort("v", False, "first"), ff.Sort("v")], "id").collect()] == [1, 2, 3, 4]
    assert [r["id"] for r in ff.page(ff.order(df, [], "id"), ff.Page(0, -5)).collect()] == [1]


def test_request_rewriting(spark):
    r = search.Request("exact", "x", filters=(ff.Filter("a", "gt", 1), ff.Filter("b", "contains", "q"), ff.Filter("c", "eq", 1), ff.Filter("c", "eq", 1)), sorts=(ff.Sort("a"), ff.Sort("a", False)), window=ff.Page(5000, -3))
    o = search.optimize(r)
    assert [f.operator for f in o.filters] == ["eq", "contains", "gt"]
    assert o.sorts == (ff.Sort("a"),) and o.window == ff.Page(1000, 0)
    assert search.problems(search.Request("fuzzy", " ", fuzzy=2)) != []
    a = agg.Aggregation("count", filters=(ff.Filter("a", "gt", 1),))
    assert len(agg.distinct_requests([a, a, agg.Aggregation("count")])) == 2


def test_engine(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None)], "id int, t string")
    e = search.Engine(df, search.Shape("id", ("t",)))
    assert "exact" in e.supported()
    assert [r["id"] for r in e.run(search.Request("exact", "ALPHA")).collect()] == [2]
    assert [r["id"] for r in e.run(search.Request("full_text", "alpha beta")).collect()] == [1, 2]
    assert [r["id"] for r in e.run(search.Request("semantic", "alpha", similarity=0.9)).collect()] == [2]
    assert e.run(search.Request("hybrid", "alpha", similarity=0.9)).collect()[0]["id"] == 2
    with pytest.raises(ValueError):
        e.run(search.Request("graph", "a"))
    e.register("graph", lambda d, r, s: d.limit(1))
    assert e.run(search.Request("graph", "a")).count() == 1


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("a", "A", None, 0, ["A"]), ("b", "B", "a", 1, ["A", "B"]), ("c", "C", "b", 2, ["A", "B", "C"]), ("d", "D", "a", 1, ["A", "D"]), ("e", "E", None, 0, ["E"])]
    return spark.createDataFrame([(*r, "active") for r in rows], "category_id string, name string, parent_id string, level int, path array<string>, status string")


def test_tree_changes(spark, tree):
    moved = {r["category_id"]: r for r in taxonomy.move(tree, "b", "e").collect()}
    assert moved["c"]["path"] == ["E", "B", "C"] and moved["b"]["parent_id"] == "e" and moved["c"]["level"] == 2
    top = {r["category_id"]: r for r in taxonomy.move(tree, "b", None).collect()}
    assert top["b"]["path"] == ["B"] and top["b"]["level"] == 0
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            taxonomy.move(tree, "b", bad)
    merged = {r["category_id"]: r for r in taxonomy.merge(tree, "b", "d").collect()}
    assert merged["c"]["path"] == ["A", "D", "C"] and merged["b"]["status"] == "merged" and merged["b"]["merged_into"] == "d"
    with pytest.raises(ValueError):
        taxonomy.delete(tree, "a")
    gone = {r["category_id"] for r in taxonomy.delete(tree, "a", recursive=True).where("status = 'deprecated'").collect()}
    assert gone == {"a", "b", "c", "d"}
    new = taxonomy.create(tree, "f", "F", "c").where("category_id = 'f'").first()
    assert new["path"] == ["A", "B", "C", "F"] and new["level"] == 3
    with pytest.raises(ValueError):
        taxonomy.create(tree, "g", "b", "a")


def test_tree_queries(spark, tree):
    ids = lambda df: [r["category_id"] for r in df.collect()]
    assert ids(taxonomy.traverse(tree, "pre_order")) == ["a", "b", "c", "d", "e"]
    assert ids(taxonomy.traverse(tree, "post_order")) == ["c", "b", "d", "a", "e"]
    assert ids(taxonomy.breadcrumbs(tree, "c")) == ["a", "b", "c"]
    assert ids(taxonomy.siblings(tree, "b")) == ["d"] and ids(taxonomy.siblings(tree, "a")) == ["e"]
    assert ids(taxonomy.subtree(tree, ["A", "B"]).orderBy("level")) == ["b", "c"]
    assert one(spark, taxonomy.common_prefix(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit("x"), F.lit("q"), F.lit("z")))) == 1
    broken = tree.unionAll(spark.createDataFrame([("z", "Z", "nope", 5, ["Z"], "active")], tree.schema))
    assert {(r[0], r[1]) for r in taxonomy.issues(broken).collect()} == {("orphan", "z"), ("path_shape", "z")}
    assert taxonomy.cytoscape(tree).count() == 8
    flat = taxonomy.flatten([{"id": 1, "name": "x", "children": [{"id": 2, "name": "y", "attributes": ["k"]}]}])
    assert flat == [("1", "x", None, 0, ["x"], []), ("2", "y", "1", 1, ["x", "y"], ["k"])]


def test_vocabulary(spark):
    t = spark.createDataFrame([(1, "color", None, ["colour"], 5, "d", "2024-01-01"), (2, "size", 1, [], 0, None, "2023-01-01"), (3, "COLOR ", None, [], 1, None, "2024-01-01")], "term_id int, term string, parent_term_id int, aliases array<string>, usage_count int, description string, created_at string")
    v = spark.createDataFrame([("Colour",), ("sizes",), (None,), ("zzz",)], "value string")
    got = {r["value"]: (r["term_id"], r["kind"]) for r in vocabulary.matches(v, t).collect()}
    assert got == {"Colour": (1, "alias"), "sizes": (2, "fuzzy")}
    assert {r["value"]: r["valid"] for r in vocabulary.validate(v, t, "permissive").collect()} == {"Colour": True, "sizes": True, "zzz": True}
    assert [(r["a"], r["b"], r["score"]) for r in vocabulary.similar_pairs(t, 0.9).collect()] == [(1, 3, 1.0)]
    recs = [(r["kind"], r["term_id"]) for r in vocabulary.recommendations(t, "2024-02-01").collect()]
    assert recs == [("merge", 1), ("cleanup", 2)]
    assert [(r["term_id"], r["relation"]) for r in vocabulary.related(t, 2).collect()] == [(1, "parent")]


def test_similar_pairs_against_all_pairs(spark):
    words = ["alpha beta", "alpha bets", "alph beta", "gamma", "gammas", "g", "h", "", "delta x", "delta y", "beta alpha"]
    t = spark.createDataFrame(list(enumerate(words)), "term_id int, term string")
    for cut in (0.3, 0.5, 0.8):
        got = {(r["a"], r["b"]) for r in vocabulary.similar_pairs(t, cut).collect()}
        x, y = t.toDF("a", "ta"), t.toDF("b", "tb")
        want = x.join(y, F.col("a") < F.col("b")).where(tf.bigram_jaccard(tf.normalize_term(F.col("ta")), tf.normalize_term(F.col("tb"))) > cut)
        assert got == {(r["a"], r["b"]) for r in want.collect()}


def test_mapping(spark):
    df = spark.createDataFrame([("x", None, 3, "u1"), (None, "y", None, "u2"), ("bad thing", None, 1, "u3"), (" ", None, 1, "u4")], "product_name string, title string, price int, uri string")
    out = mapping.adapt(df, {"title": ["product_name", "title"], "description": ["desc"]}, "src", {"X": "Ex"}, ["BAD"], "uri").orderBy("title").collect()
    assert [r["title"] for r in out] == ["Ex", "y"]
    assert out[0]["raw_attributes"] == {"price": "3", "uri": "u1"} and out[1]["raw_attributes"] == {"uri": "u2"}
    assert out[0]["item_id"].startswith("item_") and len(out[0]["item_id"]) == 17
    ok, bad = mapping.bulk_split(spark.createDataFrame([("1", "t", None, "s", "en"), ("", "t", None, "s", "english")], "item_id string, title string, description string, source string, language string"), mapping.item_errors())
    assert ok.count() == 1 and bad.first()["errors"] == ["item_id", "language"]


def test_quality(spark):
    rows = [("i", [("kind", "zzz", "", None), ("kind", " ", "long evidence here", 1.5)], [("T", "ctx", 0.1), ("t", "context", 0.9)]), ("j", [], [])]
    x = spark.createDataFrame(rows, "item_id string, attributes array<struct<name:string,value:string,evidence:string,confidence:double>>, terms array<struct<term:string,context:string,confidence:double>>")
    schema = [quality.Attribute("kind", "categorical", True, ("a", "b"))]
    got = {(r["item_id"], r["rule"], r["field"]) for r in quality.issues(x, schema, ["brand"], 1, 3).collect()}
    assert got == {
        ("i", "not_allowed", "kind"), ("i", "empty_value", "kind"), ("i", "short_evidence", "kind"), ("i", "confidence_range", "kind"), ("i", "duplicate_attribute", "kind"),
        ("i", "duplicate_term", "t"), ("i", "short_context", "T"), ("i", "low_confidence", "T"), ("i", "rule_required", "brand"), ("i", "rule_terms", ""),
        ("j", "missing", "kind"), ("j", "nothing", ""), ("j", "rule_required", "brand"), ("j", "rule_attributes", ""), ("j", "rule_terms", ""),
    }
    s = {r["item_id"]: r for r in quality.scores(x, quality.issues(x, schema), ["kind"]).collect()}
    assert s["i"]["coverage"] == 1.0 and s["j"]["schema_score"] == 0.8 and s["j"]["evidence"] == 1.0
    numeric = quality.Attribute("n", "numeric", True)
    assert one(spark, quality.value_errors(F.lit("12x"), numeric)) == ["number"] and one(spark, quality.value_errors(F.lit(None).cast("string"), numeric)) == ["required"]
    assert one(spark, quality.value_errors(F.lit("abc"), quality.Attribute("t", "text", pattern="b"))) == ["pattern"]
    assert one(spark, quality.parse_response(F.lit("no json"))) is None
    a, t = quality.mock_extract(F.lit("Red phone"), {"red": ("color", "red"), "blue": ("color", "blue")})
    assert [x["value"] for x in one(spark, a)] == ["red"] and len(one(spark, t)) == 1


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, "similar", 0.9), (2, 3, "similar", 0.8), (1, 4, "related", 0.7), (4, 3, "related", 0.2), (5, 6, "synonym", 1.0)], "source long, target long, relation string, confidence double")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r["node"]: r["component"] for r in relations.components(n, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert relations.shortest_path(e, 1, 3).first()["path"] == [1, 2, 3]
    assert relations.shortest_path(e, 3, 1).first() is None
    assert sum(r["rank"] for r in relations.pagerank(n, e, 5).collect()) == pytest.approx(1.0)
    assert [(r["component"], r["size"]) for r in relations.clusters(n, e).collect()] == [(1, 4)]
    assert {(r["node"], r["hops"]) for r in relations.neighbourhood(e, 1).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2)}
    for s, t, sim, want in [("dog", "dog", 0.1, "synonym"), ("gaming laptop", "laptop", 0.5, "hyponym"), ("car", "sports-car part", 0.5, "holonym"), ("a", "b", 0.6, "related"), ("a", "b", 0.4, None)]:
        assert one(spark, relations.classify(F.lit(s), F.lit(t), F.lit(sim))[0]) == want


def test_leaders_and_diversity(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5)], "a long, b long")
    assert {r["id"]: r["leader"] for r in greedy.leaders(nodes, pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}
    r = spark.createDataFrame([(1, "a b c d e", 0.9), (2, "a b c d e", 0.8), (3, "a b c d e f", 0.7), (4, "x y", 0.5)], "id long, text string, score double")
    got = [(x["id"], round(x["score"], 4)) for x in ranking.diversify(r).collect()]
    assert got == [(1, 0.9), (3, round(0.7 * (1 - 0.3 * 5 / 6), 4)), (4, 0.5)]


@pytest.mark.parametrize("walk", [500_000, 60])
def test_leaders_of_a_long_chain(spark, monkeypatch, walk):
    """An item in 300 steps of a chain gets the leader that a walk gives it; with groups walked whole, and in stretches."""
    n = 300
    monkeypatch.setattr(greedy, "WALK", walk)
    rng = random.Random(1)
    near = [(i, i + 1) for i in range(1, n)] + [(i, j) for i, j in ((rng.randrange(1, n), rng.randrange(1, n)) for _ in range(40)) if i < j]
    lead = {}
    for i in range(1, n + 1):
        first = min((a for a, b in near if b == i and lead[a] == a), default=i)
        lead[i] = first
    nodes = spark.createDataFrame([(i,) for i in range(1, n + 1)], "id long")
    pairs = spark.createDataFrame(near + [(None, 3), (7, None), (900, 5)], "a long, b long")
    assert {r["id"]: r["leader"] for r in greedy.leaders(nodes, pairs).collect()} == lead
    assert greedy.leaders(nodes.limit(0), pairs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(400)] + [(500, 501), (None, 3)], "source long, target long")
    n = spark.createDataFrame([(i,) for i in [*range(401), 500, 501, 600]], "node long")
    want = dict.fromkeys(range(401), 0) | {500: 500, 501: 500, 600: 600}
    assert {r["node"]: r["component"] for r in relations.components(n, e).collect()} == want


def test_diversity_beyond_a_hundred(spark):
    """All results are held against each other, with several penalties, ties and texts without words."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(8, 12))), rng.randrange(40) / 40) for i in range(260)] + [(900, "", 0.5), (901, None, 0.5), (902, "", 0.5)]
    kept = []
    for i, text, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        own = set((text or "").split())
        sims = [len(own & o) / len(own | o) if own and o else 0.0 for _, o, _ in kept]
        if not any(s > 0.9 for s in sims):
            for s in sims:
                score *= 1 - 0.3 * s if s > 0.8 else 1
            kept.append((i, own, score))
    got = ranking.diversify(spark.createDataFrame(rows, "id long, text string, score double")).collect()
    assert {r["id"]: r["score"] for r in got} == {i: pytest.approx(s, abs=1e-6) for i, _, s in kept}
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_graph_figures_against_force(spark):
    rng = random.Random(2)
    links = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(120)} | {(0, i) for i in range(1, 30)}
    e = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in links] + [(3, 3)], "source long, target long")
    near = {n: {b if a == n else a for a, b in links if n in (a, b)} for n in range(30)}
    want = {n: round(sum((a, b) in links for a in o for b in o if a < b) / (len(o) * (len(o) - 1) / 2), 6) if len(o) > 1 else 0.0 for n, o in near.items() if o}
    assert {r["node"]: r["coefficient"] for r in relations.clustering_coefficient(e).collect()} == want
    nodes = spark.createDataFrame([(i,) for i in range(32)], "node long")
    x = {n: float(bool(near.get(n))) for n in range(32)}
    for _ in range(6):
        y = {n: x[n] + sum(x[m] for m in near.get(n, ())) for n in x}
        x = {n: v / max(y.values()) for n, v in y.items()}
    assert {r["node"]: pytest.approx(r["centrality"]) for r in relations.eigenvector(nodes, e, 6).collect()} == x


def test_cooccurrence_in_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "BASKET", 4)
    rng = random.Random(5)
    rows = [(g, rng.randrange(40)) for g in range(6) for _ in range([3, 60, 10, 1, 25, 4][g])] + [(None, 3), (2, None)]
    count = {}
    for g in range(6):
        own = sorted({i for h, i in rows if h == g and i is not None})
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                count[a, b] = count.get((a, b), 0) + 1
    got = vocabulary.cooccurrence(spark.createDataFrame(rows, "g long, i long"), "i", "g", 2)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {k: v for k, v in count.items() if v >= 2}


def test_cooccurrence_deals_pairs_into_bounded_tasks(spark, monkeypatch):
    for name, most in (("BASKET", 4), ("ROWS", 100), ("PAIRS", 16)):
        monkeypatch.setattr(vocabulary, name, most)
    rows = [(g, i) for g in range(50) for i in range(g % 9)] * 2
    got = vocabulary.cooccurrence(spark.createDataFrame(rows, "g long, i long"), "i", "g", 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    parts = [int(x) for x in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)]
    assert len(parts) == 3 and min(parts) >= 20  # by far more pairs than shuffled bytes would tell
    own = [set(range(g % 9)) for g in range(50)]
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {(a, b): n for a in range(9) for b in range(a + 1, 9) if (n := sum({a, b} <= o for o in own))}


def test_cooccurrence_counts_pairs_in_bounded_tasks(spark, monkeypatch):
    for name, most in (("BASKET", 8), ("PAIRS", 50)):
        monkeypatch.setattr(vocabulary, name, most)
    # nearly all pairs differ, and all groups hold one of them
    rows = [(g, i) for g in range(60) for i in (-2, -1, *range(5 * g, 5 * g + (20 if g == 7 else 5)))]
    got = vocabulary.cooccurrence(spark.createDataFrame(rows, "g long, i long"), "i", "g", 1)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    count = Counter(p for g in range(60) for p in combinations(sorted(i for h, i in rows if h == g), 2))
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == count and count[-2, -1] == 60
    assert len(sizes) > 15 and max(sizes) < 150  # few bytes, which would be one task's
    # nor does a frequent pair come as a row for each group: counts of lots are dealt
    told = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in told.split("RepartitionByExpression [a")[1]


def test_similarity_edges_prune_nothing_near(spark, monkeypatch):
    import math

    monkeypatch.setattr(relations, "BLOCK", 7)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) + 2 * (i % 3), rng.gauss(0, 1), rng.gauss(0, 1) - (i % 5)]) for i in range(60)] + [(70, [0.0, 0.0, 0.0]), (71, None), (None, [1.0, 2.0, 3.0])]
    good = {i: v for i, v in rows if i is not None and v and any(v)}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for t in (0.9, 0.0, -2.0):
        got = {(r["source"], r["target"]) for r in relations.similarity_edges(df, df, t).collect()}
        assert got == {(i, j) for i in good for j in good if i != j and cos(good[i], good[j]) >= t}
    best = relations.similarity_edges(df, df, 0.5, 2).groupBy("source").count()
    assert best.where("count > 2").isEmpty()


def test_hierarchy_of_terms(spark):
    rows = [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, 99), (7, 8), (8, 7)]
    h = vocabulary.Hierarchy(spark.createDataFrame(rows, "term_id long, parent_term_id long"))
    assert [r["term_id"] for r in h.path(5).orderBy("place").collect()] == [1, 2, 4, 5]
    assert {(r["term_id"], r["distance"]) for r in h.descendants(1).collect()} == {(2, 1), (3, 1), (4, 2), (5, 3)}
    assert {r["term_id"] for r in h.descendants(1, 1).collect()} == {2, 3}
    assert [r["term_id"] for r in h.siblings(2).collect()] == [3] and h.siblings(1).isEmpty()
    assert {(r["root_id"], r["terms"], r["depth"]) for r in h.depths().collect()} == {(1, 5, 3), (6, 1, 0)}  # a missing parent makes a root, a circle none


def test_governance(spark):
    m = spark.createDataFrame([(1, 95.0, 10.0, 2.0), (2, 80.0, 10.0, 20.0)], "at int, cpu double, memory double, error_rate double")
    assert {(r["at"], r["severity"]) for r in governance.alerts(m).collect()} == {(1, "critical"), (2, "high")}
    assert [r["status"] for r in governance.health(m).orderBy("at").collect()] == ["critical", "warning"]
    u = spark.createDataFrame([("a", "admin", True), ("b", "read", True), ("c", "system", False)], "id string, level string, is_active boolean")
    assert [r["id"] for r in governance.allowed(u, "write").collect()] == ["a"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"item_id": "1", "title": "x", "metadata": {"k": "v"}}, {"item_id": "2"}]')
    (tmp_path / "b.json").write_text('{"item_id": "3"}')
    assert items.read_file(spark, str(tmp_path / "a.json")).count() == 2
    assert items.read_directory(spark, str(tmp_path)).count() == 3
    store = items.Store(spark, str(tmp_path / "store"))
    store.stage("t", spark.range(3))
    store.rollback()
    assert store.names() == []
    store.stage("t", spark.range(3))
    store.commit()
    store.append("t", spark.range(3, 5))
    assert store.read("t").count() == 3
    store.commit()
    assert store.read("t").count() == 5 and [(r[0], r[1]) for r in store.health().collect()] == [("t", 5)]
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, None, True)], "k int, at int, v string, deleted boolean")
    assert [(r["k"], r["v"]) for r in items.latest(log, "k", "at").collect()] == [(1, "b")]
    got = items.migrations(spark.createDataFrame([(1,)], "version int"), [(1, "first"), (2, "second")]).collect()
    assert [(r["version"], r["applied"]) for r in got] == [(1, True), (2, False)]


PACK = {
    "domain": "shop",
    "taxonomy_version": "2024.01",
    "input_mapping": {"title": ["name", "title"], "description": "desc", "language": ["lang"]},
    "output_schema": {"core_item": ["title"], "attributes": [{"key": "brand", "type": "categorical", "required": True}, {"key": "price", "type": "numeric"}]},
    "attribute_hints": {"brand": {"allow_values": ["Acme"]}},
    "rules": {"blocked_terms": ["spam"], "normalize_map": {"iphone": "iPhone"}},
}


def test_packs(spark, tmp_path):
    import yaml

    (tmp_path / "domain.yaml").write_text(yaml.safe_dump(PACK))
    loader = packs.Loader()
    p = loader.load_directory(tmp_path)
    assert loader.cached() and [a.key for a in p.attributes()] == ["brand", "price"] and p.attributes()[0].allowed == ("Acme",)
    assert p.schema().fieldNames() == ["brand", "price"] and packs.scan(tmp_path)
    df = spark.createDataFrame([("IPHONE 5", "ok", "en"), ("spam", "x", "en")], "name string, desc string, lang string")
    assert [r["title"] for r in p.adapt(df, "s").collect()] == ["iPhone 5"]
    assert packs.problems(PACK | {"taxonomy_version": "1.0.0"}) and packs.problems({}) and not packs.problems(PACK)
    with pytest.raises(packs.PackError):
        packs.pack(PACK | {"attribute_hints": {"nope": {}}})
    core, own = {"a": {"type": "text", "examples": ["x"]}}, {"a": {"type": "numeric", "examples": ["y"]}, "b": {}}
    assert packs.merge(core, own)["a"]["type"] == "numeric" and packs.merge(core, own, "core_wins")["a"]["type"] == "text"
    assert packs.merge(core, own, "merge")["a"]["examples"] == ["x", "y"]
    with pytest.raises(packs.PackError):
        packs.merge(core, own, "strict")


def test_models(spark):
    df = spark.createDataFrame([("a",), ("boom",)], "p string")

    def client(p):
        if p == "boom":
            raise RuntimeError(p)
        return p * 2

    assert [r["response"] for r in models.complete(df, "p", client, retries=2, wait=0).collect()] == ["aa", None]
    texts = spark.createDataFrame([("x",), (" ",), (None,)], "t string")
    assert [r["embedding"] for r in models.embed(texts, "t", lambda ts: [[1.0, 2.0] for _ in ts], 2).collect()] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


def test_streaming(spark, tmp_path, folder):
    src = spark.read.parquet(f"{folder}/events.parquet").where("event_id < 300")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_time(streams.read(spark, str(tmp_path / "in"), src.schema, files=1))
    split = lambda b: b.withColumn("errors", F.when(F.col("event_type") == "error", F.array(F.lit("error"))))
    seen = []
    q = streams.ingest(stream, split, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"), callback=lambda b, n: seen.append(n))
    q.awaitTermination()
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.count() + bad.count() == 300 and bad.where("event_type <> 'error'").isEmpty() and len(seen) == 3
    out = streams.tumbling(stream, "1 day", "event_type", "value", late="1 day")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = streams.tumbling(streams.event_time(src), "1 day", "event_type", "value")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))


def test_links_of_a_frequent_term_are_dealt_into_tasks(spark, monkeypatch):
    monkeypatch.setattr(semantic, "TERMS", 8)
    names = [(i, ("Red", "blue", None, "green")[i % 4]) for i in range(200)] + [(None, "red"), (3, "red")]
    asked = [("RED", "blue", "x", 0.5), ("red", "Red", "y", 0.25), ("red", "Red", "y", 0.25), ("red", "none", "z", 1.0), (None, "red", "n", 1.0)]
    got = semantic.link_by_term(spark.createDataFrame(names, "term_id long, normalized_term string"), spark.createDataFrame(asked, "from_term string, to_term string, relation string, strength double"))
    low = [(i, n.lower()) for i, n in names if n and i is not None]
    want = sorted((a, b, r, s) for f, t, r, s in asked if f for a, x in low for b, y in low if x == f.lower() and y == t.lower() and a != b)
    assert sorted(tuple(r) for r in got.collect()) == want
    shares = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(shares) > 20 and max(shares) < len(want) / 4


def test_mappings_of_a_long_history(spark, monkeypatch):
    rng = random.Random(9)
    for stretch, nested in ((7, False), (11, True), (1000, False)):
        monkeypatch.setattr(mapping, "STRETCH", stretch)
        spans = [(f"t{rng.randrange(3)}", rng.choice(["a", "b", None]), f := rng.randrange(60), rng.choice([None, f + rng.randrange(-1, 40)])) for _ in range(40)]
        if nested:
            spans = [("t0", f"m{i}", i, 60 - i) for i in range(30)] + [("t1", "open", 3, None)]
        spans += [(None, "x", 1, None), ("t2", "never", None, None)]
        asked = [(i, f"t{rng.randrange(4)}", rng.randrange(62)) for i in range(120)] + [(900, None, 5), (901, "t0", None)]
        got = mapping.apply_mappings(spark.createDataFrame(asked, "id long, term string, at int"), spark.createDataFrame(spans, "from_term string, to_term string, valid_from int, valid_to int"))
        assert got.columns == ["id", "term", "at", "mapped"]

        def best(term, at):
            good = [(f, to is not None, to or "") for t, to, f, end in spans if None not in (term, at, f) and t == term and f <= at and (end is None or at < end)]
            return (max(good)[2] or None) if good else term

        assert {r["id"]: r["mapped"] for r in got.collect()} == {i: best(t, a) for i, t, a in asked}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct(valid_from" not in plan


def test_whole_products_are_formed_without_shuffling_vectors(spark, monkeypatch):
    for name, most in (("BLOCK", 16), ("TILE", 3), ("HELD", 1000)):
        monkeypatch.setattr(relations, name, most)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 + i % 2)]) for i in range(90)] + [(5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = relations.similarity_edges(df, df, -2.0)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, j) for i, v in rows for j, w in rows if i != j and len(v) == len(w))
    assert sorted((r["source"], r["target"]) for r in got.collect()) == want


def test_products_leave_one_copy_of_the_vectors_on_disk(spark):
    def tables():
        root = stored._roots.get(spark.sparkContext.applicationId, "").removeprefix("file:")
        return set(os.listdir(root)) if os.path.isdir(root) else set()

    rng = random.Random(9)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)], "id long, v array<float>")
    other = df.where("id < 20")
    before = tables()
    same, two = relations.similarity_edges(df, df, -2.0), relations.similarity_edges(df, other, -2.0)
    assert len(tables() - before) == 3  # of the first call one table, of the second one for either side
    kind = next(f.dataType for t in tables() - before for f in spark.read.parquet(f"{stored._roots[spark.sparkContext.applicationId]}/{t}").schema if f.name in ("x", "y"))
    assert kind.elementType["v"].dataType.elementType.typeName() == "float"  # as given, not twice as wide
    assert same.count() == 50 * 49 and two.count() == 50 * 20 - 20
    with stored.scope():
        assert relations.similarity_edges(df, df, -2.0).count() == 50 * 49
    assert len(tables() - before) == 3
