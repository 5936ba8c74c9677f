"""Operators on links and vectors against brute force: components, SimHash, embeddings, nearest neighbours, the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest_llm import clashing
from pyspark.sql import functions as F

from taxolark.llm import ann, embed_dedup, golay, simhash
from taxolark.llm.components import components
from taxolark.llm.tables import Shelf


def reachable(nodes, links):
    """The smallest node reachable from each."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "rings", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(40)] + [(i, i + 100) for i in range(40)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "rings": [(10 * g + i, 10 * g + (i + 3) % 10) for g in range(5) for i in range(10)],
        "none": [],
    }[shape]
    rows = [*links, (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long"), Shelf(spark)).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == reachable(nodes, [(a, b) for a, b in links if a != b])


def test_golay_keys():
    """Distances of codewords, and the promise on words one bit apart."""
    code = {m: m << 11 | golay._remainder(m << 11) for m in range(4096)}
    assert min(bin(c).count("1") for c in code.values() if c) == 7
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 300)
    near, (row, around) = golay.nearest(v), golay.within_four(v)
    for i, x in enumerate(v.tolist()):
        assert bin(x ^ code[int(near[i])]).count("1") <= 3
        assert set(around[row == i].tolist()) == {m for m, c in code.items() if bin(x ^ c).count("1") <= 4}
        for bit in range(23):
            assert int(golay.nearest(np.array([x ^ 1 << bit]))[0]) in set(around[row == i].tolist())


def plain_fingerprint(text, n=4):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, corpus, monkeypatch):
    texts = [d["text"] for d in corpus] + ["", None, "one", "Two WORDS", "a b c d", "É Ä a b", "x\x0by\x1cz q", "w " * 3000]
    want = [plain_fingerprint(t) for t in texts]
    got = simhash.fingerprints_of([None if t is None else t.encode() for t in texts], 4, 42)
    assert [int(x) & (1 << 64) - 1 for x in got] == want
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert (simhash.fingerprints_of([None if t is None else t.encode() for t in texts], 4, 42) == got).all()
    native = spark.createDataFrame([(t,) for t in ("alpha beta gamma delta", "é")], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] & (1 << 64) - 1 for r in native] == [plain_fingerprint(t) for t in ("alpha beta gamma delta", "é")]


def test_key_join_loses_no_link(spark):
    """All ways to differ in four bits or fewer over the three segments; crowded keys too."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5):
            for _ in range(12):
                x = b
                for bit in rng.sample(range(64), k):
                    x ^= 1 << bit
                prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    points = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {tuple(sorted((x, y))) for x, y in combinations(signed, 2) if bin((x ^ y) & (1 << 64) - 1).count("1") <= 4}
    shelf = Shelf(spark)
    for crowd in (10**6, 3, 0):  # by the short keys, by both, by the longer ones
        assert {(r["a"], r["b"]) for r in simhash.links(points, shelf, crowd=crowd, dense=10**6).collect()} == want
    by = reachable(signed, want)
    for crowd, dense in ((0, 0), (3, 3), (0, 5)):
        edges = simhash.links(points, shelf, crowd=crowd, dense=dense)
        found = {r["node"]: r["component"] for r in components(edges, shelf).collect()}
        assert {n: found.get(n, n) for n in by} == by


def test_keys_grow_where_they_are_crowded(spark):
    """With one segment shared by thousands of unlike fingerprints no candidates come of it."""
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 42, 6000) << 22 | 12345)
    shelf = Shelf(spark)
    points = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    keys = points.mapInArrow(simhash._keys, "key long, left boolean, fp long")
    longer = keys.where("key = 12345").select("key", "left", "fp").mapInArrow(simhash._longer, "key long, more long, left boolean, fp long")
    most = longer.groupBy("key", "more").count().agg(F.max("count")).first()[0]
    near = sum(int((np.bitwise_count((x ^ fp).view(np.uint64)) <= 4).sum()) - 1 for x in fp) // 2
    assert most < 60 and simhash.links(points, shelf).count() == near


def test_simhash_rows(spark, corpus):
    rows = [(d["doc_id"], d["text"], d["source"]) for d in corpus]
    rows += [(-5, rows[3][1], "s"), (5000, rows[3][1], "s"), (-6, None, None), (6000, "", "s"), (6000, "", "s"), (6001, " \n", "s"), (None, rows[3][1], "s"), (None, "alone here", "s"), (None, "alone here", "s")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t, _ in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    links = [(p, q) for p, q in combinations(prints, 2) if bin(p ^ q).count("1") <= 4]
    root, want = reachable(prints, links), {}
    for p, ids in prints.items():
        want.setdefault(root[p], []).extend(i for i in ids if i is not None)
    for r in got:
        p = r["fp"] & (1 << 64) - 1
        assert r["doc_id"] in prints[p] and r["component_id"] == min(want[root[p]], default=None)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r[0] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(min(w) for w in want.values() if w) and ids.count(None) == sum(not w for w in want.values()) == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    """Texts under one id are documents of their own; so are those without an id."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "the quick brown fox jumps over it", "one two three four five six seven")
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (None, c), (None, c), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, c), (1, a), (1, b)]


def vector_rows():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((230, 16))
    v[100:140] = v[0] + 0.15 * rng.standard_normal((40, 16))  # one crowd
    v[140:150] = v[1]  # copies
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return [*rows, (500, None), (501, [0.0] * 16), (502, [1.0, None] + [0.0] * 14), (503, [float("nan")] * 16), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (None, rows[5][1]), (7, rows[7][1])]


def usable(rows):
    return [(i, np.array(v + [0.0] * (16 - len(v)))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def plain_links(rows):
    """(vec_id, n_links, component_id, kept) of each row."""
    good = [(n, np.array(v + [0.0] * (16 - len(v)))) for n, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in good]).reshape(len(good), -1)
    near = m @ m.T >= 0.95
    own = [n for n, _ in good]
    root = reachable(set(own), [(own[i], own[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    name = {}
    for n in own:
        name[root[n]] = min((x for x in (name.get(root[n]), rows[n][0]) if x is not None), default=None)
    out = []
    for n, (i, _) in enumerate(rows):
        links, component = (int(near[own.index(n)].sum()) - 1, name[root[n]]) if n in root else (0, i)
        out.append((i, links, component, i is not None and i == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, 40])
def test_embeddings(spark, block):
    rows = vector_rows()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = embed_dedup.near_duplicates(df, block_rows=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == plain_links(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_id_and_of_none(spark):
    """Unlike vectors under one vec_id each have their own links; rows without an id count, and join what they link."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v, i: [x + (0.05 + 0.01 * i) * (n == i % 3) for n, x in enumerate(v)]
    rows = [(5, a), (5, b), (2, near(a, 1)), (3, near(b, 2)), (9, near(b, 3)), (None, c), (None, near(c, 1)), (None, near(a, 4)), (1, None)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    assert found == plain_links(rows)
    assert [x[1:3] for x in found if x[0] == 5] == [(2, 2), (2, 3)]


def test_embeddings_keep_unusable_rows_of_a_usable_id(spark):
    rows = [(1, [1.0, 0.0]), (1, None), (1, [0.0, 0.0]), (1, [None, 1.0]), (2, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 1, 1, False), *[(1, 0, 1, True)] * 3, (1, 1, 1, True), (2, 0, 2, True)]


def test_tiles_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((60, 32)), rng.standard_normal((1, 32)) + 0.05 * rng.standard_normal((60, 32))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rotate = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    for tile, dense in ((1024, 0.0), (1024, 2.0), (17, 0.02)):
        monkeypatch.setattr(embed_dedup, "TILE", tile)
        monkeypatch.setattr(embed_dedup, "DENSE", dense)
        links, label = embed_dedup.Pairs(rotate, 0.95).compare(v, np.ones(120, dtype=np.int64), None, None)
        assert (links == want).all() and len(set(label[60:])) == 1


def test_chi_square():
    assert ann.chi_square(2 * np.log(2), 2) == pytest.approx(0.5)
    assert ann.chi_square(ann.stop_ratio(8, 0.95), 8) == pytest.approx(0.95) and ann.stop_ratio(8, 0.95) == pytest.approx(15.507, abs=1e-3)


@pytest.mark.parametrize(("piece", "ask"), [(8192, 512), (30, 2)])
def test_nearest(spark, piece, ask):
    rows = vector_rows()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), k=5, piece_rows=piece, ask_rows=ask).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: v for i, v in usable(rows)}
    hit = total = 0
    for q, v in good.items():
        if q % 10:
            continue
        own = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good.items() if i != q)
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 6)) and all(s == pytest.approx(np.linalg.norm(good[i] - v)) for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in own[:5]})
        total += 5
    assert hit / total >= 0.9 and set(got) == {i for i in good if i % 10 == 0}
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0"), k=5).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [2, 11])
def test_nearest_of_repeated_equal_vectors(spark, times):
    """Repeated rows of one vec_id take no place from the other vec_ids of equal vectors."""
    rng = np.random.default_rng(8)
    alike = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, alike) for i in range(20)] + [(100 + i, [float(x) for x in rng.standard_normal(8)]) for i in range(30)]
    df = spark.createDataFrame(rows * times, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 7, 19)"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(own) for q, own in got.items()} == {q: [(n, i, 0.0) for n, i in enumerate([i for i in range(20) if i != q][:10], 1)] for q in (0, 7, 19)}


def test_extreme_norms(spark):
    """Any finite vector is compared: squares that overflow or vanish decide nothing."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 6))
    v[20:] = v[:20] * (1 + 1e-3 * rng.standard_normal((20, 6)))
    power = [-300, -200, -160, -30, 0, 30, 160, 200, 300, 307]
    rows = [(i, [float(x) for x in r * 10.0 ** power[i % 10] * 0.1]) for i, r in enumerate(v)] + [(900, [1e-320, 0.0, 0, 0, 0, 0]), (901, [1e308, 0.0, 0, 0, 0, 0])]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in rows], "vec_id long, embedding array<double>")
    unit = np.array([embed_dedup.unit(np.array([r]))[0] for _, r in rows])
    links = [(rows[i][0], rows[j][0]) for i, j in combinations(range(len(rows)), 2) if unit[i] @ unit[j] >= 0.95]
    want = reachable([i for i, _ in rows], links)
    got = embed_dedup.near_duplicates(df, block_rows=9).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert sum(r["n_links"] for r in got) == 2 * len(links) and want[901] == 900
    from math import hypot

    found = {}
    for r in ann.nearest(df, df, k=3, piece_rows=8).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = {}
    for i, x in rows:
        gaps = [hypot(*(a - b for a, b in zip(x, y, strict=True))) for _, y in rows]
        exact[i] = sorted((g, j) for g, (j, _) in zip(gaps, rows, strict=True) if j != i)[:3]
    assert set(found) == set(exact)
    assert all(s == pytest.approx(e, rel=1e-12) for i in exact for (_, _, s), (e, _) in zip(sorted(found[i]), exact[i], strict=True))


def test_nearest_of_repeated_ids_and_many_ties(spark):
    """An id with two vectors has two lists; equal queries share a search; ties go to the smaller id over all pieces."""
    spot, other = [0.0, 1.0, 0.0, 0.0], [3.0, 4.0, 0.0, 1.0]
    rows = [(0, spot), (0, other), (0, other)] + [(i, spot) for i in range(1, 40)] + [(100 + i, [0.0, 1.0, 1.0 if i % 2 else -1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for piece, ask in ((8192, 512), (7, 3)):
        got = {}
        for r in ann.nearest(df, df.where("vec_id < 100"), k=10, piece_rows=piece, ask_rows=ask).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        near = [(n, i, 0.0) for n, i in enumerate(range(1, 11), 1)]
        assert len(got[0]) == 20 and set(near) < set(got[0])
        assert all(sorted(got[q]) == [(n, i, 0.0) for n, i in enumerate([i for i in range(40) if i != q][:10], 1)] for q in range(1, 40))


def test_pipeline(spark, folder):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    have = {r["doc_id"]: r for r in docs.collect()}
    shelf, seen = Shelf(spark), []
    for _, stage in cp.STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, folder))
        assert docs.columns == list(cp.COLUMNS)
        seen.append(docs.collect())
    clean, single, safe, mixed = seen
    assert 0.7 * len(have) <= len(clean) <= len(have) and all(r == have[r["doc_id"]] for r in clean)
    prints = [(plain_fingerprint(r["text"]), r["doc_id"]) for r in clean]
    links = [(i, j) for (p, i), (q, j) in combinations(prints, 2) if bin(p ^ q).count("1") <= 4]
    assert sorted(r["doc_id"] for r in single) == sorted(set(reachable([i for _, i in prints], links).values()))
    assert sorted(r["doc_id"] for r in safe) == sorted(r["doc_id"] for r in single)
    from taxolark.llm import secrets

    assert not any(secrets.base_spans(r["text"]) for r in safe) and all(r["n_chars"] == len(r["text"]) for r in safe)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in safe} and len(mixed) > len(safe)
    out = cp.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in mixed) and all(r["n_tokens"] == len(r["ids"]) for r in out)
