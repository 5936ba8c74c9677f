"""Conversation tries, vector codes and SentencePiece against brute force and the sentencepiece library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import clashing
from pyspark.sql import functions as F

from taxolark.llm import codes, pieces, queries, trie
from taxolark.llm.tables import Shelf


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- trie -------------------------------------------------------------------------------------------------------


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def plain_trie(told):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def spark_trie(spark, df):
    shelf = Shelf(spark)
    out = trie.trie(*trie.rebuilt(trie.numbered(df, shelf)), shelf)
    return sorted(((tuple(r) for r in out.collect())), key=lambda r: (r[0], r[1]))


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(-7, 40), 70_000, 70_003, 2**40]:  # some groups lack their first conversation
        if c in (10, 20):
            continue
        n = rng.choice([1, 2, 3, 5, 9, 12])
        text = rng.choice(["a", "é", ""])
        rows += [(c, rng.choice([None, 3, 5]) if rng.random() < 0.1 else t, rng.choice(["user", None]) if rng.random() < 0.2 else "user", rng.choice([text, text, "b", None])) for t in range(n)]
    rows += [(33, None, "zz", "x"), (33, None, "zz", "x"), (None, 1, "user", "lost"), rows[0], rows[0]]
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    assert spark_trie(spark, df) == plain_trie(plain_rebuilt(rows))


def test_trie_of_one_conversation_that_goes_over_all_parts(spark):
    """A third of all rows in one conversation, and many conversations that are alike."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(400)] + [(5 * c, t, "user", f"t{t}") for c in range(2, 102) for t in range(4)] + [(10**6 + 5 * c, t, "user", f"t{t % 7}") for c in range(3) for t in range(40 + c)]
    got = spark_trie(spark, spark.createDataFrame(rows, SCHEMA))
    want = plain_trie(plain_rebuilt(rows))
    assert got == want
    spread = trie.running(spark.createDataFrame([(1, i) for i in range(4000)], "k long, i long"), "k", [F.col("i")], {"s": F.col("i")}, Shelf(spark))
    assert {r["i"]: r["s"] for r in spread.collect()} == {i: i * (i + 1) // 2 for i in range(4000)}


def test_trie_of_a_ladder(spark):
    """Each conversation leaves the one before a turn later: the chains' tree is as high as there are conversations."""
    told = spark.createDataFrame([(c, d, sha(f"{'s' if d <= c else c}{d}"), 3) for c in range(1, 30) for d in range(1, c + 2)], "conv_id long, depth long, turn_hash string, bytes long")
    got = sorted((tuple(r) for r in trie.trie(told.select("conv_id").distinct(), told, Shelf(spark)).collect()), key=lambda r: (r[0], r[1]))
    plain = {c: [("", f"{'s' if d <= c else c}{d}".ljust(3)[:3]) for d in range(1, c + 2)] for c in range(1, 30)}
    assert [r[:6] for r in got] == [r[:6] for r in plain_trie(plain)]


def test_trie_of_nothing(spark):
    assert spark_trie(spark, spark.createDataFrame([], SCHEMA)) == []
    assert spark_trie(spark, spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []


def test_digests_run_over_many_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 16)
    ends = spark.range(-40, 200).select(F.lit(3).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("depth"), F.col("id").alias("member"))
    more = ends.where("member < -30").withColumn("depth", F.lit(2).cast("long"))
    got = {r["depth"]: r["ends_sha256"] for r in trie.digests(ends.unionAll(more).repartition(6)).collect()}
    assert got == {1: sha(",".join(map(str, range(-40, 200)))), 2: sha(",".join(map(str, range(-40, -30))))}


# --- codes -------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, [*v, *[0] * (w * parts - len(v))], lab) for i, v, lab in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    cut = lambda v, p: tuple(v[p * w : p * w + w])
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    total = defaultdict(int)
    for _, _, e, lab in out:
        total[lab] += e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((i, c, e, total[lab], digest) for i, c, e, lab in out), key=str)


def spark_codes(spark, df):
    coded, books = codes.compress(df, Shelf(spark))
    return sorted(((*tuple(r), books.sha256()) for r in coded.collect()), key=str), books


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("d", [32, 40, 5])
def test_codes(spark, d):
    rng = np.random.default_rng(d)
    some = lambda: np.float32(rng.normal(size=d) * rng.choice([0.01, 1, 300])).tolist()
    rows = [(int(i), some(), int(i % 3)) for i in rng.permutation(150)]
    rows += [(7, some(), 1), rows[5], rows[5], (900, rows[3][1], None), (901, [0.0] * d, None), (None, some(), 2)]
    rows += [(200, None, 1), (1, [None] + some()[1:], 1), (2, some()[:-1] + [float("inf")], 1), (3, [float("nan")] * d, 0), (902, some()[: d // 2], 0), (903, [], 0)]
    got, books = spark_codes(spark, clashing(spark.createDataFrame(rows, VECTORS)).repartition(4))
    assert got == plain_codes(rows)
    w = books.entries.shape[2]
    back = {r["code"]: r["embedding"] for r in codes.decode(spark.createDataFrame([(r[1],) for r in got] + [(None,)], "code string"), books, keep=("code",)).collect()}
    assert back[None] is None and all(len(v) == 16 * w for c, v in back.items() if c)
    assert back[got[0][1]][:w] == (books.entries[0][int(got[0][1][:2], 16)] / 256).tolist()


def test_codes_of_few_and_none(spark):
    rows = [(5, [0.5] * 16, 1), (6, [-0.5] * 16, 1)]
    assert spark_codes(spark, spark.createDataFrame(rows, VECTORS))[0] == plain_codes(rows)
    assert spark_codes(spark, spark.createDataFrame([(1, None, 1)], VECTORS))[0] == []
    with pytest.raises(Exception, match="too large"):
        spark_codes(spark, spark.createDataFrame([(1, [3e30] * 16, 1)], VECTORS))


def test_nearest_looks_at_the_annulus_ends(monkeypatch):
    """Entries of equal distance on both ends of the interval, many ties, and chunks of a few pairs."""
    monkeypatch.setattr(codes, "PAIRS", 7)
    rng = np.random.default_rng(1)
    for _ in range(60):
        entries = rng.integers(-3, 4, size=(rng.integers(1, 30), 2))
        parts = rng.integers(-4, 5, size=(50, 2))
        index, best = codes.nearest(parts, entries)
        gaps = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


# --- pieces ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


def odd_texts():
    rng = random.Random(1)
    letters = "abc  ethinr.,▁\n\té漢🙂<>/=-0123"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(600)]
    return ["", " ", "  ", " a", "a  b   c" + " " * 100 + "e", "\n\n x", "▁a ▁▁b", "<s> hi </s> <0x0A>", "日本語 漢字", "🙂 🙈x", "a" * 5000, " " * 3000, "ab" * 700 + "é" * 300, "\x00\x01 \x7f", "é　y", "﻿abc​", "the" * 100, "== ---" * 50, *made]


def test_pieces_equal_the_library(spark, model, library):
    texts = [*odd_texts(), None]
    df = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in pieces.encode(df, model, decoded=True).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        r = rows[i]
        assert r["ids"] == want and r["decoded"] == library.decode(want), t
        told = library.encode(t or "", return_type="proto")
        size = len((t or "").encode())
        assert list(zip(r["starts"], r["ends"], strict=True)) == [(0, 0), *((p.begin, p.end) for p in told.pieces), (size, size)], t
    packed = pieces.encode(df, model, packed=True).where("doc_id = 3").first()
    assert struct.unpack(f"<{len(rows[3]['ids'])}I", packed["ids"]) == tuple(rows[3]["ids"]) and len(packed["starts"]) == len(packed["ends"]) == len(packed["ids"])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame([(i, r["ids"]) for i, r in rows.items()] + [(-1, None)], "doc_id long, ids array<int>"), model).collect()}
    assert back == {i: r["decoded"] for i, r in rows.items()} | {-1: ""}
    assert pieces.encode(df.limit(0), model).collect() == []


def test_pieces_without_what_is_kept(model, library, monkeypatch):
    """Chunks are forgotten all the time, and long ones go through the heap."""
    monkeypatch.setattr(pieces, "KEPT", 10)
    monkeypatch.setattr(pieces, "LONG", 6)
    own = pieces.Pieces(model)
    for at in range(0, 600, 37):
        texts = odd_texts()[at : at + 37]
        ids, _, _, sizes = own.encode_batch(texts)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert own.encode_batch([])[0].tolist() == []


def test_decode_of_any_ids(model, library):
    own, rng = pieces.Pieces(model), random.Random(2)
    for _ in range(1500):
        ids = [rng.randrange(1, 32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_maps(rule):
    library = pytest.importorskip("sentencepiece").SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normalizer(library.serialized_normalizer_spec())
    for t in [*odd_texts(), "ＡＢＣ　ｶﾞ ① ﬁ ½ Å", "  ａ  ｂ  ", "é"]:
        text, source = library.normalize(t, with_offsets=True)
        mine, starts = own(t)
        assert (mine, [len(t.encode()[:b].decode()) for b in starts]) == (text, list(source)), t


def test_op13(spark, folder, model, library):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    want = {}
    for d in docs:
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        want[d["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(library.decode(ids)))
    got = queries.op13_pieces(spark, folder).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(docs)
