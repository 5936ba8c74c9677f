"""The registered queries over whole tables against brute force written here, and against their SQL; the pipeline's stages."""

import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from conftest_llm import clashing
from test_links import plain_fingerprint, reachable
from test_texts import dice_by_force, plain_base

from taxolark.llm import license_scan, queries, toxicity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(folder, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def run(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    return df.columns, [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    columns, got = run(spark, folder, name)
    assert sorted(columns) == sorted(names)
    assert sorted(str([r[n] for n in names]) for r in got) == sorted(str(list(r)) for r in want.fetchall())


def test_op1(spark, folder, vocab):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(vocab)
    t.no_truncation()
    t.no_padding()
    _, got = run(spark, folder, "op1_bpe")
    docs = rows_of(folder, "documents")
    want = {}
    for d, e in zip(docs, t.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True):
        want[d["doc_id"]] = (len(e.ids), sha(" ".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(docs)


def test_op2(spark, folder):
    _, got = run(spark, folder, "op2_simhash")
    docs = rows_of(folder, "documents")
    fp = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    links = [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    root = reachable(fp, links)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", root[i]) for i, p in fp.items()} and len(got) == len(docs)


def test_op3(spark, folder):
    from html import unescape

    _, got = run(spark, folder, "op3_html")
    want = {}
    for p in rows_of(folder, "pages"):
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?p>|<br>|</?h1>", article)]
        text = "\n\n".join(b for b in parts if b)
        want[p["page_id"]] = (p["url"], text, len(text))
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == want


def test_op4(spark, folder):
    _, got = run(spark, folder, "op4_secrets")
    docs = {d["doc_id"]: d["text"] or "" for d in rows_of(folder, "documents")}
    assert len(got) == len(docs)
    for r in got:
        base = plain_base(docs[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex"))
        written = [f"{k}:{a}:{b}" for a, b, k in base]
        spans = r["spans"].split(",") if r["spans"] else []
        assert r["base_sha256"] == sha(",".join(written)) and [s for s in spans if not s.startswith("model")] == written
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(docs[r["doc_id"]]) for s in spans)


def vectors(folder):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in rows_of(folder, "embeddings")]
    return [i for i, _ in rows], np.array([v for _, v in rows])


def test_op5(spark, folder):
    _, got = run(spark, folder, "op5_ann")
    ids, v = vectors(folder)
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = all_ = 0
    for n, i in enumerate(ids):
        if i % 100:
            continue
        dist = np.sqrt(((v - v[n]) ** 2).sum(axis=1))
        best = sorted((float(d), j) for d, j in zip(dist, ids, strict=True) if j != i)[:10]
        own = sorted(lists.pop(i))
        assert [x for x, _, _ in own] == list(range(1, len(best) + 1)) and all(s == pytest.approx(dist[ids.index(j)], rel=1e-12) for _, j, s in own)
        assert [(s, j) for _, j, s in own] == sorted((s, j) for _, j, s in own)
        hit, all_ = hit + len({j for _, j, _ in own} & {j for _, j in best}), all_ + len(best)
    assert not lists and hit / all_ >= 0.9


def test_op6(spark, folder):
    """Every passage reported has the coefficient that is told; no short text with a template inside goes without."""
    _, got = run(spark, folder, "op6_licenses")
    docs = {d["doc_id"]: license_scan.normal_words(d["text"] or "") for d in rows_of(folder, "documents")}
    templates = [(n, license_scan.normal_words(t)) for n, t in license_scan.TEMPLATES]
    for r in got:
        words, best = docs[r["doc_id"]], 0.0
        passages = [p.split(":") for p in r["passages"].split(",")] if r["passages"] else []
        assert r["n_found"] == len(passages)
        for name, a, b in passages:
            own = words[int(a) : int(b)]
            dice = max(dice_by_force(own, t, 0.0) for n, t in templates if n == name)
            assert dice >= 0.8 - 1e-9
            best = max(best, dice)
        assert (r["dice"] or 0.0) <= best + 1e-6
        joined = " ".join(words)
        if any(f" {' '.join(t)} " in f" {joined} " for _, t in templates):
            assert passages


def test_op7_conversation_of_control_strings(spark, folder):
    _, got = run(spark, folder, "op7_chat")
    said = "</s>[INST] ok [/INST]"
    own = next(r for r in got if r["conv_id"] == -1)
    assert (own["n_turns"], own["turns_sha256"]) == (2, sha(f"user\n{said}\nassistant\n{said}\n"))
    assert (own["loss_chars"], own["loss_sha256"]) == (len(said), sha(said)) and own["formatted_chars"] > 2 * len(said)


def test_op8_targets(spark, folder):
    _, got = run(spark, folder, "op8_mixing")
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in rows_of(folder, "documents")}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in got) and len(got) == len(size)
    total = sum(size.values())
    assert sum({r["source_size"]: r["target"] for r in got}.values()) <= 1.5 * total * (1 + 1e-9)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 0.1 * total


def test_op9(spark, folder):
    _, got = run(spark, folder, "op9_embed_dedup")
    ids, v = vectors(folder)
    norm = np.linalg.norm(v, axis=1)
    near = v @ v.T / np.outer(norm, norm) >= 0.95
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    root = reachable(ids, links)
    count = dict(zip(ids, (near.sum(axis=1) - 1).tolist(), strict=True))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (count[i], root[i], root[i] == i) for i in ids} and len(got) == len(ids)


def test_op10(spark, folder):
    """Columns and folds; scores don't follow from labels of held-out rows, ids, languages or sources."""
    _, got = run(spark, folder, "op10_toxicity")
    docs = rows_of(folder, "documents")
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    by_text = {}
    for r in got:
        by_text.setdefault(next(d["text"] for d in docs if d["doc_id"] == r["doc_id"]), set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())
    # short texts by the kernel's definition
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    own = {c for w in model.landmarks for c in w}
    letters = lambda w: "^" + "".join(c if c in own else chr(0x4E00 + ord(c) % toxicity.CLASSES) for c in w)
    norm = {w: np.sqrt(toxicity.kernel("^" + w, "^" + w)) for w in model.landmarks}
    scores = {r["doc_id"]: r["score"] for r in got}
    for d in sorted(docs, key=lambda d: len(d["text"] or ""))[:8]:
        words = toxicity.words_of(d["text"] or "")
        total = np.zeros(len(norm))
        for w in filter(None, map(toxicity.form, words)):
            a = letters(w)
            total += np.array([toxicity.kernel(a, "^" + b) / norm[b] for b in model.landmarks]) ** toxicity.POWER / toxicity.kernel(a, a) ** (toxicity.POWER / 2)
        described = np.concatenate([total, toxicity.RATE * total / max(1, len(words))])
        margin = model.slope * (described @ model.weight + model.bias) + model.offset
        assert scores[d["doc_id"]] == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-3, abs=1e-5)


def test_stages_on_odd_documents(spark, folder):
    """Nulls, empty texts, repeated rows, clashing columns, no rows: stage by stage."""
    import corpus_pipeline as cp

    prose = "the quiet river runs along the old mill and turns the wheel all day"
    rows = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (None, "my password = hunter22222 ok then and more", "en", "a", 5), (None, None, None, None, None), (2, "", "en", "b", 0), (3, "word " * 5000, "fr", None, 25000), (4, "x" * 100_000, "de", "b", 100000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {"toxicity": 7, "near_copies": 5, "secrets": 7}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        assert name == "bpe" or out.columns == list(cp.COLUMNS)
        assert name not in kept or len(got) == kept[name], name
        if name == "secrets":
            assert sorted(str(r["text"])[:20] for r in got if r["doc_id"] is None) == ["None", "my [SECRET] ok then "]
        if name == "bpe":
            assert len(got) == 7 and all(r["n_tokens"] == len(r["ids"]) for r in got)
        assert stage(spark, docs.limit(0), folder).count() == 0
