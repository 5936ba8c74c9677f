"""The queries op1 to op13 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolark.llm import ann, bpe, chat, codes, embed_dedup, html_text, license_scan, mixing, pieces, secrets, simhash, toxicity, trie
from taxolark.llm.tables import Shelf, pick, read


def vocabulary(name: str) -> str:
    """Where this machine's installation keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), Shelf(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(secrets.sample_windows(docs)))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secrets.written(F.filter("spans", lambda s: s["kind"] != "model"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the passages found, and the licence of the best one."""
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    best = F.array_sort("found", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).otherwise(a["start"] - b["start"]))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.get(best, F.lit(0))["license"].alias("license"),
        F.get(best, F.lit(0))["dice"].alias("dice"),
        F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("passages"),
    )


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10, shelf=Shelf(spark))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = pick(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    own = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    told = chat.conversations(rows.unionAll(own)).withColumn("text", chat.formatted(F.col("segments")))
    back = told.withColumn("turns", chat.parse(F.col("text"))).withColumn("trained", chat.trained_text(F.col("segments")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"), Shelf(spark)).select("doc_id", "size", "source_size", "target", "taken")


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), Shelf(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark)
    every, turns = trie.rebuilt(trie.numbered(read(spark, sf_dir, "conversations"), shelf))
    return trie.trie(every, turns, shelf)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read(spark, sf_dir, "embeddings"), Shelf(spark))
    return coded.withColumn("codebooks_sha256", F.lit(books.sha256()))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the digest of the pieces' places: start and end bytes of each, packed like the ids, all starts first."""
    coded = pieces.encode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), decoded=True, packed=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )


_T = chat.Template()

_MOVES = ", ".join(f"'{a}>{b}'" for a, after in _T.turns.items() for b in after)
_LAST = ", ".join(f"'{r}'" for r in _T.last)

OP7_SQL = f"""
WITH own(conv_id, turn, role, text) AS (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM own
),
marked AS (
  SELECT *, regexp_replace(text, '(\\\\*){_T.pattern}', '\\\\\\1\\2', 'g') AS safe,
         row_number() OVER w - 1 AS place, lag(role, 1, '') OVER w || '>' || role NOT IN ({_MOVES}) AS bad
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
told AS (
  SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(_T.begin)} + length(role) + 1 + length(safe) + {len(_T.end) + 2})::BIGINT AS formatted_chars,
       coalesce(min(place) FILTER (bad), CASE WHEN arg_max(role, place) NOT IN ({_LAST}) THEN count(*) END) AS bad_turn
  FROM marked GROUP BY conv_id
)
SELECT *, bad_turn IS NULL AS valid FROM told
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS hash, row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS nth,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
summed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
),
bound AS (SELECT *, source_size * 2.0::DOUBLE AS bound, source_size * 2.0::DOUBLE / weight AS ratio FROM summed),
cut AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bound
),
share AS (SELECT source, source_size, least(bound, max(level) OVER () * weight) AS target FROM cut),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || hash || ':' || nth), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN share ON sized.source IS NOT DISTINCT FROM share.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM rated
"""

OP11_SQL = """
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, count(*) AS size, conv_id - conv_id % 5 AS base,
         -- the unsigned crc32 of the decimal id: after each byte, -1 stands for a shift by one bit
         xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM said GROUP BY conv_id
),
plan AS (SELECT c.*, least(c.h, coalesce(b.size, 0)) AS shift FROM convs c LEFT JOIN convs b ON c.base = b.conv_id),
rebuilt AS (
  SELECT s.conv_id, n - h + shift AS depth, said, bytes FROM said s JOIN plan p ON s.conv_id = p.conv_id WHERE n > h
  UNION ALL SELECT p.conv_id, n, said, bytes FROM plan p JOIN said s ON s.conv_id = p.base WHERE n <= h
),
prefix AS MATERIALIZED (
  SELECT conv_id, depth, bytes, md5(string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
),
node AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS own FROM prefix GROUP BY depth, k),
linked AS MATERIALIZED (
  SELECT n.*, p.k AS up, u.conv_id AS parent_conv_id
  FROM node n LEFT JOIN prefix p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN node u ON u.depth = p.depth AND u.k = p.k
),
fan AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN fan USING (depth, k)),
below AS (
  SELECT a.depth, a.k, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM counted c JOIN prefix a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY a.depth, a.k
),
whole AS (SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY conv_id),
ends AS (SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members FROM whole JOIN prefix USING (conv_id, depth) GROUP BY depth, k)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM counted JOIN below USING (depth, k) LEFT JOIN ends USING (depth, k)
"""


def _round(n: int) -> str:
    """The assignment to the codebooks of round n, and the codebooks after it."""
    return f"""
best{n} AS MATERIALIZED (
  SELECT row, p, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS best
  FROM cell JOIN book{n} USING (p) GROUP BY row, p
),
book{n + 1} AS MATERIALIZED (
  WITH spread AS (SELECT p, best % 64 AS e, unnest(range(len(v))) AS i, unnest(v) AS x FROM best{n}),
  mean AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS c FROM spread GROUP BY p, e, i),
  moved AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x FROM mean GROUP BY p, e)
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN moved m USING (p, e)
),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
width AS (SELECT max(len(v)) // 16 AS w FROM kept),
cell AS MATERIALIZED (SELECT row, p, v[p * w + 1 : p * w + w] AS v FROM kept, range(16) t(p), width),
first AS (SELECT vec_id, any_value(row) AS row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept GROUP BY vec_id ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (SELECT p, e, v AS x FROM first JOIN cell USING (row)),{_round(0)}{_round(1)}{_round(2).split("book3")[0].rstrip().rstrip(",")},
coded AS (SELECT row, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM best2 GROUP BY row),
entries AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), entries
"""

QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_html, op4_secrets, op5_ann, op6_licenses, op7_chat, op8_mixing, op9_embed_dedup, op10_toxicity, op11_trie, op12_codes, op13_pieces)}
ORACLE_SQL = {"op7_chat": OP7_SQL, "op8_mixing": OP8_SQL, "op11_trie": OP11_SQL, "op12_codes": OP12_SQL}
