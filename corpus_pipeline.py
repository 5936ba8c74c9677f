"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

Every stage reads the columns of documents by exact name (the first of a name counts),
whatever others there are, and but for the last returns just these. Null, empty and
very long texts, null doc_ids and repeated rows are documents like any other; no
documents give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolark.llm import bpe, mixing, secrets, simhash, toxicity
from taxolark.llm.queries import vocabulary
from taxolark.llm.tables import Shelf, pick, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null or empty text stays unless the classifier rejects all such.

    It is fitted on the labels of the input corpus; without any, nothing is rejected.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS) if model.landmarks else pick(docs, *COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash, words and bits as in op2, one stays.

    Texts without words have one fingerprint and so are one group; of repeated rows one stays.
    """
    return simhash.keep_one(pick(docs, *COLUMNS), Shelf(spark))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; documents all stay, n_chars follows the text; null texts stay null."""
    found = secrets.scan(docs, secrets.train(secrets.sample_windows(docs)), keep=("doc_id", "lang", "source", "n_chars"), redact="[SECRET]")
    length = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; texts without words have no weight and follow their source's rate."""
    return mixing.mix(pick(docs, *COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; copies that follow each other are encoded once. Null and empty texts have none."""
    coded = bpe.encode(docs, vocabulary("word_bpe_49k.json"), keep=("doc_id", "lang", "source", "n_chars"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: The classifiers, the fingerprint links and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    shelf = Shelf(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
