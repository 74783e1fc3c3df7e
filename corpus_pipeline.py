"""A corpus pipeline: documents in, token ids of clean documents out, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontam, secrets, sentencepiece_sa, simhash, toxicity
from evenkeel.llm.common import delete, durable, free, new_path, scratch, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay, with all their columns; null texts score as empty ones."""
    own = free(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, score_col=own).where(F.col(own) < toxicity.Settings().threshold).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, with the smallest id."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other names and numbers, go; without an id each text is a document."""
    key = free(docs, "__key")
    by_text = F.concat(F.lit("t"), F.xxhash64("text").cast("string"))
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), by_text))
    found = decontam.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(key)
    return without(keyed, found, key).drop(key)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark, and n_chars follows."""
    ledger = secrets.BlobLedger(spark, new_path(spark, "pipeline-ledger"))
    ledger.scan(docs.select("doc_id", "text"))
    return ledger.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return sentencepiece_sa.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: Training a chain, components and piece merges have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  When a stage is written, what it and the stage before it kept on disk is removed."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in last + made[:-1]:
            delete(spark, path)
        last = made[-1:]
    return docs
