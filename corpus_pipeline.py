"""Corpus cleaning as stages over a documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read back as the next one's ``docs``. All but the last return the columns of ``docs``. Null and empty texts are clean documents of no words, of which near-dedup keeps one; empty tables pass through.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidespine.llm import bpe, decontam, near_copies, secrets, toxicity
from tidespine.llm.common import stored
from tidespine.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; trained on all labels of the table ``labels``."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="__toxicity").where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of texts whose five-word shingles are similar by 0.8 or more."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars counted anew; a text without secrets stays as it is."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(docs)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text decoded from them."""
    got = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("encode", encode)]

#: Training and fingerprints cannot be said in SQL; tests/llm hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table; each stage before it is written as Parquet and read back, so a lost executor costs a stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
