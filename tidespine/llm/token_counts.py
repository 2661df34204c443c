"""Token counts by a digest cache: a text is encoded only where no stored count has its digest and the tokenizer's.

The cache is a Parquet folder of (tokenizer, digest, n_tokens), one partition for each tokenizer version, in a place that all executors share. A
count run joins the digests of the texts to it, encodes each missing text once, however often it occurs, and appends the new counts. A lost
executor costs a task; a job that fails before its commit appends nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidespine.llm.common import kept, ship, slices, stored

CACHE = "digest binary, n_tokens long, tokenizer string"
#: Missing digests sent to all tasks at most, 40 bytes each; beyond, texts and digests meet by a shuffle.
BROADCAST_DIGESTS = 200_000


def tokenizer_version(model: bytes, library: str) -> str:
    """Digest of what a count depends on beside the text: the vocabulary file and the library's version."""
    return hashlib.sha256(f"{library} {library_version(library)} plain\n".encode() + model).hexdigest()


def library_of(path: str) -> str:
    for ending, library in ((".json", "tokenizers"), (".model", "sentencepiece")):
        if path.endswith(ending):
            return library
    raise ValueError(f"{path}: a vocabulary file ends in .json or .model")


def counter(model: bytes, library: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts: no begin, end or added special tokens, no truncation or padding."""
    if library == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        encode = SentencePieceProcessor(model_proto=model).encode
        return lambda texts: [len(encode(t)) for t in texts]
    from tokenizers import Tokenizer

    rules = Tokenizer.from_str(model.decode())
    rules.no_truncation()
    rules.no_padding()
    return lambda texts: [len(rules.encode(t, add_special_tokens=False).ids) for t in texts]


def content_digest(text: Column) -> Column:
    """SHA-256 of a text's normalised form. Null is normalised to the empty text and nothing else is, as any other change could change a count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def cached_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, one row for each digest; an absent cache is empty."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        rows = spark.createDataFrame([], CACHE)
    # two runs at a time may have appended the same digest
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_missing(texts: DataFrame, model: bytes, library: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of ``texts`` (digest, text)."""
    ship(texts.sparkSession)
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(f"counter {tokenizer}", lambda: counter(held.value, library))
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(count(piece.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def fill_cache(docs: DataFrame, cache: str, vocabulary: str, text: str = "text") -> str:
    """Append the counts that ``cache`` lacks for the texts of ``docs``; returns the tokenizer version that they are kept under.

    Digests are looked up before any text moves. Each missing text is shuffled once at most: copies are merged before the shuffle.
    """
    spark, library = docs.sparkSession, library_of(vocabulary)
    with open(vocabulary, "rb") as f:  # a few MB, whatever the table's size
        model = f.read()
    tokenizer = tokenizer_version(model, library)
    texts = docs.select(content_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    missing = stored(texts.select("digest").distinct().join(cached_counts(spark, cache, tokenizer), "digest", "left_anti"), "missing-digests")
    n = missing.count()
    if n:
        if n <= BROADCAST_DIGESTS:
            fresh = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            fresh = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
        counts = encode_missing(fresh, model, library, tokenizer).withColumn("tokenizer", F.lit(tokenizer))
        counts.write.mode("append").partitionBy("tokenizer").parquet(cache)
    return tokenizer


def count_tokens(docs: DataFrame, cache: str, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with ``n_tokens`` (long), the tokens of each whole text as the vocabulary file's library counts them.

    Null and empty texts have 0 tokens. A text of any length is encoded whole, in a task that holds 16 MB of texts or one longer one. Rows alike, and
    rows that share a text, are all kept and counted alike; an empty table stays empty and leaves the cache as it is. A column named like the result
    is replaced; ``__digest`` must not be a column. A hot text is one digest: its rows meet one cached row, in a join that can be split.
    """
    if "__digest" in docs.columns:
        raise ValueError("a column is named __digest")
    tokenizer = fill_cache(docs, cache, vocabulary, text)
    # stored: a join splits a hot digest's rows only where nothing is aggregated between it and the shuffle
    known = stored(cached_counts(docs.sparkSession, cache, tokenizer).withColumnRenamed("digest", "__digest"), "known-counts")
    keep = [c for c in docs.columns if c != n_tokens]
    rows = docs.select(*keep, content_digest(F.col(text)).alias("__digest"))
    return rows.join(known, "__digest", "left").select(*(rows[c] for c in keep), known["n_tokens"].alias(n_tokens))
