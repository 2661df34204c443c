import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tidespine.llm import token_counts
from tidespine.llm.queries import QUERIES
from tidespine.session import scratch_path

MODEL, WORDS = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [None, "", " ", "  two  spaces ", "plain words", "plain words", "</s> <unk> <|endoftext|>", "ünïcode 日本語 🙂 ▁x", "tab\tline\nend\x00", "long " * 30000, "a" * 20000]


def expected(path):
    if path == MODEL:
        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        return [len(encode(t or "")) for t in TEXTS]
    rules = tokenizers.Tokenizer.from_file(path)
    return [len(rules.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)


@pytest.mark.parametrize("path", [MODEL, WORDS])
@pytest.mark.parametrize("most", [token_counts.BROADCAST_DIGESTS, 0])
def test_counts_equal_the_library(spark, path, most, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", most)
    got = token_counts.count_tokens(frame(spark), scratch_path(spark, "counts"), path)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    assert [r.n_tokens for r in sorted(got.collect())] == expected(path)


def test_only_misses_are_encoded(spark, monkeypatch):
    cache, asked = scratch_path(spark, "counts"), []
    plain = token_counts.encode_missing
    monkeypatch.setattr(token_counts, "encode_missing", lambda texts, *a: asked.append(sorted(r.text for r in texts.collect())) or plain(texts, *a))
    token_counts.count_tokens(frame(spark, ["a", "b", "b", None]), cache, MODEL)
    token_counts.count_tokens(frame(spark, ["b", "", "c d", "c d"]), cache, MODEL)
    token_counts.count_tokens(frame(spark, ["a", "c d"]), cache, MODEL)  # all known
    token_counts.count_tokens(frame(spark, ["a"]), cache, WORDS)  # another tokenizer
    assert asked == [["", "a", "b"], ["c d"], ["a"]]
    rows = spark.read.schema(token_counts.CACHE).parquet(cache)
    assert rows.count() == rows.distinct().count() == 5


def test_a_stored_count_is_used(spark):
    cache = scratch_path(spark, "counts")
    token_counts.count_tokens(frame(spark, ["a"]), cache, MODEL)
    tokenizer = spark.read.schema(token_counts.CACHE).parquet(cache).first().tokenizer
    planted = spark.createDataFrame([("planted", tokenizer)], "text string, tokenizer string").select(token_counts.content_digest("text").alias("digest"), "tokenizer")
    planted.selectExpr("digest", "77L AS n_tokens", "tokenizer").write.mode("append").partitionBy("tokenizer").parquet(cache)
    planted.selectExpr("digest", "77L AS n_tokens", "tokenizer").write.mode("append").partitionBy("tokenizer").parquet(cache)  # twice
    got = token_counts.count_tokens(frame(spark, ["planted", "planted", "a"]), cache, MODEL)
    assert sorted(r.n_tokens for r in got.collect())[1:] == [77, 77]


def test_empty_table_and_clashing_names(spark):
    cache = scratch_path(spark, "counts")
    assert token_counts.count_tokens(frame(spark, []), cache, MODEL).collect() == []
    more = spark.createDataFrame([("x y", "d", 1)], "text string, digest string, __n int")
    assert token_counts.count_tokens(more, cache, MODEL).drop("n_tokens").collect() == more.collect()
    with pytest.raises(ValueError):
        token_counts.count_tokens(more.withColumnRenamed("digest", "__digest"), cache, MODEL)
    with pytest.raises(ValueError):
        token_counts.count_tokens(more, cache, "words.txt")


def test_query_over_the_whole_table(spark):
    got = QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()
    encode = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = [(d.doc_id, len((d.text or "").encode()), n := len(encode(d.text or "")), n > 4096) for d in docs]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert random.Random(0).choice(got).asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
