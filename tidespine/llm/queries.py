"""The numbered queries: each applies one operator to a whole table and derives its digest columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidespine.llm import bpe, conversation, decontam, langid, licenses, periodic, secrets, sharding, simhash, token_counts, token_file, topk, toxicity
from tidespine.llm.common import stored
from tidespine.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query()
def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs, learn=~held_out)
    got = langid.identify(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.encode_decode(docs, vocabulary())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op3_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = licenses.scan(docs, licenses.inverse_frequencies(docs, licenses.vocabulary())).select("doc_id", "licences.*")
    at, base = F.col("places.at"), F.array_sort(F.array_distinct("places.label"))
    return got.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
                      F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("found.label"))), ",").alias("labels"),
                      F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"))


@query()
def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=1)
    return token_file.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("""
WITH v AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5""")
def op5_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query()
def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return got.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p : p + least(len(w), 10) - 1] AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, p, n, w[p : p + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM m) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)""")
def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    n_hit = decontam.hit_words(F.col("spans"))
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


@query()
def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    n = [F.size(F.filter("base", lambda s: s["kind"] == 0)), F.size(F.filter("base", lambda s: s["kind"] == 1)), F.size(F.filter("base", lambda s: s["kind"] == 2))]
    return got.select("doc_id", *[c.cast("long").alias(f"n_{k}") for c, k in zip(n, secrets.KINDS)], F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
                      secrets.written(F.col("spans")).alias("spans"))


@query()
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(simhash.fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "document-fingerprints")
    return simhash.with_component(prints, "doc_id").select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    got = toxicity.score(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    got = token_counts.count_tokens(docs, scratch_path(spark, "token-counts"), vocabulary("piece_bpe_32k.model"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query(r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM d),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN shown[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
ins(s, e, n, said) AS (VALUES (0, 0, 0, []::VARCHAR[]), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']),
  (2, 2, 0, []), (2, 3, 1, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 3, 0, []), (3, 2, 1, ['user:']), (3, 3, 2, ['user:', 'assistant:'])),
op(s, e, letter, cost, own, role, initial) AS (VALUES (0, 0, 'D', 3, 0, '', ''), (1, 1, 'D', 3, 0, '', ''), (2, 2, 'D', 3, 0, '', ''), (3, 3, 'D', 3, 0, '', ''), (0, 2, 'R', 2, 1, 'user', ''), (1, 2, 'R', 2, 1, 'user', ''), (2, 3, 'R', 2, 1, 'assistant', ''),
  (3, 2, 'R', 2, 1, 'user', ''), (0, 2, 'K', 0, 1, '', 'u'), (1, 2, 'K', 0, 1, '', 'u'), (2, 3, 'K', 0, 1, '', 'a'), (3, 2, 'K', 0, 1, '', 'u'), (0, 1, 'K', 0, 1, '', 's')),
way AS (SELECT ins.s, op.e, n, ins.said, letter, 2 * n + cost AS cost, own, op.role, initial FROM ins JOIN op ON ins.e = op.s),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, way.e, min({'cost': dp.best.cost + way.cost + CASE WHEN way.own = 1 AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': dp.best.audit || repeat('I', way.n) || way.letter,
    'said': list_concat(dp.best.said, list_concat(way.said, CASE WHEN way.own = 0 THEN []::VARCHAR[] ELSE [CASE way.letter WHEN 'K' THEN f.role ELSE way.role END || ':' || f.text] END))})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN way ON way.s = dp.s
  WHERE (way.own = 0 OR f.fault NOT IN ('blank', 'duplicate')) AND (way.letter <> 'K' OR f.role[1] = way.initial) GROUP BY 1, 2, 3),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
b AS (SELECT dp.conv_id, min({'cost': dp.best.cost + 2 * ins.n, 'audit': dp.best.audit || repeat('I', ins.n), 'said': list_concat(dp.best.said, ins.said)}) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.s = dp.s AND ins.e IN (0, 3) GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    messages, found = conversation.repair(conversation.damaged(rows))
    every = rows.select("conv_id").distinct()
    got = conversation.figures(every, found, conversation.digests(messages).withColumnRenamed("sha256", "repaired_sha256"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.find_runs(periodic.with_repetition(table(spark, sf_dir, "documents").select("doc_id", "text")))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = got.withColumn("best", periodic.greatest(F.col("runs")))
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                      F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
