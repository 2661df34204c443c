import random

import numpy as np
import pytest
from tests_llm_brute import brute_kept

import corpus_pipeline
from tidespine.llm import near_copies

SCHEMA = "doc_id long, text string"


def test_edited_copies_of_any_similarity(spark):
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    line = lambda n: [rnd.choice(plain) for _ in range(n)]
    common, texts = line(40), [None, "", " ", "one two", "One  two", "one two three", "a b c d e"]
    for _ in range(120):
        words = line(rnd.randrange(20, 150))
        if rnd.random() < 0.3:
            words = common + words
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(4)):
            words = list(words)
            for _ in range(rnd.randrange(1, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(plain)
            texts.append(" ".join(words))
    hot = line(300)
    texts += [" ".join(hot[:i] + ["edit"] + hot[i:]) for i in range(0, 300, 3)]
    cut = line(104)  # 100 shingles: 80 of them are just similar, 79 are not
    texts += [" ".join(cut), " ".join(cut[:84]), " ".join(cut[20:103])]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == brute_kept(rows)


def test_every_pair_at_the_border_is_found(spark):
    rnd, rows = random.Random(6), []
    for k in range(150):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        share = rnd.choice([160, 165, 170, 180])  # of 200 shingles
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:share + 4]))]
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 300, 2))


def test_a_passage_that_many_texts_share(spark):
    # a hot shingle: one line heads most texts, in groups of copies and alone
    rnd, rows = random.Random(8), []
    plain = [f"w{i}" for i in range(3000)]
    line = [rnd.choice(plain) for _ in range(12)]
    for k in range(200):
        words = line + [rnd.choice(plain) for _ in range(rnd.choice([10, 11, 12, 25, 60]))]
        for _ in range(rnd.choice([1, 1, 1, 2, 5])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rnd.randrange(len(words))] = rnd.choice(plain)
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)


def test_nulls_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (3, text), (3, text), (None, "alone"), (None, "alone"), (7, None), (5, ""), (6, " \n"), (None, None), (9, "one two")]
    schema = "doc_id long, text string, n int, u long, a long, root long, h long, unit long"
    got = near_copies.keep_one(spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], schema).repartition(3))
    assert got.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("3", text), ("5", ""), ("9", "one two"), ("None", "alone")]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copies.keep_one(empty).collect() == []
    with pytest.raises(ValueError):
        near_copies.keep_one(empty.withColumnRenamed("doc_id", "__row"), id_col="__row")


def test_sketches_never_rule_out_a_similar_pair(spark):
    rnd, rows = np.random.default_rng(9), []
    for _ in range(400):
        n = int(rnd.integers(1, 1500))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.uniform(0.6, 1)], rnd.integers(0, 1 << 63, int(rnd.integers(0, n // 4 + 1))).astype(np.uint64)]))
        rows.append(((len(a), near_copies.sketch(a).tolist()), (len(b), near_copies.sketch(b).tolist()), near_copies.similar(a, b) and len(b) > 0))
    one = "struct<n:int,s:array<long>>"
    df = spark.createDataFrame(rows, f"a {one}, b {one}, similar boolean")
    got = df.select("similar", near_copies.may_be_similar(df.a, df.b).alias("may")).collect()
    assert all(r.may for r in got if r.similar) and sum(r.similar for r in got) > 50
    assert sum(r.may for r in got if not r.similar) < 0.3 * sum(not r.similar for r in got)


def test_a_large_group_of_edited_copies_is_not_met_as_pairs(spark, monkeypatch):
    rnd, rows = random.Random(10), []
    plain = [f"w{i}" for i in range(3000)]
    line = [rnd.choice(plain) for _ in range(200)]
    for k in range(150):
        words = list(line)
        words[rnd.randrange(len(words))] = rnd.choice(plain)
        rows.append((k, " ".join(words)))
    for k in range(150, 200):  # pairs of copies that share a passage alone
        words = [rnd.choice(plain) for _ in range(40)] + line[:12]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[1:]))]
    met, named = [], []
    linked, trees = near_copies.linked, near_copies.simhash.near_components
    monkeypatch.setattr(near_copies, "linked", lambda pairs, *more: (met.append(pairs.count()), linked(pairs, *more))[1])
    monkeypatch.setattr(near_copies.simhash, "near_components", lambda *a, **k: (named.append(1), trees(*a, **k))[1])
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)
    assert named and max(met) <= len(rows)


def test_groups_are_ruled_out_only_where_all_their_sets_are(spark):
    rnd, rows = np.random.default_rng(11), []
    for _ in range(150):
        n = int(rnd.integers(1, 900))
        base = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        near = lambda p: np.unique(np.concatenate([base[rnd.random(len(base)) < p], rnd.integers(0, 1 << 63, int(rnd.integers(0, n // 20 + 1))).astype(np.uint64)]))  # noqa: E731,B023
        groups = []
        for p in (rnd.uniform(0.97, 1), rnd.uniform(0.7, 1)):
            sets = [t for t in (near(p) for _ in range(int(rnd.integers(1, 4)))) if len(t)] or [base]
            words = len(near_copies.sketch(sets[0]))
            sets = [t for t in sets if len(near_copies.sketch(t)) == words]
            s = np.array([near_copies.sketch(t) for t in sets])
            v = np.bitwise_and.reduce(s)
            k = None if len(sets) == 1 else (v | ~np.bitwise_or.reduce(s)).tolist()
            groups.append((sets, (min(map(len, sets)), max(map(len, sets)), v.tolist(), k)))
        rows.append((groups[0][1], groups[1][1], any(near_copies.similar(a, b) for a in groups[0][0] for b in groups[1][0])))
    one = "struct<least:int,most:int,s:array<long>,k:array<long>>"
    df = spark.createDataFrame(rows, f"a {one}, b {one}, similar boolean")
    got = df.select("similar", near_copies.groups_may_be_similar(df.a, df.b).alias("may")).collect()
    assert all(r.may for r in got if r.similar) and sum(r.similar for r in got) > 20
    assert not all(r.may for r in got)
