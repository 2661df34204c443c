import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import brute_components, brute_fingerprint, brute_longest, brute_matches
from tidespine.llm import components, decontam, simhash

DOCS = "doc_id long, text string"


def texts(seed=3, n=160):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeiouéßnrst") for _ in range(rnd.randrange(1, 7))) for _ in range(200)]
    out = [None, "", " \t ", "One two", "one TWO", "É x", "  a b\x1cc d\x0be f", "w " * 3000]
    while len(out) < n:
        t = [rnd.choice(words) for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            out.append(" ".join(t))
            t = list(t)
            t[rnd.randrange(len(t))] = rnd.choice(words)
    return out


def test_fingerprints_and_components(spark):
    all_texts = texts()
    rows = [(i, t) for i, t in enumerate(all_texts)] + [(5, "repeated id"), (None, "no id")]
    df = spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit("clash")).withColumn("n", F.lit(1))
    prints = simhash.fingerprints(df.repartition(3), ["doc_id", "n", "fingerprint"]).cache()
    want = {t: brute_fingerprint(t) for _, t in rows}
    comp = brute_components(set(want.values()))
    small = {}
    for i, t in rows:
        if i is not None:
            small[comp[want[t]]] = min(i, small.get(comp[want[t]], i))
    expected = sorted((i if i is not None else -1, f"{want[t]:016x}", small.get(comp[want[t]], -1)) for i, t in rows)
    for sizes in ({}, {"shard_size": 20, "sample_size": 60}, {"shard_size": 20, "sample_size": 60, "query_size": 5}):
        got = simhash.with_component(prints, "doc_id", **sizes).select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("f"), "component_id").collect()
        assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == expected
    assert len(small) < len(set(want.values())) - 5


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (None, "other words stand here now", "z"), (7, None, "n"), (8, "", "n")], DOCS + ", lang string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(got.collect(), key=str) == sorted([(1, "a b c d e", "y"), (None, "other words stand here now", "z"), (7, None, "n")], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_shard_links_connect_what_pairs_connect(clustered):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40 if clustered else 1500, dtype=np.uint64)
    points = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64))
                                      for _ in range(40 if clustered else 1)])
    points = np.unique(points)
    router = simhash.Router(points[::3], 3, len(points) // 6)
    shards = {}
    for shard, some, home in router.deal(points, 4):
        shards.setdefault(shard, []).append((some, home))
    links, homes = [], 0
    for parts in shards.values():
        some, home = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        homes += int(home.sum())
        linker = simhash.Linker(4, leaf=16)
        linker.among(some[home])
        linker.between(some[~home], some[home])
        links.append(linker.links())
    assert homes == len(points) and len(shards) >= 4
    links = np.concatenate(links)
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 64).all()
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    label = np.arange(len(points))
    while True:
        nxt = np.where(near, label, len(points)).min(1)
        if (nxt == label).all():
            break
        label = nxt
    at = {int(p): i for i, p in enumerate(points)}
    own = np.arange(len(points))
    pairs = np.array([(at[int(a)], at[int(b)]) for a, b in links])
    while True:
        before = own.copy()
        for side in (0, 1):
            np.minimum.at(own, pairs[:, side], own[pairs[:, 1 - side]])
        if (own == before).all():
            break
    assert (own == label).all()


def test_connected_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    loose = [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    rows = chain + star + loose + star[:5] + [(7, 7), (None, 3)]
    parent = {}

    def top(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in rows:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(rows, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((v, top(v)) for v in parent)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_matches_against_brute_force(spark, block_bytes):
    rnd = random.Random(9)
    words = ["aa", "bb", "cc", "dd", "éé", "x1", "The", "ñ"]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, line(rnd.choice([1, 2, 3, 5, 6, 9, 12]))) for i in range(12)] + [(3, "repeated id here"), (None, "aa aa bb"), (40, None), (41, "..!"), (42, "")]
    docs = [(i, line(rnd.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "Repeated, ID-here"), (102, "Repeated, ID-here"), (103, "aa " * 3000), (None, items[4][1])]
    for window in (4, 10):
        df = spark.createDataFrame(docs, DOCS).withColumn("spans", F.lit(1)).withColumn("lang", F.lit("x"))
        got = decontam.find_matches(df, spark.createDataFrame(items, "item_id long, text string"), window, block_bytes=block_bytes)
        assert got.columns == ["doc_id", "text", "lang", "n_words", "spans", "items"]
        rows = [(r.doc_id, r.n_words, len({i for s in r["spans"] for i in range(s.start, s.start + s.length)}), r["items"]) for r in got.collect()]
        assert sorted(rows, key=str) == sorted(brute_matches(docs, items, window), key=str)
        hits = got.select(decontam.hit_words(F.col("spans"))).collect()
        assert sorted(r[0] for r in hits) == sorted(r[2] for r in rows)
        for r in got.where("doc_id is null or doc_id <> 103").collect():
            found = [tuple(s) for s in r["spans"]]
            assert found == sorted(found, key=decontam.in_order)
            assert sorted(found, key=str) == sorted(((item, *m) for item, other in items for m in brute_longest(r.text, other, window)), key=str)


def test_matches_of_two_items_that_touch(spark):
    docs = spark.createDataFrame([(1, "x a1 a2 a3 a4 b1 b2 b3 y a2 a3 a4")], DOCS)
    items = spark.createDataFrame([(7, "a1 a2 a3 a4 zz"), (8, "b1 b2 b3"), (8, "yy a4 b1 b2")], "item_id long, text string")
    got = decontam.find_matches(docs, items, window=3).first()
    assert [tuple(s) for s in got.spans] == [(7, 0, 1, 4), (8, 1, 4, 3), (8, 0, 5, 3), (7, 1, 9, 3)] and got["items"] == [7, 8]


def test_a_benchmark_beyond_its_bound_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    with pytest.raises(ValueError):
        decontam.find_matches(docs, spark.createDataFrame([(1, "long " * 100)], "item_id long, text string"), most_bytes=100)


def test_decontaminate_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).count() == 2 and decontam.decontaminate(docs.limit(0), none).count() == 0
    assert [r.doc_id for r in decontam.decontaminate(docs, spark.createDataFrame([(1, "A B c")], "item_id long, text string")).collect()] == [2]
