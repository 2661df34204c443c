import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from tidespine.llm import periodic
from tidespine.llm.queries import QUERIES


def brute_lyndon(a):
    """Longest Lyndon prefix of each suffix, by its definition: smaller than all its own suffixes."""
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(k for k in range(1, len(a) - i + 1) if is_lyndon(a[i:i + k])) for i in range(len(a))]


def brute_runs(words):
    """Every stretch with smallest period q that cannot grow, long enough, by start, then period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            if j > i and length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def repetitive(rnd, n, letters):
    out = []
    while len(out) < n:
        part = [rnd.choice(letters) for _ in range(rnd.randrange(1, 7))]
        out += (part * rnd.randrange(1, 9))[:rnd.randrange(1, 40)]
        if rnd.random() < 0.3:
            out += out[-rnd.randrange(1, len(out) + 1):] * rnd.randrange(1, 5)
    return out[:n]


def test_lyndon_array_is_that_of_the_definition():
    for n in range(1, 9):
        for a in itertools.product((0, 1, 2) if n < 8 else (0, 1), repeat=n):
            assert periodic.lyndon_array(list(a)) == brute_lyndon(a)
    rnd = random.Random(1)
    for _ in range(150):
        a = repetitive(rnd, rnd.randrange(1, 60), range(rnd.randrange(1, 5)))
        assert periodic.lyndon_array(a) == brute_lyndon(a)


def test_runs_against_brute_force():
    rnd = random.Random(2)
    for _ in range(1500):
        a = repetitive(rnd, rnd.randrange(1, 200), range(rnd.randrange(1, 6)))
        assert sorted(periodic.runs_of(a), key=lambda r: (r[0], r[2])) == brute_runs(a)


def test_stretches_lose_no_run_among_texts():
    rnd = random.Random(3)
    for _ in range(200):
        plain = [f"w{i}" for i in range(rnd.choice([3, 30, 300]))]
        texts = []
        for _ in range(rnd.randrange(1, 8)):
            words = []
            for _ in range(rnd.randrange(0, 6)):
                words += repetitive(rnd, rnd.randrange(1, 80), plain) if rnd.random() < 0.5 else [rnd.choice(plain) for _ in range(rnd.randrange(40))]
            texts.append(words)
        _, found = periodic.runs_by_text([" ".join(t).encode() for t in texts])
        assert found == [brute_runs(t) for t in texts]


def test_plain_prose_leaves_little():
    rnd = np.random.default_rng(4)
    words = rnd.zipf(1.3, 20000) % 5000
    assert sum(b - a for a, b, _ in periodic.stretches(words, np.array([20000]))) < 600


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "x y z\x1c x y z\x1c x y z\x1c x y z\x1c", "long\x0btale " * 30000]
    texts += [" ".join(repetitive(rnd, rnd.randrange(1, 200), "abcdé")) for _ in range(150)] + [" ".join(f"w{rnd.randrange(80)}" for _ in range(rnd.randrange(1, 400))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, texts[-1]), (10, texts[-1])]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    big = 7  # too long for the brute force
    assert sorted(tuple(r) for r in got.collect() if r.doc_id != big) == sorted(brute_row(*r) for r in rows if r[0] != big)
    a_long = got.where(f"doc_id = {big}").first()
    assert (a_long.n_runs, a_long.start, a_long.length, a_long.period) == (1, 0, 60000, 2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(empty).collect() == []


def test_query_over_the_whole_table(spark):
    got = QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 15000]
    ids = {d for d, _ in docs}
    assert sorted(tuple(r) for r in got if r.doc_id in ids) == sorted(brute_row(*d) for d in docs)
    assert any(r.n_runs for r in got)
