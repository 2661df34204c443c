import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests_llm_brute import brute_kept, brute_matches, brute_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    plain = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(rnd.choice(plain) for _ in range(n))
    items = [(i, line(rnd.choice([3, 12, 25]))) for i in range(8)]
    docs, labels = [], []
    for i in range(1500):
        text = line(rnd.randrange(30, 90))
        if i % 7 == 0:
            text += " vexqar vexqen " + line(3) + " vexqus"
        if i % 3:  # labels are a fair sample: the class prior is their toxic share
            labels.append((i, 1, int(i % 7 == 0)))
        if i % 50 == 3:
            text += " " + items[i % 8][1] + " " + line(5)
        if i % 60 == 4:
            text += " password = \"abcdef123456\" " + line(3)
        docs.append((i, text))
    docs += [(2000 + i, docs[i][1]) for i in range(40)] + [(3000 + i, docs[1][1] + " " + rnd.choice(plain)) for i in range(20)]
    docs += [(4000, None), (4001, ""), (4002, "  "), (None, line(40)), (12, docs[12][1])]
    for k in range(40):  # edited copies, most beyond the reach of a few fingerprint bits
        words = line(140).split()
        docs.append((5000 + 2 * k, " ".join(words)))
        for _ in range(rnd.choice([1, 2, 3])):
            words[rnd.randrange(len(words))] = "edit"
        docs.append((5001 + 2 * k, " ".join(words)))
    rows = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in docs]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def test_stages(spark, corpus, tmp_path):
    path, rows, items = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), [sorted(rows, key=str)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(sorted(map(tuple, docs.collect()), key=str))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    given, calm, single, clean, masked, coded = seen
    assert len(calm) < len(given) and set(calm) <= set(given)
    wrong = [r for r in given if ("vexq" in (r[1] or "")) == (r in set(calm))]
    assert len(wrong) <= 0.01 * len(given)
    kept = brute_kept([(r[0], r[1]) for r in calm])
    assert sorted((r[0] is None, r[0] or 0) for r in single) == sorted((k is None, k or 0) for k in kept)
    hits = {(d, n) for d, n, hit, _ in brute_matches([(r[0], r[1]) for r in single], items, 10) if hit}
    assert 0 < len(hits) and {r[0] for r in clean} == {r[0] for r in single} - {d for d, _ in hits}
    assert [r[0] for r in masked] == [r[0] for r in clean]
    changed = 0
    for a, b in zip(clean, masked):
        if a != b:
            changed += 1
            assert brute_secrets(a[1]) and "[secret]" in b[1] and b[4] == len(b[1])
        else:
            assert not brute_secrets(a[1])
    assert changed and {r[0] for r in coded} == {r[0] for r in masked}


def test_run_equals_stages_and_is_registered(spark, corpus):
    path, _, _ = corpus
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in got.collect()) == sorted((str(r.doc_id), r.ids_sha256) for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_numbered_queries_are_complete():
    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
