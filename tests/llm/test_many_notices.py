from tidespine.llm import licenses


def test_all_notices_in_one_long_text(spark):
    notices = [n for *_, n in licenses.TEMPLATES]
    ordinary = " ".join(licenses.vocabulary()[::-1])
    texts = [" ".join(notices), ordinary + " . " + " x ".join(notices[::-1]) + " " + "plain prose of any form " * 500, "prose " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.found for r in licenses.scan(docs, licenses.inverse_frequencies(docs, licenses.vocabulary())).select("doc_id", "licences.found").collect()}
    for k in (0, 1):
        words = licenses.split_words(texts[k])
        for label, key, notice in licenses.TEMPLATES:
            n, m = licenses.split_words(notice), licenses.split_words(key)
            off = next(i for i in range(len(n)) if n[i:i + len(m)] == m)
            begins = next(i for i in range(len(words)) if words[i:i + len(n)] == n)
            assert any((f.at, f.label) == (begins + off, label) and f.share > 0.999 for f in got[k]), (k, label, notice)
    assert not got[2]
