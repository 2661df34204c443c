"""Batch text scoring: text to positive, negative and neutral shares, a net score and a label."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidespine.sources.sinks import unprocessed

SCORE_COLS = ["positive", "negative", "neutral", "net_sentiment", "label"]
CLASSES = ["positive", "negative", "neutral"]
# Default word lists of the dictionary scorer.
POSITIVE = ["beat", "gain", "good", "growth", "improve", "profit", "record", "strong", "up"]
NEGATIVE = ["bad", "cut", "decline", "down", "fall", "loss", "miss", "risk", "weak"]


def lexicon_scores(df: DataFrame, text: str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Default scorer in native expressions: shares of listed words among the words of the whole text."""
    words = words_in(F.col(text))
    hits = lambda ws: F.size(F.filter(F.col("_words"), lambda w: w.isin(list(ws))))
    n = F.greatest(F.size("_words"), F.lit(1))
    df = df.withColumn("_words", words).withColumns({"positive": hits(positive) / n, "negative": hits(negative) / n})
    return with_label(df.withColumn("neutral", 1.0 - F.col("positive") - F.col("negative")).drop("_words"))


def with_label(df: DataFrame) -> DataFrame:
    """Net score and the label of the largest share (positive, then negative, then neutral on ties)."""
    p, n, u = F.col("positive"), F.col("negative"), F.col("neutral")
    label = F.when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral")
    return df.withColumns({"net_sentiment": p - n, "label": label})


def words_in(text: Column) -> Column:
    """Words of the whole text in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)


def word_counts(words: Column) -> Column:
    """(word, _n) of each distinct word of an array: it is sorted once, and a word's count is the way to where the next one begins."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def counted(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return once(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(w, i).alias("word"), (F.coalesce(F.get(f, k + 1), F.size(w)) - i).alias("_n"))))

    return once(F.array_sort(words), lambda w: F.when(F.size(w) > 0, counted(w)).otherwise(F.array().cast("array<struct<word:string,_n:int>>")))


def train_text_model(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(word, positive, negative, neutral): log-likelihoods of a linear text model, fitted on rows labelled with one of the three classes.

    Add-one shares of the words of each class; the empty word holds the classes' log shares of the rows, so a class without rows keeps a small one. Counts combine
    before the shuffle and the model is a table, so neither corpus nor vocabulary passes through the driver. Rows without a label are left out.
    """
    known = rows.where(F.col(label).isin(*CLASSES)).select(F.col(label).alias("_c"), words_in(F.col(text)).alias("_w"))
    of = lambda c, n: F.sum(F.when(F.col("_c") == c, n).otherwise(0))
    counts = known.select("_c", F.explode("_w").alias("word")).groupBy("word").agg(*[of(c, 1).alias(c) for c in CLASSES])
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in CLASSES], F.count(F.lit(1)).alias("_v"))
    words = counts.join(F.broadcast(totals)).select("word", *[F.ln((F.col(c) + 1) / (F.col(f"_{c}") + F.col("_v"))).alias(c) for c in CLASSES])  # one row of totals
    size = F.count(F.lit(1)) + len(CLASSES)
    prior = known.agg(*[F.ln((F.coalesce(of(c, 1), F.lit(0)) + 1) / size).alias(c) for c in CLASSES])
    return words.unionByName(prior.withColumn("word", F.lit("")))


def linear_scores(df: DataFrame, keys: Sequence[str], text: str, model: DataFrame) -> DataFrame:
    """``df`` with the five score columns by a model of ``train_text_model``. ``keys`` identify a row.

    Words are counted inside their row, so that they are shuffled once, to meet the model in an equi-join, whatever the size of either; sums combine before
    their shuffle. Words that the model does not know say nothing; a text without known words gets the classes' shares.
    """
    counted = df.select(*keys, F.explode(F.concat(F.array(F.struct(F.lit("").alias("word"), F.lit(1).alias("_n"))), word_counts(words_in(F.col(text))))).alias("_w"))
    sums = counted.select(*keys, "_w.word", "_w._n").join(model, "word").groupBy(*keys).agg(*[F.sum(F.col("_n") * F.col(c)).alias(f"_{c}") for c in CLASSES])
    top = F.greatest(*[F.col(f"_{c}") for c in CLASSES])
    parts = {c: F.exp(F.col(f"_{c}") - top) for c in CLASSES}
    whole = parts["positive"] + parts["negative"] + parts["neutral"]
    scored = sums.select(*keys, *[(parts[c] / whole).alias(c) for c in CLASSES])
    return with_label(df.join(scored, list(keys), "left"))


def model_scores(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]],
                 batch: int = 32) -> DataFrame:
    """Scores from any Python model. ``load`` runs once per task and returns texts -> (p, n, u) rows.

    Arrow batches stream through ``mapInPandas``; the input keeps its partitions.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            rows = [r for i in range(0, len(texts), batch) for r in scorer(texts[i:i + batch])]
            yield pdf.assign(positive=[r[0] for r in rows], negative=[r[1] for r in rows], neutral=[r[2] for r in rows])

    return with_label(df.mapInPandas(run, ", ".join([*fields, "positive double", "negative double", "neutral double"])))


def score_new_days(articles: DataFrame, scored: DataFrame, text: str, scorer=lexicon_scores) -> DataFrame:
    """Score only the days without output."""
    return scorer(unprocessed(articles, scored), text)


def partition_day(df: DataFrame, on: str = "timestamp") -> DataFrame:
    """The most frequent day of a batch, which names its output partition; ties go to the earliest."""
    days = df.groupBy(F.to_date(on).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.min_by("date", F.struct(-F.col("n"), F.col("date"))).alias("date"))
