"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic examples against unlabelled text.

Features are the words of a text and their beginnings (a stem shows in every ending), present or not; those that are clearly more frequent in
confirmed toxic text than in unlabelled text are kept. A linear numpy classifier is trained on
bounded samples by the class-prior-corrected risk; scoring is one pass over whole texts.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidespine.llm.common import release, ship, slices, stored, words_of


@dataclass(frozen=True)
class Settings:
    """Bounds and constants of training. ``positives`` and ``unlabelled`` are the sizes aimed at; samples are drawn by hash and whole texts are used.
    ``prior`` is the share of toxic text; where it is None it is the toxic share of the labelled ids, which must then be a fair sample."""

    positives: int = 3000
    unlabelled: int = 6000
    buckets: int = 1 << 18
    prior: float | None = None
    least_z: float = 6.0
    stems: tuple[int, ...] = (3, 4, 5, 6, 7)
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4


class Buckets:
    """Hashed features of a text; a bounded cache of words spares the hashing of frequent ones."""

    def __init__(self, settings: Settings, place: dict[int, int] | None = None, limit: int = 150_000):
        self.settings, self.place, self.limit, self.known = settings, place, limit, {}

    def word(self, word: bytes) -> tuple[int, ...]:
        s = self.settings
        found = {crc32(word) % s.buckets}
        letters = word.decode("utf-8", "replace")
        found.update(crc32(b"^" + letters[:n].encode()) % s.buckets for n in s.stems if len(letters) >= n)
        if self.place is not None:
            found = {self.place[b] for b in found if b in self.place}
        if len(self.known) >= self.limit:
            self.known.clear()
        out = self.known[word] = tuple(found)
        return out

    def text(self, text: str | None) -> list[int]:
        known, out = self.known.get, set()
        for w in set(words_of(text)):
            f = known(w)
            out.update(self.word(w) if f is None else f)
        return list(out)


@dataclass
class Model:
    settings: Settings
    place: dict[int, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str | None], buckets: Buckets) -> np.ndarray:
        f = [self.bias + float(self.weights[buckets.text(t)].sum()) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(f, np.float64), -50, 50)))


def nnpu_fit(rows: list[list[int]], features: int, positive: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier with logistic loss under the non-negative risk
    ``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])``; where the second part is negative its gradient is turned round.
    ``rows`` are the features each example has."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.fromiter((f for r in rows for f in r), np.int64, len(of))
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    theta = np.zeros(features + 1)
    theta[-1] = math.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)

    def gradient(slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(which, slope[of], features), slope.sum())

    for step in range(1, s.steps + 1):
        f = np.bincount(of, theta[which], len(rows)) + theta[-1]
        up = 1 / (1 + np.exp(-f))
        negative = np.logaddexp(0, f[~positive]).mean() - prior * np.logaddexp(0, f[positive]).mean()
        of_negative = gradient(np.where(positive, -prior * up / n_p, up / n_u))
        g = -of_negative if negative < 0 else gradient(np.where(positive, prior * (up - 1) / n_p, 0)) + of_negative
        g[:-1] += s.decay * theta[:-1]
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        theta -= s.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])  # features are chosen as signs of toxic text; none may excuse another
    return theta[:-1], float(theta[-1])


def sampled(rows: DataFrame, id_col: str, aim: int) -> DataFrame:
    """About ``aim`` of the rows, by the hash of their ids; all if there are fewer."""
    n = rows.count()
    return rows if n <= aim else rows.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_col)), F.lit(1 << 30)) < int(aim / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, settings: Settings = Settings()) -> Model | None:
    """Fit on documents whose ids pass ``learn`` (a condition on doc_id): positives are those with a toxic label of 1, unlabelled text is a
    sample of all of them, labels unseen. None without any positive text. ``settings.prior``, or the toxic share of the labelled ids in its place,
    must lie between 0 and 1: where only confirmed examples are labelled, it has to be given.

    A label counts once an id, 1 before 0; null labels and ids are not labels. Texts that repeat in a sample count once. Nulls are empty texts.
    """
    ship(docs.sparkSession)
    if learn is not None:
        docs, labels = docs.where(learn), labels.where(learn)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n_toxic:
        return None
    prior = settings.prior if settings.prior is not None else n_toxic / n_known
    if not 0 < prior < 1:
        raise ValueError(f"the share of toxic text is {prior}: give Settings.prior between 0 and 1")
    toxic = sampled(known.where("toxic = 1").select("doc_id"), "doc_id", settings.positives)  # a bounded number of ids: broadcast
    positive = texts.join(F.broadcast(toxic), "doc_id", "left_semi").select("text", F.lit(True).alias("positive"))
    unlabelled = sampled(texts, "doc_id", settings.unlabelled).select("text", F.lit(False).alias("positive"))
    sample = stored(positive.union(unlabelled).dropDuplicates(["text", "positive"]), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        count, rows, buckets = np.zeros((2, settings.buckets), np.int64), [0, 0], Buckets(settings)
        for part in slices(batches):
            for text, pos in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                count[int(pos), buckets.text(text)] += 1
                rows[int(pos)] += 1
        some = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[1, some], rows[1])), pa.array(np.append(count[0, some], rows[0]))], names=["bucket", "p", "u"])

    counts = stored(sample.mapInArrow(counted, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "toxicity-counts")
    _, n_p, n_u = counts.where("bucket = -1").first()
    if not n_p or not n_u:
        return None
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    chosen = counts.where(F.expr("bucket >= 0 and p + u >= 5") & (z >= settings.least_z)).orderBy("bucket")  # as many as there are buckets at most
    place = {r.bucket: k for k, r in enumerate(chosen.select("bucket").collect())}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        buckets = Buckets(settings, place)
        for part in slices(batches):
            got = [sorted(buckets.text(t)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(got, pa.list_(pa.int32())), pa.array([crc32(t.encode()) for t in part.column(0).to_pylist()], pa.int64())], names=["positive", "f", "tie"])

    rows = sample.mapInArrow(coded, "positive boolean, f array<int>, tie long").orderBy("positive", "tie", "f").collect()  # bounded by the sample and the features
    weights, bias = nnpu_fit([r.f for r in rows], len(place), np.array([r.positive for r in rows]), prior, settings)
    return Model(settings, place, weights, bias)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (all by default) and ``name``, the likelihood of a toxic label in 0 to 1; 0 for every text without a model.

    Whole texts, null as empty; a row's score depends on its text alone. A column named like the result is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name in (docs.columns if keep is None else keep) and f.name != name]
    names = [f.name for f in kept]
    if model is None:
        return docs.select(*names, F.lit(0.0).alias(name))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = names + [text] * (text not in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        buckets = Buckets(m.settings, m.place)
        for part in slices(batches, text):
            got = m.scores(part.column(part.schema.get_field_index(text)).to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(got)], names=[*names, name])

    return docs.select(*carried).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))
