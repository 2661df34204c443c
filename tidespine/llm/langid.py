"""Language identification by prediction by partial matching.

One tree of byte contexts up to ``order`` bytes long holds frozen counts per language. A byte costs what the longest seen context says,
or an escape and what the next shorter one says (method C: distinct successors against occurrences), down to 8 bits for a byte without
any context; a text's code length in a language is the exact sum over its bytes. Every context of the sample is kept. Costs of each context and byte are
worked out beforehand for all languages, so scoring is one look-up a byte, and one more for each escape, all positions side by side, over whole texts.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidespine.llm.common import ship, slices, stored

#: Symbols: 0 stands before a text's start, a byte is its value plus one. A context is a number of 9 bits a symbol, oldest first.
START, WIDTH = 0, 9
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_label``: documents aimed at for each label, drawn by hash, whole texts; the model's size follows from it. ``order``: longest context, 6 at most."""

    per_label: int = 1500
    order: int = 4


def symbols(texts: Iterable[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of symbols, ``order`` start marks before each and after the last, and where each text's marks begin."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) + order for r in raw], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(b"\x00" * order + r for r in raw) + b"\x00" * order, np.uint8).astype(np.int16) + 1
    for k in range(order):
        flat[begins + k] = START
    flat[len(flat) - order:] = START
    return flat, begins


class Places:
    """Finds the place of a number among sorted distinct ones: numbers are dealt to buckets by a product hash, about half a number each."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(63 - max(1, len(keys)).bit_length())
        bucket = self.bucket(keys)
        self.place = np.argsort(bucket, kind="stable").astype(np.int32)
        self.keys = keys[self.place]
        self.begin = np.zeros((1 << 64 - int(self.shift)) + 1, np.int32)
        np.cumsum(np.bincount(bucket, minlength=len(self.begin) - 1), out=self.begin[1:])

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        bucket, out = self.bucket(keys), np.full(len(keys), -1, np.int64)
        at, end, left = self.begin[bucket], self.begin[bucket + 1], np.arange(len(keys))
        while True:
            more = at < end
            at, end, left = at[more], end[more], left[more]
            if not len(left):
                return out
            same = self.keys[at] == keys[left]
            out[left[same]] = self.place[at[same]]
            at, end, left = at[~same] + 1, end[~same], left[~same]


class Model:
    """For each context length, costs of its contexts and next bytes and escapes of its contexts, in all languages.

    Counts come as (label, run, n): ``n`` times the bytes of ``run``, a context of ``order`` symbols and the next one, of ``WIDTH`` bits each.
    The tables hold four bytes for each context, next byte and label.
    """

    def __init__(self, labels: list[str], order: int, label: np.ndarray, run: np.ndarray, n: np.ndarray):
        self.labels, self.order = labels, order
        self.symbol_at: list[Places] = []
        self.context_at: list[Places] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        before = np.zeros(0, np.int64)
        for length in range(order + 1):
            of, inverse = np.unique(run & self.mask(length), return_inverse=True)
            pairs, where = np.unique(inverse * len(labels) + label, return_inverse=True)
            times = np.bincount(where, n, len(pairs))
            entry, whose = pairs // len(labels), pairs % len(labels)
            contexts, context = np.unique(of >> WIDTH, return_inverse=True)
            place = context[entry] * len(labels) + whose
            kinds = np.bincount(place, minlength=len(contexts) * len(labels))
            total = np.bincount(place, times, len(contexts) * len(labels)) + kinds
            escape = -np.log2(np.where(kinds > 0, kinds / np.maximum(total, 1), 1.0)).reshape(-1, len(labels))
            cost = escape[context] + (self.cost[-1][np.searchsorted(before, of & self.mask(length - 1))] if length else 8.0)
            cost[entry, whose] = -np.log2(times / total[place])
            before = of
            self.symbol_at.append(Places(of))
            self.context_at.append(Places(contexts))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))

    @staticmethod
    def mask(length: int) -> int:
        return (1 << WIDTH * (length + 1)) - 1

    def bits(self, texts: list[str | None], piece: int = 1 << 18) -> np.ndarray:
        """Code length of each text (rows) in each language."""
        flat, begins = symbols(texts, self.order)
        out = np.zeros((len(texts), len(self.labels)))
        end = len(flat) - self.order
        for at in range(0, end, piece):
            to = min(end, at + piece)
            first, last = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, to) - 1
            cuts = np.maximum(begins[first:last + 1], at) - at
            out[first:last + 1] += np.add.reduceat(self.costs(flat, at, to), cuts, axis=0, dtype=np.float64)
        return out

    def costs(self, flat: np.ndarray, at: int, to: int) -> np.ndarray:
        """What each symbol from ``at`` to ``to`` costs in each language; start marks are free."""
        run = np.zeros(to - at, np.int64)
        for back in range(self.order, -1, -1):
            run <<= WIDTH
            run[max(0, back - at):] |= flat[max(0, at - back):to - back]
        out = np.zeros((to - at, len(self.labels)), np.float32)
        left = np.flatnonzero(flat[at:to] != START)
        for length in range(self.order, -1, -1):
            keys = run[left] & self.mask(length)
            found = self.symbol_at[length].find(keys)
            hit = found >= 0
            out[left[hit]] += self.cost[length][found[hit]]
            left, keys = left[~hit], keys[~hit]
            context = self.context_at[length].find(keys >> WIDTH)
            out[left[context >= 0]] += self.escape[length][context[context >= 0]]
        out[left] += 8
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code, the first by name of equal ones, and its share among all with equal priors."""
        bits = self.bits(texts)
        best = bits.argmin(1) if len(bits) else np.zeros(0, np.int64)
        excess = bits - bits.min(1, keepdims=True) if len(bits) else bits
        return [self.labels[b] for b in best], 1 / np.exp2(-np.minimum(excess, 1000)).sum(1)


def train(docs: DataFrame, label: str = "lang", text: str = "text", id_col: str = "doc_id", learn: Column | None = None, settings: Settings = Settings()) -> Model | None:
    """Frozen counts from rows with a label, an id and a text that pass ``learn``; none without such rows.

    About ``per_label`` documents of each label are drawn by the hash of their ids (all if there are fewer), so the sample is bounded by the number
    of labels. Executors count; the driver gets the number of times that each run of bytes occurs in the sample, and no run is left out.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.select(F.col(label).cast("string").alias("label"), F.xxhash64(F.lit("langid"), id_col).alias("draw"), F.col(text).alias("text"))
    shares = rows.groupBy("label").agg((F.lit(settings.per_label) / F.count(F.lit(1)) * (1 << 30)).alias("share")).collect()
    if not shares:
        return None
    labels, order = sorted(r.label for r in shares), settings.order
    known = docs.sparkSession.createDataFrame([(r.label, labels.index(r.label), r.share) for r in shares], "label string, code int, share double")
    sample = rows.join(F.broadcast(known), "label").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share")).select("code", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            codes = part.column(0).to_numpy(zero_copy_only=False)
            texts = np.array(part.column(1).to_pylist(), dtype=object)
            for code in np.unique(codes).tolist():
                flat, _ = symbols(texts[codes == code], order)
                run = np.zeros(len(flat) - order, np.int64)
                for k in range(order + 1):
                    run = run << WIDTH | flat[k:len(flat) - order + k]
                runs, n = np.unique(run[run & (1 << WIDTH) - 1 != START], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), code, np.int32)), pa.array(runs), pa.array(n)], names=["code", "run", "n"])

    runs = sample.mapInArrow(count, "code int, run long, n long").groupBy("code", "run").agg(F.sum("n").alias("n"))
    code, run, n = (c.to_numpy() for c in stored(runs, "langid-counts").select("code", "run", "n").toArrow().columns)
    return Model(labels, order, code.astype(np.int64), run, n)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` (all by default), ``lang`` and ``score`` (0 to 1). Null texts, texts without a letter and every text without a model
    are ``und`` with score 0. One pass over whole texts; columns named like a result are replaced; repeated rows are scored alike."""
    kept = [f for f in docs.schema.fields if f.name in (docs.columns if keep is None else keep) and f.name not in (lang, score)]
    names = [f.name for f in kept]
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(score))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = names + [text] * (text not in names)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            has = part.column(part.num_columns - 1).to_pylist()
            best, share = shared.value.predict(part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array([b if h else UNKNOWN for b, h in zip(best, has)], pa.string()),
                                              pa.array(np.where(has, share, 0.0))], names=[*names, lang, score])

    return docs.select(*carried, letters).mapInArrow(run, T.StructType([*kept, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
