"""Benchmark decontamination by suffix arrays over the training text.

Each slice of documents is a shard with its own suffix array, to the depth of a window; every test suffix that can start a
window is binary-searched in every shard, which gives all its verbatim occurrences. Neighbouring occurrences join to the
longest matches. No shuffle: a shard needs its own documents and the test text only.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidespine.llm.common import ship, slices, words_of


class TestSuffixes:
    """The windows of a block of test items: ``window`` consecutive words, or the whole of a shorter item."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.names: list[int | None] = []  # item id of each row
        for row, (item, words) in enumerate(items):
            self.names.append(item)
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for at in range(max(min(1, len(codes)), len(codes) - window + 1)):
                found.setdefault(tuple(codes[at:at + window]), []).append((row, at))
        # the rows and places of each window, one window after the other
        self.rows, self.places = (np.array([p[k] for where in found.values() for p in where], np.int64) for k in (0, 1))
        self.begin = np.cumsum([0, *(len(where) for where in found.values())])
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.bits = max(1, len(self.ids).bit_length())
        highest = (1 << self.bits) - 1
        self.low = self.keys([list(w) + [0] * (window - len(w)) for w in found])
        self.high = self.keys([list(w) + [highest] * (window - len(w)) for w in found])

    def keys(self, rows: list[list[int]]) -> np.ndarray:
        return self.pack(np.array(rows, np.int64).reshape(-1, self.window).T)

    def pack(self, columns: Iterable[np.ndarray]) -> np.ndarray:
        """One byte string per suffix that sorts as its words do: as many words to a 64-bit number as fit."""
        columns, fit = list(columns), 64 // self.bits
        numbers = []
        for at in range(0, self.window, fit):
            number = np.zeros(len(columns[0]), np.uint64)
            for c in columns[at:at + fit]:
                number = number << np.uint64(self.bits) | c.astype(np.uint64)
            numbers.append(number)
        return np.ascontiguousarray(np.stack(numbers, 1).astype(">u8")).view(f"S{8 * len(numbers)}").ravel()

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence in ``codes``, where 0 is any word no item has, or a document's end."""
        if not len(self.lengths) or len(codes) < self.shortest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        # a suffix with a foreign word among its first `shortest` words equals no window: it is left out of the array
        suffixes = np.flatnonzero(unknown[self.shortest:] == unknown[: len(unknown) - self.shortest])
        padded = np.concatenate([codes, np.zeros(self.window, codes.dtype)])
        keys = self.pack(padded[suffixes + k] for k in range(self.window))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lo, hi = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        windows = np.repeat(np.arange(len(n)), n)
        places = np.arange(len(windows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return suffixes[order[places]], windows

    def search(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[tuple[int | None, int, int, int]], list[int]]]:
        """For each text: word count, longest matches as (item, place in the item, first word, words), ids of the items with occurring windows."""
        each, get = [words_of(t) for t in texts], self.ids.get
        sizes = np.array([len(w) for w in each], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = np.zeros(int(sizes.sum()) + len(each), np.int32)
        for at, words in zip(starts.tolist(), each):
            codes[at:at + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        at, windows = self.occurrences(codes)
        # every occurrence with each item and place that its window stands for
        n = self.begin[windows + 1] - self.begin[windows]
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[windows], n)
        at, length = np.repeat(at, n), np.repeat(self.lengths[windows], n)
        row, place = self.rows[which], self.places[which]
        order = np.lexsort((at, at - place, row))
        at, length, row, place = at[order], length[order], row[order], place[order]
        # the next window of the same row, one word on in both: documents are parted by a foreign word, so none runs over their border
        fresh = np.ones(len(at), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at))[:len(first)] - 1
        of = np.searchsorted(starts, at[first], "right") - 1
        found: dict[int, list[tuple[int | None, int, int, int]]] = {}
        for d, r, p, a, b in zip(of.tolist(), row[first].tolist(), place[first].tolist(), at[first].tolist(), (at[last] + length[last]).tolist()):
            found.setdefault(d, []).append((self.names[r], p, a - int(starts[d]), b - a))
        for d in range(len(each)):
            mine = sorted(found.get(d, []), key=in_order)
            yield len(each[d]), mine, sorted({m[0] for m in mine if m[0] is not None})


def in_order(match: tuple[int | None, int, int, int]) -> tuple:
    """Order of matches: first word, longest first, then item (none last) and place."""
    item, place, first, words = match
    return first, -words, item is None, item or 0, place


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[TestSuffixes]:
    """The items in blocks of at most ``block_bytes`` of text (one item may be longer), one block on the driver at a time."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        held.append((item, words_of(text)))
        size += len(text or "")
        if size >= block_bytes:
            yield TestSuffixes(held, window)
            held, size = [], 0
    yield TestSuffixes(held, window)


#: Columns of a match: the item and the word of it where the match begins, the document's word where it begins, and its words.
MATCH = ("item", "place", "start", "length")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, block_bytes: int = 16 << 20, most_bytes: int = 1 << 30) -> DataFrame:
    """``docs`` with n_words, spans (longest verbatim matches of at least a window, as ``MATCH``) and items.

    Words are lower-cased A-Z runs as in ``common.WORD``. A window is ``window`` consecutive words of an item, or all of an item with fewer. A span is as long
    as document and item agree, so spans of different items, or places, may overlap; equal ones are told apart by item and place. They stand in the order of
    start, then longest first. ``items`` are the distinct ids of the items with a window in the document; an item without an id is searched for but
    not listed, and its spans have a null item. Null and empty texts have no words; empty tables give empty results or no matches; repeated rows are
    searched alike. ``keep`` names the columns that pass through (all by default); one named like a result is replaced by it.

    Test text is indexed and broadcast one block of bounded size after the other; each block is a further step of the same pass. All blocks together are
    broadcast data, so a benchmark of over ``most_bytes`` of text is refused.
    """
    ship(docs.sparkSession)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, over {most_bytes}: split it")
    results = ["n_words", "spans", "items"]
    kept = [f for f in docs.schema.fields if f.name in (docs.columns if keep is None else keep) and f.name not in results]
    span = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in MATCH]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.LongType()))]
    names = [f.name for f in kept]
    carried = names + [text] * (text not in names)
    out = docs.select(*carried, F.lit(0).cast("long").alias("n_words"), F.array().cast(span).alias("spans"), F.array().cast("array<long>").alias("items"))
    span_type = pa.list_(pa.struct([(c, pa.int64()) for c in MATCH]))

    def step(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                at = len(carried)
                n_words, spans, items = [], [], []
                for (n, s, i), s0, i0 in zip(broadcast.value.search(part.column(part.schema.get_field_index(text)).to_pylist()), part.column(at + 1).to_pylist(), part.column(at + 2).to_pylist()):
                    n_words.append(n)
                    both = sorted([*(tuple(x[c] for c in MATCH) for x in s0), *s], key=in_order) if s0 else s
                    spans.append([dict(zip(MATCH, m)) for m in both])
                    items.append(sorted({*i0, *i}))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(at)), pa.array(n_words, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.int64()))],
                                                 names=[*carried, *results])
        return run

    schema = T.StructType([docs.schema[n] for n in carried] + added)
    for block in test_blocks(benchmark, window, block_bytes):
        out = out.mapInArrow(step(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return out.select(*names, *results)


def hit_words(spans: Column) -> Column:
    """Words inside any span, for spans in order of start."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return find_matches(docs, benchmark, window).where(F.size("spans") == 0).select(*docs.columns)
