"""Token-id files: Simple-8b words in blocks of whole documents, in ascending document order.

A file set is a Parquet folder with one row per block, so any store Spark writes to can hold it and a lost task is
simply written again. A block holds: ``part`` and ``block`` (its place), ``first`` (ids before it in its part),
``doc_ids`` and ``lens`` (its documents), ``n_words``, ``jumps`` (word offset of every 4096th id and its place) and ``data``:
64-bit little-endian words followed by the escaped values.

A word's top four bits are a selector: how many values of how many bits the lower 60 bits hold, the first value lowest.
Selector 0 stands for one value of more than 60 bits, the next one of the escape list; with the escapes apart from the words,
all words of one selector are decoded in one step.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidespine.llm.common import kept, ship, slices
from tidespine.llm.vocab import ChunkEncoder, read_definition

#: Fixed values of the coding: values in a word, by selector; 120 values of no bits are zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Least selector for a value of so many bits; 16: none.
NEED = np.searchsorted(BITS[1:], np.arange(66)).astype(np.uint8) + np.uint8(1)
MARK = 4096


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped values and jumps (pairs of word offset and place of the first value at or after each multiple of MARK)."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    need = NEED[np.frexp(values.astype(np.float64))[1]]  # a float rounds up beyond 53 bits: at worst one selector more
    room = int(COUNTS.max())
    padded = np.concatenate([need, np.zeros(room, np.uint8)])
    chosen = np.full(n, 15, np.uint8)
    top, width = padded, 1  # top[i]: largest need among the next `width` values
    for s in range(15, 0, -1):
        while width < COUNTS[s]:
            step = min(width, int(COUNTS[s]) - width)
            top = np.maximum(top[: len(top) - step], top[step:])
            width += step
        if s < 15:
            chosen = np.where(top[:n] <= s, np.uint8(s), chosen)
    chosen[need == 16] = 0
    steps, starts, at = COUNTS[chosen].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    sel = chosen[starts]
    words = sel.astype(np.uint64) << np.uint64(60)
    long = np.concatenate([values, np.zeros(room, np.uint64)])
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            at, w = starts[mine], words[mine]
            for k in range(COUNTS[s]):
                w |= long[at + k] << np.uint64(k * BITS[s])
            words[mine] = w
    marks = np.searchsorted(starts, np.arange(0, n, MARK))
    marks = marks[marks < len(starts)]
    return words, values[starts[sel == 0]], np.stack([marks, starts[marks]], 1).ravel()


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            w, mask = words[mine], (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
            for k in range(COUNTS[s]):
                out[starts[mine] + k] = (w >> np.uint64(k * BITS[s])) & mask
    out[starts[sel == 0]] = escapes
    return out[:n]


def unpack_range(words: np.ndarray, escapes: np.ndarray, jumps: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    """Values ``lo`` to ``hi`` of a block (0 <= lo < hi <= n), decoding only the words between the marks around them."""
    marks = np.asarray(jumps).reshape(-1, 2)
    a = int(np.searchsorted(marks[:, 1], lo, "right")) - 1
    b = int(np.searchsorted(marks[:, 1], hi))
    first, base = marks[a]
    last, end = marks[b] if b < len(marks) else (len(words), n)
    escaped = int(np.count_nonzero(words[:first] >> np.uint64(60) == 0))
    inside = int(np.count_nonzero(words[first:last] >> np.uint64(60) == 0))
    return unpack(words[first:last], escapes[escaped:escaped + inside], int(end - base))[lo - base:hi - base]


def _encoder(text: str) -> ChunkEncoder:
    """The library's BPE model behind the word cache, built once for a Python worker."""
    def build() -> ChunkEncoder:
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(text).model
        return ChunkEncoder(text, lambda word: [t.id for t in model.tokenize(word)])

    return kept(f"token file {hash(text)}", build)


BLOCK = "part int, block int, first long, doc_ids array<long>, lens array<long>, n_ids long, n_words long, jumps array<long>, data binary"


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int, block_ids: int = 1 << 18) -> None:
    """Encode ``docs`` (doc_id, text; other columns are not read) and write blocks in ascending doc_id order.

    Each document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. A null doc_id comes first; rows of one doc_id,
    repeated or not, follow the hash of their texts, and rows alike in both stand in any order, which no result shows. A block ends
    with the document that takes it to ``block_ids`` ids, so it holds whole documents of any length. An empty table gives no blocks.
    Rows are dealt into ranges of (doc_id, hash of text): a task holds one range, streamed in sorted order.
    """
    ship(docs.sparkSession)
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(vocabulary))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    names = [c.split()[0] for c in BLOCK.split(", ")]
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())),
                        ("n_ids", pa.int64()), ("n_words", pa.int64()), ("jumps", pa.list_(pa.int64())), ("data", pa.binary())])
    last = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), _encoder(definition.value)
        ids, lens, held, size, block, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            words, escapes, jumps = pack(np.concatenate(held))
            row = [part, block, first, ids, lens, size, len(words), jumps.tolist(), words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

        for piece in slices(batches):
            flat, at = encoder.encode(piece.column(1))
            for doc, a, b in zip(piece.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids.append(doc)
                lens.append(b - a + 1)
                held += flat[a:b], last
                size += lens[-1]
                if size >= block_ids:
                    yield close()
                    first, block = first + size, block + 1
                    ids, lens, held, size = [], [], [], 0
        if ids:
            yield close()

    ordered.mapInArrow(run, BLOCK).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids before it in the whole set), n_tokens, ids (binary, little-endian uint32).

    Starts come from one total per part (as many rows as parts, hence the broadcast) and the counts in the blocks; nothing is sorted.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(before), "part").select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "lens", "n_ids", "n_words", "data")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, lens, n_ids, n_words, data = (batch.column(k)[i].as_py() for k in range(6))
                raw = np.frombuffer(data, "<u8")
                flat = unpack(raw[:n_words], raw[n_words:], n_ids).astype("<u4")
                ends = np.cumsum(lens)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lens, pa.int64()), pa.array(lens, pa.int64()),
                                                  pa.array([flat[e - k:e].tobytes() for e, k in zip(ends.tolist(), lens)], pa.binary())], schema=out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
