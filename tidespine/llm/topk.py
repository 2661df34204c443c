"""Exact top-k inner products by block-at-a-time pruning.

Candidates lie in blocks of one order; a block knows each component's greatest and least value. For a query the sum of its largest
possible terms bounds every score of the block. A task takes a range of blocks and a batch of queries: for each query it scores the blocks in order of their
bounds, through the block's own rows, until the next bound falls below its kth score.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidespine.llm.common import ship, stored

#: Bytes of query vectors that a task holds while it meets the ranges.
PART_BYTES = 16 << 20
VECTORS = "{0}_ids array<long>, {0}_width int, {0}_data binary"


def quantised(vectors: DataFrame, scale: int, id_col: str, vector: str) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors that have an id, components, and none that is null or not finite; rows alike in both are one."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("x")).distinct()


def in_batches(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows (id, x) of each partition, in the order they come, as batches of at most ``size`` vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs = [], []

        def close() -> pa.RecordBatch:
            width = max(1, *(len(x) for x in xs))
            data = np.zeros((len(xs), width), np.int64)  # a vector that ends early has zeros there
            for k, x in enumerate(xs):
                data[k, :len(x)] = x
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([data.tobytes()], pa.binary())],
                                              names=[f"{name}_ids", f"{name}_width", f"{name}_data"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                xs.append(x)
                if len(ids) == size:
                    yield close()
                    ids, xs = [], []
        if ids:
            yield close()

    return rows.select("id", "x").mapInArrow(run, VECTORS.format(name))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows of ``a`` with rows of ``b``; by floats where no sum can pass 2**53, as both are whole numbers there."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores, self.count = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Ties go to smaller ids."""
        n = self.count[i]
        ids, scores = np.concatenate([self.ids[i, :n], ids]), np.concatenate([self.scores[i, :n], scores])
        first = np.lexsort((ids, -scores))[:self.ids.shape[1]]
        n = self.count[i] = len(first)
        self.ids[i, :n], self.scores[i, :n] = ids[first], scores[first]


class Range:
    """A range of candidates with its blocks' greatest and least components."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int):
        self.ids, self.rows, self.block, starts = ids, rows, block, np.arange(0, len(rows), block)
        self.most, self.least = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)

    def improve(self, best: Best, q_ids: np.ndarray, q: np.ndarray) -> None:
        """Put into ``best`` the candidates of this range that belong there, a query's own id left out. Queries that are at the same block are scored together."""
        bounds = exact(np.maximum(q, 0), self.most) + exact(np.minimum(q, 0), self.least)  # summed term maxima
        order, going = np.argsort(-bounds, axis=1, kind="stable"), np.arange(len(q))
        for step in range(order.shape[1]):
            at = order[going, step]
            hopeful = (best.count[going] < best.ids.shape[1]) | (bounds[going, at] >= best.scores[going, -1])
            going, at = going[hopeful], at[hopeful]
            if not len(going):
                break
            by = np.argsort(at, kind="stable")
            for some in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                asking, lo = going[some], at[some[0]] * self.block
                scores, own = exact(q[asking], self.rows[lo:lo + self.block]), self.ids[lo:lo + self.block]
                fits = (scores >= best.scores[asking, -1:]) | (best.count[asking] < best.ids.shape[1])[:, None]
                fits &= own != q_ids[asking][:, None]
                for j in np.flatnonzero(fits.any(1)):
                    best.add(asking[j], own[fits[j]], scores[j, fits[j]])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", block: int = 256, range_size: int = 8192,
          batch: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates of the highest integer inner product for each query, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null, hold a null or non-finite component, or have no id take no part; rows alike in id and vector are one row;
    rows of one id and different vectors are queries of their own, and no row with a query's id is its candidate. Of vectors of unequal length the shorter has zeros.
    Fewer candidates than ``k`` are all returned; an empty table gives no rows. Scores must fit 64 bits. ``is_query`` is a condition on the column ``id``.

    Candidates are ordered by the signs of their leading components, so that a block's vectors lean the same way, and cut into ranges; each batch of queries meets each
    range once, in a row of bounded size. A task reads some ranges and some batches where they are stored and keeps k candidates a query; the last step ranks those. No
    batch or range is copied by a shuffle or broadcast.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, scale, id_col, vector), "vectors")
    lean = F.aggregate(F.slice("x", 1, 30), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x >= 0, 1).otherwise(0))
    ordered = rows.withColumn("lean", lean).repartitionByRange("lean", "id").sortWithinPartitions("lean", "id")
    ranges = stored(in_batches(ordered, "c", range_size).withColumn("range", F.monotonically_increasing_id()), "vector-ranges")
    queries = in_batches(rows.where(is_query).repartition(F.xxhash64("id")), "q", batch)
    queries = stored(queries.withColumn("q_batch", F.monotonically_increasing_id()), "vector-queries")
    n, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("q_data")), F.lit(0))).first()
    # a task holds the batches of one part while the ranges pass
    queries = queries.repartition(max(1, -(-size // PART_BYTES), min(n, spark.sparkContext.defaultParallelism)))
    # the stated query set against all rows, in blocks: every batch meets every range, a product that is asked for
    asked = ranges.join(queries.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, best = None, None, {}
        for part in batches:
            for r in range(part.num_rows):
                n_batch, n_range, q_width, c_width = (part.column(j)[r].as_py() for j in range(4))
                if n_range != at:
                    ids, data = (part.column(j)[r] for j in (4, 5))
                    at, held = n_range, Range(ids.values.to_numpy(zero_copy_only=False), np.frombuffer(data.as_py(), np.int64).reshape(-1, c_width), block)
                q = np.frombuffer(part.column(7)[r].as_py(), np.int64).reshape(-1, q_width)
                q = np.pad(q[:, :c_width], ((0, 0), (0, max(0, c_width - q_width))))  # where one side ends early it has zeros, which add nothing
                if n_batch not in best:
                    best[n_batch] = part.column(6)[r].values.to_numpy(zero_copy_only=False).copy(), Best(len(q), k)
                q_ids, found = best[n_batch]
                held.improve(found, q_ids, q)
        for n_batch, (q_ids, found) in best.items():
            there = np.arange(k) < found.count[:, None]
            rows = np.nonzero(there)[0]
            columns = [np.full(len(rows), n_batch), rows, q_ids[rows], found.ids[there], found.scores[there]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["q_batch", "q_row", "query_id", "vec_id", "score"])

    near = asked.select("q_batch", "range", "q_width", "c_width", "c_ids", "c_data", "q_ids", "q_data").mapInArrow(run, "q_batch long, q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_batch", "q_row").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
