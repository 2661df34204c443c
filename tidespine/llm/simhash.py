"""SimHash near-duplicates: exact links within a Hamming radius, found with vantage-point trees.

Distinct fingerprints are dealt to shards by a small vantage-point tree built from a bounded sample: at each node a
fingerprint goes by its distance to the node's vantage point. A pair that a node parts has both ends within the radius of the
border, so only the left end is also sent to the right side, as a query. Inside a shard the same tree goes on in numpy.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidespine.llm.common import ship, slices, stored
from tidespine.llm.components import connected_components

RADIUS = 4


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, highest bit first: a bit is set if it is in over half of the shingles' XXH64 values; all zero without words."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at space and \x09-\x0D only
    if not words:
        return bytes(8)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = [digest(line[a:b], seed) for a, b in zip(starts[at:min(n, at + (1 << 16))].tolist(), last[at:at + (1 << 16)].tolist())]
        counts += np.unpackbits(np.frombuffer(b"".join(some), np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Columns ``keep`` of ``docs`` and each text's fingerprint as a long (the 64 bits, signed). One pass, no shuffle."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name in keep and f.name != name]
    names = [f.name for f in kept]
    carried = names + [text] * (text not in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            got = b"".join(map(fingerprint, part.column(part.schema.get_field_index(text)).to_pylist()))
            bits = np.frombuffer(got, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(bits)], names=[*names, name])

    return docs.select(*carried).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def distance(points: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


class Router:
    """The top of the tree, over a sample of which each point stands for ``weight`` fingerprints; leaves hold about ``target`` of them."""

    def __init__(self, sample: np.ndarray, weight: float, target: int, tries: int = 8):
        self.nodes: list[tuple] = []  # (point, border, left, right); a shard has (None, shard)
        self.shards = 0
        self.grow(sample, weight, target, tries)

    def grow(self, sample: np.ndarray, weight: float, target: int, tries: int) -> int:
        at = len(self.nodes)
        self.nodes.append((None, self.shards))
        best = None
        if len(sample) * weight > target:
            for k in range(min(tries, len(sample))):  # the vantage point whose median parts the sample most evenly, then most widely
                d = distance(sample, sample[k * len(sample) // tries])
                border = int(np.median(d))
                left = int((d <= border).sum())
                score = abs(2 * left - len(sample)), -float(d.std())
                if 0 < left < len(sample) and (best is None or score < best[0]):
                    best = score, sample[k * len(sample) // tries], border, d
        if best is None:
            self.shards += 1
            return at
        _, point, border, d = best
        left = self.grow(sample[d <= border], weight, target, tries)
        right = self.grow(sample[d > border], weight, target, tries)
        self.nodes[at] = point, border, left, right
        return at

    def deal(self, points: np.ndarray, radius: int, node: int = 0, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, fingerprints, whether at home there): each is at home in one shard and a query where the radius reaches."""
        home = np.ones(len(points), bool) if home is None else home
        if not len(points):
            return
        if self.nodes[node][0] is None:
            yield self.nodes[node][1], points, home
            return
        point, border, left, right = self.nodes[node]
        d = distance(points, point)
        go = np.where(home, d <= border, d - radius <= border)
        yield from self.deal(points[go], radius, left, home[go])
        go = d + radius > border  # at home on the left: a query on the right
        yield from self.deal(points[go], radius, right, home[go] & (d[go] > border))


class Linker:
    """Links of one shard: a forest over its linked fingerprints, not every pair."""

    def __init__(self, radius: int, leaf: int = 256):
        self.radius, self.leaf = radius, leaf
        self.found: list[np.ndarray] = []

    def among(self, points: np.ndarray) -> None:
        split = self.split(points)
        if split is None:
            self.compare(points, points)
            return
        d, border = split
        left, right = d <= border, d > border
        self.among(points[left])
        self.among(points[right])
        self.between(points[left & (d + self.radius > border)], points[right & (d - self.radius <= border)])

    def between(self, queries: np.ndarray, points: np.ndarray) -> None:
        if not len(queries) or not len(points):
            return
        split = self.split(points)
        if split is None:
            self.compare(queries, points)
            return
        d, border = split
        dq = distance(queries, self.point)
        near, far = queries[dq - self.radius <= border], queries[dq + self.radius > border]
        left, right = points[d <= border], points[d > border]
        self.between(near, left)
        self.between(far, right)

    def split(self, points: np.ndarray) -> tuple[np.ndarray, int] | None:
        """Distances to a vantage point and the median as border; none if the points are few or all equally far."""
        if len(points) <= self.leaf:
            return None
        self.point = points[len(points) // 2]
        d = distance(points, self.point)
        border = int(np.median(d))
        if border == d.max():
            border -= 1
        return (d, border) if (d <= border).any() else None

    def compare(self, queries: np.ndarray, points: np.ndarray) -> None:
        for at in range(0, len(queries), 1024):
            for to in range(0, len(points), 1024):
                q, p = queries[at:at + 1024], points[to:to + 1024]
                near = np.bitwise_count(q[:, None] ^ p[None, :]) <= self.radius
                if near.any():
                    self.found.append(forest(q, p, near))

    def links(self) -> np.ndarray:
        pairs = np.concatenate(self.found) if self.found else np.zeros((0, 2), np.uint64)
        return pairs[pairs[:, 0] != pairs[:, 1]]


def forest(queries: np.ndarray, points: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Pairs that connect what ``near`` connects, at most one per fingerprint: labels spread until they stay."""
    none = len(points)
    label = np.arange(none)
    rows, cols = near.any(1), near.any(0)
    queries, near = queries[rows], near[rows]
    while True:
        of_query = np.where(near, label, none).min(1)
        spread = np.where(cols, np.where(near, of_query[:, None], none).min(0), label)
        if (spread == label).all():
            break
        label = spread
    moved = label != np.arange(none)
    return np.concatenate([np.stack([queries, points[of_query]], 1), np.stack([points[moved], points[label[moved]]], 1)])


def near_links(prints: DataFrame, name: str = "fingerprint", radius: int = RADIUS, shard_size: int = 1 << 15, sample_size: int = 1 << 13,
               query_size: int = 1 << 20) -> DataFrame:
    """(a, b): links between distinct values of ``prints[name]`` that connect exactly what pairs within ``radius`` bits connect.

    ``shard_size`` distinct fingerprints or fewer are one shard; more are dealt by a tree from about ``sample_size`` of them, the only
    fingerprints the driver sees. Every fingerprint is at home in one shard and none is capped: a shard with more than ``query_size`` queries is
    split, each part holding the shard's own fingerprints and a share of the queries, so a task's memory is bounded.
    """
    ship(prints.sparkSession)
    spark = prints.sparkSession
    distinct = stored(prints.select(F.col(name).alias("f")).where(F.col("f").isNotNull()).distinct(), "fingerprints")
    total = distinct.count()
    sample = np.zeros(0, np.uint64)
    if total > shard_size:
        part = int(min(1.0, sample_size / total) * 2**31)
        sample = np.array([r.f for r in distinct.where(F.pmod(F.xxhash64("f"), F.lit(2**31)) < part).sort("f").collect()], np.int64).view(np.uint64)
    router = spark.sparkContext.broadcast(Router(sample, total / max(1, len(sample)), shard_size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, some, home in router.value.deal(points, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, np.int32)), pa.array(some.view(np.int64)), pa.array(home)], names=["shard", "f", "home"])

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        linker = Linker(radius)
        here, home = shard["f"].to_numpy().view(np.uint64), shard["home"].to_numpy()
        points, queries = np.sort(here[home]), np.sort(here[~home])
        if shard["salt"].iloc[0] == 0:  # pairs at home are compared in one part only
            linker.among(points)
        linker.between(queries, points)
        return pd.DataFrame(linker.links().view(np.int64), columns=["a", "b"])

    dealt = stored(distinct.mapInArrow(deal, "shard int, f long, home boolean"), "dealt")
    parts = dealt.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("home")) / query_size)).alias("parts"))
    salt = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("f"), "parts")))
    return dealt.join(parts, "shard").withColumn("salt", F.explode(salt)).groupBy("shard", "salt").applyInPandas(link, "a long, b long")


def near_components(prints: DataFrame, name: str = "fingerprint", radius: int = RADIUS, **sizes: int) -> DataFrame:
    """(fingerprint, root) for the fingerprints that have a link; the others are alone."""
    links = near_links(prints, name, radius, **sizes)
    return connected_components(links).select(F.col("node").alias(name), "root")


def with_component(prints: DataFrame, id_col: str, radius: int = RADIUS, **sizes: int) -> DataFrame:
    """``prints`` (``id_col``, fingerprint, more) with component_id: the smallest id whose text is reachable over links.

    Equal fingerprints are linked, the zero fingerprint of texts without words like any other. Null ids are never the smallest; a component of nulls only has
    null. Repeated rows keep their places. Ids are reduced to one per fingerprint before anything is joined, so copies never meet as pairs.
    """
    roots = near_components(prints, radius=radius, **sizes)
    first = prints.groupBy("fingerprint").agg(F.min(id_col).alias("first_id")).join(roots, "fingerprint", "left")
    first = first.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first_id")
    smallest = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(first.join(smallest, "root").select("fingerprint", "component_id"), "fingerprint")


def hex_digits(bits):
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest ``id_col``, nulls last; of rows alike in it, one."""
    marked = fingerprints(docs, docs.columns, name="__fingerprint").withColumn("__row", F.monotonically_increasing_id())
    marked = stored(marked, "fingerprinted")
    place = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    rows = marked.select(place.alias("place"), F.col("__fingerprint").alias("fingerprint"))
    kept = with_component(rows, "place").where(F.col("place") == F.col("component_id")).select(F.col("place.row").alias("__row"))
    return marked.join(kept, "__row", "left_semi").select(*docs.columns)
