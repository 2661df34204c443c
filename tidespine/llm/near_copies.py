"""Near copies by the similarity of five-word shingle sets: every pair of similarity 0.8 or more, none missed.

Two sets of that similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, whatever the common order of shingles, so only those are dealt,
rare shingles first. Of the pairs that share one, those go whose sizes or whose sketches rule the similarity out; the few left are verified on the texts.

A sketch holds for each cell of a hash the parity of the set's shingles in it, about a bit a shingle. A shingle of one set alone changes one cell, so two
sketches differ in no more cells than the sets in shingles: at similarity 0.8, a ninth of both sizes together.

SimHash comes first: texts that op9's vantage-point trees put together are verified and joined, so that the exact join meets few members of a group of copies.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidespine.llm import simhash
from tidespine.llm.common import Scratch, release, ship, slices
from tidespine.llm.components import connected_components

SHINGLE = 5
#: Documents aimed at for the sample that tells frequent shingles, and how many of them must hold one. Both touch the cost alone, not the links.
SAMPLE, FREQUENT = 10000, 3
#: Rounds in which each text meets one text of another component. They touch the cost alone, not the links.
ROUNDS = 2


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles; fewer words are one shingle, no words none. Words as in ``simhash.fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:max(1, len(words) - shingle + 1)]
    last = ends[min(shingle, len(words)) - 1:]
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts.tolist(), last.tolist())], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' shared part is 0.8 of their union or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles in each cell, as 64-bit words: four words, or twice as many again until there is a cell for each shingle."""
    words = 4
    while 64 * words < len(s):
        words *= 2
    bits = np.bincount((s % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def frequent(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``FREQUENT`` or more documents of a sample of about ``SAMPLE`` hold, sorted, and how many do. The sample's texts bound what the driver
    gets: a third of its shingles at most, 16 bytes each."""
    ship(docs.sparkSession)
    part = int(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 30))
    some = docs.select(text).where(F.pmod(F.xxhash64(F.lit("near copies"), text), F.lit(1 << 30)) < part).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for piece in slices(batches, text):
            sets = [shingle_set(t) for t in piece.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["h"])

    rows = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).toPandas()
    values, counts = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def marked_prefixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __unit (digest of the shingle set), __size, __sketch, __print (op9's fingerprint) and __prefix: its first shingles, the sample's frequent
    ones last."""
    spark, names = docs.sparkSession, docs.columns
    known = spark.sparkContext.broadcast(frequent(docs, text))

    def prefix(s: np.ndarray) -> np.ndarray:
        values, counts = known.value
        if not len(s):
            return s
        weight = np.zeros(len(s), np.int64)
        if len(values):
            at = np.minimum(np.searchsorted(values, s), len(values) - 1)
            weight = np.where(values[at] == s, counts[at], 0)
        return s[np.lexsort((s, weight))][:len(s) + (-4 * len(s) // 5) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for piece in slices(batches, text):
            texts = piece.column(piece.schema.get_field_index(text)).to_pylist()
            sets = [shingle_set(t) for t in texts]
            prints = np.frombuffer(b"".join(map(simhash.fingerprint, texts)), ">u8").astype(np.uint64).view(np.int64)
            units = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(units), pa.array([len(s) for s in sets], pa.int32()),
                                              pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array(prints), pa.array([prefix(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             names=[*names, "__unit", "__size", "__sketch", "__print", "__prefix"])

    longs = T.ArrayType(T.LongType())
    more = [T.StructField("__unit", T.LongType()), T.StructField("__size", T.IntegerType()), T.StructField("__sketch", longs),
            T.StructField("__print", T.LongType()), T.StructField("__prefix", longs)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def may_be_similar(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """Whether sets with these sizes and sketches (n, s) can have the similarity. Sketches of sizes so near have as many words, or one twice as many: its halves
    are then laid over each other, which gives the sketch of half the cells."""
    def folded(x: Column, words: Column) -> Column:
        half = F.zip_with(F.slice(x["s"], F.lit(1), words), F.slice(x["s"], words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x["s"]) > words, half).otherwise(x["s"])

    words = F.least(F.size(a["s"]), F.size(b["s"]))
    cells = F.aggregate(F.zip_with(folded(a, words), folded(b, words), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    return F.when((5 * a["n"] >= 4 * b["n"]) & (5 * b["n"] >= 4 * a["n"]), 9 * cells <= a["n"] + b["n"]).otherwise(False)


def groups_may_be_similar(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether any set of group a and any of b can have the similarity; a group has (least, most) sizes, s and k. Bits of k are the cells in which all its
    sketches are alike, and s says how; no k stands for all cells. Only cells that both groups know are counted."""
    def laid(xs: Column, over: Column, words: Column, op: str) -> Column:
        half = F.zip_with(F.slice(xs, F.lit(1), words), F.slice(xs, words + 1, words), lambda p, q: getattr(p, op)(q))
        return F.when(F.size(over) > words, half).otherwise(xs)

    words = F.least(F.size(a["s"]), F.size(b["s"]))
    known = [laid(F.coalesce(x["k"], F.transform(x["s"], lambda _: F.lit(-1).cast("long"))), x["s"], words, "bitwiseAND") for x in (a, b)]
    values = [laid(x["s"], x["s"], words, "bitwiseXOR") for x in (a, b)]
    other = F.zip_with(*values, lambda p, q: p.bitwiseXOR(q))
    cells = F.aggregate(F.zip_with(other, F.zip_with(*known, lambda p, q: p.bitwiseAND(q)), lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda x, y: x + y)
    single = {"n": a["most"], "s": a["s"]}, {"n": b["most"], "s": b["s"]}
    return F.when(a["k"].isNull() & b["k"].isNull(), may_be_similar(*single)).when((5 * a["most"] >= 4 * b["least"]) & (5 * b["most"] >= 4 * a["least"])
                                                                                  & (F.greatest(F.size(a["s"]), F.size(b["s"])) <= 2 * words), 9 * cells <= a["most"] + b["most"]).otherwise(False)


def known_cells(units: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, words, v, k): of the units of each component whose sketches have so many words, the cells in which all are alike (k) and how (v)."""
    parts = units.join(roots, units["unit"] == roots["u"]).select("root", F.size("s").alias("words"), F.posexplode("s").alias("at", "w"))
    parts = parts.groupBy("root", "words", "at").agg(F.bit_and("w").alias("all"), F.bit_or("w").alias("any"))
    known = F.struct("at", F.col("all").alias("v"), F.col("all").bitwiseOR(F.bitwise_not("any")).alias("k"))
    return parts.groupBy("root", "words").agg(F.sort_array(F.collect_list(known)).alias("x")).select("root", "words", F.col("x.v").alias("v"), F.col("x.k").alias("k"))


#: A row's place in the bitmap, and its word and bit there, as SQL.
PLACE, WORD, BIT = f"pmod(xxhash64(__row), {1 << 24})", "cast(__place div 64 as int)", "shiftleft(1L, cast(__place % 64 as int))"


def row_bits(rows: DataFrame) -> DataFrame:
    """A bitmap of the hashes of ``rows`` (__row): 2^18 words at most, whatever the input, hence broadcast where it is used."""
    return rows.select(F.expr(PLACE).alias("__place")).groupBy(F.expr(WORD).alias("__word")).agg(F.bit_or(F.expr(BIT)).alias("__bits"))


def with_bit(table: DataFrame, words: DataFrame) -> DataFrame:
    """``table`` with __marked: false for rows that are surely not among those of the bitmap."""
    placed = table.withColumn("__place", F.expr(PLACE)).withColumn("__word", F.expr(WORD)).join(F.broadcast(words), "__word", "left")
    return placed.withColumn("__marked", F.coalesce(F.col("__bits").bitwiseAND(F.expr(BIT)) != 0, F.lit(False))).drop("__place", "__word", "__bits")


def texts_of(pairs: DataFrame, marked: DataFrame, text: str, held: Scratch) -> DataFrame:
    """(unit, text) of the units in ``pairs``, from the first row of each. Most other texts are left out before the shuffle."""
    units = pairs.select(F.col("a").alias("__unit")).union(pairs.select("b")).distinct()
    wanted = held.stored(marked.select("__unit", "__row").join(units, "__unit", "left_semi").groupBy("__unit").agg(F.min("__row").alias("__row")).select("__row"), "near-rows")
    some = with_bit(marked.select(F.col("__unit").alias("unit"), F.col(text).alias("text"), "__row"), held.stored(row_bits(wanted), "near-bits")).where("__marked")
    return some.join(wanted, "__row", "left_semi").select("unit", "text")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of units whose texts are similar; ``texts`` has one row of (unit, text) for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = None, None  # rows of one a mostly stand together
        for batch in batches:
            for piece in slices(slices([batch], "ta"), "tb"):
                a, b, ta, tb = (c.to_pylist() for c in piece.columns)
                good = []
                for x, s, t in zip(a, ta, tb):
                    if held[0] != x:
                        held = x, shingle_set(s)
                    good.append(similar(held[1], shingle_set(t)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("unit").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("unit").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, units: DataFrame, marked: DataFrame, text: str) -> DataFrame:
    """The similar ones of ``pairs`` (a, b), stored. Sizes and sketches are met first, texts only for what they leave."""
    held, kept = Scratch(pairs.sparkSession), Scratch(pairs.sparkSession)
    x, y = (units.select(F.col("unit").alias(c), F.struct("n", "s").alias(of)) for c, of in (("a", "x"), ("b", "y")))
    likely = held.stored(pairs.join(x, "a").join(y, "b").where(may_be_similar(F.col("x"), F.col("y"))).select("a", "b"), "near-likely")
    links = kept.stored(verified(likely, texts_of(likely, marked, text, held)), "near-links")
    held.drop()
    return links


def print_pairs(units: DataFrame) -> DataFrame:
    """(a, b): each unit with the smallest unit of its SimHash component, found by op9's vantage-point trees."""
    roots = simhash.near_components(units.select("f"), "f")
    placed = units.select("unit", "f").join(roots, "f", "left").select(F.col("unit").alias("b"), F.coalesce("root", "f").alias("root"))
    return placed.join(placed.groupBy("root").agg(F.min("b").alias("a")), "root").where("a <> b").select("a", "b")


def star_pairs(rooted: DataFrame, tried: DataFrame) -> DataFrame:
    """(a, b) not ``tried``: each unit that stands in blocks with smaller components, and one unit of those it meets most often; a row for each unit at most."""
    least = rooted.groupBy("h").agg(F.min(F.struct("root", "u")).alias("low"), F.max("root").alias("high")).where("low.root < high").select("h", "low")
    meets = rooted.join(least, "h").where("root <> low.root").groupBy("u", F.col("low.u").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    meets = meets.select("u", "n", F.least("x", "u").alias("a"), F.greatest("x", "u").alias("b")).join(tried, ["a", "b"], "left_anti")
    best = F.max_by(F.struct("a", "b"), F.struct("n", "a", "b"))
    return meets.groupBy("u").agg(best.alias("best")).select("best.a", "best.b").distinct()


def near_links(marked: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links of units that connect exactly what pairs of similarity 0.8 or more connect.

    First each unit is held against the smallest of its SimHash component, then, in a few rounds, against one unit of the component it shares most blocks with
    (a block: the units whose prefixes share a shingle); each round takes a pair a unit at most. The last round takes all pairs of a block that those links
    leave in different components, so a large group of copies is not met as pairs. There a block's components meet first, by the range of their sizes and the
    cells all their sketches agree in, then their units by sketches: what a passage shared by many unlike texts makes of pairs goes inside these joins.
    """
    held = Scratch(marked.sparkSession)
    some = marked.where("__size > 0")
    units = some.select(F.col("__unit").alias("unit"), F.col("__size").alias("n"), F.col("__sketch").alias("s"), F.col("__print").alias("f"))
    units = held.stored(units.dropDuplicates(["unit"]), "near-units")
    places = some.select(F.col("__unit").alias("u"), F.col("__size").alias("n"), F.explode("__prefix").alias("h"))
    shared = held.stored(places.groupBy("h").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low < high").select("h"), "near-shared")
    placed = held.stored(places.join(shared, "h").distinct(), "near-blocks")

    tried = held.stored(print_pairs(units), "near-pairs")
    links = linked(tried, units, marked, text)
    for _ in range(ROUNDS):
        pairs = held.stored(star_pairs(_rooted(placed, _roots(links)), tried), "near-pairs")
        links, tried = links.union(linked(pairs, units, marked, text)), tried.union(pairs)

    roots = held.stored(_roots(links), "near-roots")
    rooted = _rooted(placed, roots)
    several = held.stored(rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h"), "near-mixed")
    sketches = units.select(F.col("unit").alias("u"), "s")
    sized = held.stored(rooted.join(several, "h").join(units.select(F.col("unit").alias("u"), F.size("s").alias("words")), "u"), "near-rooted")
    group = sized.groupBy("h", "root", "words").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("u").alias("u"), F.max("u").alias("last"))
    cells = held.stored(known_cells(units, roots), "near-cells")
    alone = group.where("u = last").join(sketches, "u").select("h", "root", "words", "least", "most", "u", "s", F.lit(None).cast("array<long>").alias("k"))
    more = group.where("u < last").join(cells, ["root", "words"]).select("h", "root", "words", "least", "most", F.lit(None).cast("long").alias("u"), F.col("v").alias("s"), "k")
    group = held.stored(alone.union(more), "near-groups")
    l, r = group.alias("l"), group.alias("r")
    fields = lambda of, names: {c: F.col(f"{of}.{c}") for c in names}
    alike = groups_may_be_similar(fields("l", ("least", "most", "s", "k")), fields("r", ("least", "most", "s", "k")))
    met = l.join(r, (F.col("l.h") == F.col("r.h")) & (F.col("l.root") < F.col("r.root")) & alike)
    met = met.select("l.h", *[F.col(f"{g}.{c}").alias(f"{g}_{c}") for g in "lr" for c in ("root", "words", "u")])
    met = held.stored(met, "near-met")
    single = met.where("l_u is not null and r_u is not null").select(F.col("l_u").alias("x"), F.col("r_u").alias("y"))
    large = met.where("l_u is null or r_u is null").drop("l_u", "r_u")
    # the units of the left group meet the right group, those that may be similar its units
    keys = large.select("h", F.col("l_root").alias("root"), F.col("l_words").alias("words")).union(large.select("h", "r_root", "r_words")).distinct()
    members = held.stored(sized.join(keys, ["h", "root", "words"], "left_semi").join(sketches, "u"), "near-members")
    right = large.join(group.select("h", F.col("root").alias("r_root"), F.col("words").alias("r_words"), "least", "most", "s", "k"), ["h", "r_root", "r_words"]).alias("g")
    x, y = members.alias("x"), members.alias("y")
    one = {"least": F.col("x.n"), "most": F.col("x.n"), "s": F.col("x.s"), "k": F.lit(None).cast("array<long>")}
    half = x.join(right, (F.col("x.h") == F.col("g.h")) & (F.col("x.root") == F.col("g.l_root")) & (F.col("x.words") == F.col("g.l_words"))
                  & groups_may_be_similar(one, fields("g", ("least", "most", "s", "k"))))
    half = half.select("x.h", "x.u", "x.n", "x.s", "g.r_root", "g.r_words").alias("x")
    full = half.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.r_root") == F.col("y.root")) & (F.col("x.r_words") == F.col("y.words"))
                     & may_be_similar(fields("x", "ns"), fields("y", "ns")))
    rest = single.union(full.select(F.col("x.u").alias("x"), F.col("y.u").alias("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = held.stored(rest.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    links = links.union(linked(rest, units, marked, text))
    held.drop()
    return links


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("u"), "root")


def _rooted(placed: DataFrame, roots: DataFrame) -> DataFrame:
    return placed.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies: the smallest ``id_col``, nulls last; of rows alike in it, one.

    Equal shingle sets are linked, the empty set of texts without words (null, empty or blank) like any other; ids are reduced to one per set before anything is
    joined. A text of any length is taken whole, an empty table stays empty, and rows that are kept are not shuffled. Columns must not be named __row, __unit,
    __size, __sketch, __print or __prefix.
    """
    clash = {"__row", "__unit", "__size", "__sketch", "__print", "__prefix"}.intersection(docs.columns)
    if clash:
        raise ValueError(f"columns named {sorted(clash)}")
    kept = Scratch(docs.sparkSession)
    marked = kept.stored(marked_prefixes(docs, text).withColumn("__row", F.monotonically_increasing_id()), "near-copies")
    links = near_links(marked, text)
    roots = connected_components(links).select(F.col("node").alias("__unit"), "root")
    place = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    best = marked.groupBy("__unit").agg(F.min(place).alias("best")).join(roots, "__unit", "left")
    keep = best.groupBy(F.coalesce("root", "__unit").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    gone = kept.stored(marked.select("__row").join(keep, "__row", "left_anti"), "near-gone")
    tried = with_bit(marked.select(*docs.columns, "__row"), kept.stored(row_bits(gone), "near-bits"))
    return tried.where("not __marked").select(*docs.columns).union(tried.where("__marked").join(gone, "__row", "left_anti").select(*docs.columns))
