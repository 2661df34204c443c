"""Name and text matching joins that avoid comparing every pair."""
from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tidespine.functions.text import normalize_name
from tidespine.session import cut_lineage

CUTOFF = 0.85


def similarity(a: str, b: str) -> Column:
    """Matching-block ratio 2M/T of two names; runs only on the few candidate pairs.

    The worker function is built here so that it travels with the job by value.
    """
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        matcher, last, out = difflib.SequenceMatcher(), None, []
        for left, right in zip(x, y):
            if right != last:
                matcher.set_seq2(right)  # the second sequence is indexed once and reused
                last = right
            matcher.set_seq1(left)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratios, DoubleType())(F.col(a), F.col(b))


def _bigrams(df: DataFrame, name: str, length: str) -> DataFrame:
    """One row per (name, numbered bigram): repeated bigrams get a running number, so counts are multisets."""
    n = F.length(name)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col(name), i, F.lit(2))))
    counts = df.select(name, length, F.explode(grams).alias("_g")).groupBy(name, length, "_g").agg(F.count(F.lit(1)).alias("_c"))
    return counts.select(name, length, F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))).alias("_k"), "_g").select(
        name, length, F.xxhash64("_g", "_k").alias("_g"))


#: Keys that a name may get: it is looked up by three, two or one of its rarest bigrams, by as many as keep to this. It touches the cost alone, not the pairs.
KEYS = 150


def _choices(tokens: str, several: Column) -> Column:
    """Hashes of all choices of ``several`` (1 to 3) elements of the array, in its order."""
    p, rest = F.col(tokens), lambda i: F.slice(tokens, i, F.greatest(F.size(tokens) - i + 1, F.lit(0)))
    two = F.flatten(F.transform(p, lambda x, i: F.transform(rest(i + 2), lambda y: F.xxhash64(x, y))))
    three = F.flatten(F.transform(p, lambda x, i: F.flatten(F.transform(rest(i + 2), lambda y, j: F.transform(rest(i + j + 3), lambda z: F.xxhash64(x, y, z))))))
    return F.when(several == 1, p).when(several == 2, two).otherwise(three)


def fuzzy_pairs(names: DataFrame, aliases: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(name, alias, ratio) for all pairs with ratio >= cutoff, found without a cross join.

    With ratio >= c, M >= cT/2 characters match in at most T-2M+1 blocks, so the names share at least
    k = M - (T-2M+1) = 3M-T-1 bigrams. Any two names that share k of their n bigrams share s of them among
    the rarest n-k+s of each side, so only names with the same s rare bigrams meet (prefix filter), s being
    1 to 3 by the two lengths; equal names are added directly. Their unmatched characters, T-2M at most,
    bound the edit distance, which rules out most that meet. Both bounds are exact for every length, so no true match is lost.
    """
    if cutoff < CUTOFF:
        raise ValueError("the bigram bound needs a cutoff of at least 0.85")
    names = names.select("name").where("name is not null").distinct().withColumn("_ln", F.length("name"))
    aliases = aliases.select("alias").where("alias is not null").distinct().withColumn("_la", F.length("alias"))
    shortest = cutoff / (2.0 - cutoff)  # the partner is at least this fraction as long
    ng, ag = cut_lineage(_bigrams(names, "name", "_ln")), cut_lineage(_bigrams(aliases, "alias", "_la"))
    count = lambda grams, to: grams.groupBy("_g").agg(F.count(F.lit(1)).alias(to))
    freq = cut_lineage(count(ng, "_f").join(count(ag, "_fa"), "_g").select("_g", (F.col("_f") * F.col("_fa")).alias("_f")))  # bigrams of both sides

    matched = F.ceil(cutoff * (F.col("_ln") + F.col("_la")) / 2 - 1e-9).cast("int")  # M, at least
    spare = F.col("_ln") + F.col("_la") - 2 * matched
    close = (F.col("_la") >= F.col("_ln") * shortest - 1e-9) & (F.col("_ln") >= F.col("_la") * shortest - 1e-9) & (spare >= 0)
    # one row for each two lengths that occur; its k and s hold for all names of these lengths
    lengths = ng.select("_ln").distinct().join(ag.select("_la").distinct(), close).withColumn("_share", F.greatest(F.lit(1), matched - spare - 1))
    left = F.greatest("_ln", "_la") - 1 - F.col("_share")
    several = F.when((left + 3) * (left + 2) * (left + 1) <= 6 * KEYS, 3).when((left + 2) * (left + 1) <= 2 * KEYS, 2).otherwise(1)
    lengths = cut_lineage(lengths.withColumn("_s", F.least("_share", several)))

    def keyed(grams: DataFrame, key: str, length: str) -> DataFrame:
        shares = lengths.groupBy(length, "_s").agg(F.min("_share").alias("_share"))
        found = F.sort_array(F.collect_list(F.struct("_f", F.col("_g").alias("g"))))  # those of one side alone come first in the order and meet nothing
        lists = grams.join(freq, "_g").groupBy(key, length).agg(found["g"].alias("_l")).join(F.broadcast(shares), length)
        gone = F.greatest(F.col(length) - 1, F.lit(1)) - F.size("_l")
        rare = F.slice("_l", F.lit(1), F.greatest(F.col(length) - 1 - F.col("_share") + F.col("_s") - gone, F.lit(0)))
        return lists.select(key, length, "_s", rare.alias("_p")).select(key, length, "_s", F.explode(_choices("_p", F.col("_s"))).alias("_x"))

    met = keyed(ng, "name", "_ln").join(keyed(ag, "alias", "_la"), ["_x", "_s"]).join(F.broadcast(lengths), ["_ln", "_la", "_s"], "left_semi")
    pairs = met.where(F.levenshtein("name", "alias") <= spare).select("name", "alias").distinct()
    equal = names.join(aliases, names["name"] == aliases["alias"]).select("name", "alias")
    pairs = pairs.unionByName(equal).distinct()
    return pairs.withColumn("ratio", similarity("name", "alias")).where(F.col("ratio") >= cutoff)


def match_names(raw_names: DataFrame, targets: DataFrame, cutoff: float = CUTOFF, all_names: bool = False) -> DataFrame:
    """(raw name, ticker): raw names mapped to tickers by normalised fuzzy match.

    ``raw_names`` has column ``raw``; ``targets`` is (ticker, search_name). By default each ticker keeps
    its best normalised name, and one raw name for it (the last by order); ``all_names`` keeps every raw
    name at or above the cutoff, with its best ticker.
    """
    raw = cut_lineage(raw_names.select("raw").distinct()).withColumn("name", normalize_name("raw"))  # the rows are read once, their names many times
    wanted = targets.select("ticker", normalize_name("search_name").alias("alias"))
    scored = fuzzy_pairs(raw, wanted.select("alias"), cutoff).join(wanted, "alias")
    if all_names:
        best = scored.groupBy("name").agg(F.max_by("ticker", F.struct("ratio", "ticker")).alias("ticker"))
        return raw.join(best, "name").select("raw", "ticker")
    best = scored.groupBy("ticker").agg(F.max_by("name", F.struct("ratio", "name")).alias("name"))
    last = raw.groupBy("name").agg(F.max("raw").alias("raw"))
    owner = best.groupBy("name").agg(F.max("ticker").alias("ticker"))
    return last.join(owner, "name").select("raw", "ticker")


GRAM_LENGTHS = (8, 4, 2, 1)
#: Texts aimed at for the sample that tells how frequent a gram is. It touches the cost alone, not the pairs.
SAMPLE = 2000
#: Bits of the anchor bitmap for each anchor, and bits at most (512 KB).
BITS_EACH, BITS_MOST = 16, 1 << 22


def contains_pairs(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, pattern) for every pattern that occurs anywhere in the text, for dictionaries of any size.

    A pattern is looked up by one of its grams of 8, 4, 2 or 1 characters, as long as it has: the one that a sample of the texts holds least often. Texts are
    scanned for the first bytes of it, as UTF-8 holds a string where it holds its bytes. Empty and null patterns match nothing. The only values on the driver are the gram lengths in use, at most four, and the size of the anchor bitmap.
    """
    anchors, _ = _gram_anchors(texts, patterns, text, pattern)
    return _verified(texts, _byte_hits(texts, anchors, text, pattern, keys), text, pattern, keys, lambda p: F.contains(F.col(text), p))


def word_pairs(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, pattern) for every pattern that occurs in the text with word boundaries at both ends.

    A pattern is looked up by its first word, which must be a whole word of such a text; one without any word by a gram, like a substring.
    """
    heads = patterns.select(pattern).where(F.length(pattern) > 0).distinct().withColumn("_g", F.regexp_extract(pattern, r"(?U)\w+", 0))
    words = F.array_distinct(F.split(text, r"(?U)\W+"))
    wordless = heads.where("_g = ''").select(pattern)
    if wordless.isEmpty():
        anchors, parts = heads.select(pattern, "_g"), words
    else:
        grams, parts = _gram_anchors(texts, wordless, text, pattern)
        marked = lambda xs, mark: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
        anchors = heads.where("_g <> ''").select(pattern, F.concat(F.lit("w"), "_g").alias("_g")).unionByName(grams.select(pattern, F.concat(F.lit("g"), "_g").alias("_g")))
        parts = F.concat(marked(words, "w"), marked(parts, "g"))
    quoted = lambda p: F.concat(F.lit(r"(?U)\b\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    hits = _part_hits(texts, anchors, parts, text, pattern, keys)
    return _verified(texts, hits, text, pattern, keys, lambda p: F.contains(F.col(text), p) & F.regexp_like(F.col(text), quoted(p)))


def _grams_at(value: str, q: int) -> Column:
    """The distinct grams of q characters: a zero-width lookahead captures one at every position in one linear pass."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{q}}}))"), 1))


def _gram_anchors(texts: DataFrame, patterns: DataFrame, text: str, pattern: str) -> tuple[DataFrame, Column]:
    """(pattern, _g): the rarest gram of each pattern by a sample of the texts; and the grams of a text, of the lengths in use."""
    size, length = F.length(pattern), F.lit(None).cast("int")
    for q in reversed(GRAM_LENGTHS):
        length = F.when(size >= q, F.lit(q)).otherwise(length)
    sized = patterns.select(pattern).where(size > 0).distinct().withColumn("_q", length)
    in_use = sorted(r["_q"] for r in sized.select("_q").distinct().collect())
    own = F.lit(None).cast("array<string>")
    for q in in_use:
        own = F.when(F.col("_q") == q, _grams_at(pattern, q)).otherwise(own)
    grams = sized.select(pattern, F.posexplode(own).alias("_at", "_g"))
    parts = F.concat(F.array().cast("array<string>"), *[_grams_at(text, q) for q in in_use])
    drawn = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64(text), F.lit(drawn)) == 0).select(F.explode(parts).alias("_g"))
    often = some.join(grams.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    ranked = grams.join(often, "_g", "left").groupBy(pattern).agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_at")).alias("_g"))
    return cut_lineage(ranked), parts


def _anchor_bits(anchors: DataFrame) -> tuple[DataFrame, int]:
    """(one row with a bitmap of the hashes of the anchors, its size in bits): bounded whatever the dictionary."""
    bits = 1 << 10
    while bits < min(BITS_MOST, BITS_EACH * anchors.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("_g"), F.lit(bits))
    held = anchors.select(place.alias("_p")).groupBy(F.expr("cast(_p div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("b")).collect()
    words = [0] * (bits // 64)
    for r in held:
        words[r["w"]] = r["b"]
    return anchors.sparkSession.createDataFrame([(words,)], "bits array<long>"), bits


def _part_hits(texts: DataFrame, anchors: DataFrame, parts: Column, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, pattern): parts of a text that pass the bitmap of the anchors become rows; these meet the anchors in an equi-join."""
    held, bits = _anchor_bits(anchors)

    def known(g: Column) -> Column:
        place = F.pmod(F.xxhash64(g), F.lit(bits))
        return F.get(F.col("_bits"), F.floor(place / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))) != 0

    marked = texts.select(*keys, text).withColumn("_bits", held.scalar())
    return marked.select(*keys, F.explode(F.filter(parts, known)).alias("_g")).join(anchors.select(pattern, "_g"), "_g").select(*keys, pattern)


#: Bytes of text that are looked up at a time.
PIECE = 1 << 18


def _byte_hits(texts: DataFrame, anchors: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, pattern): the same for grams at any position. An anchor's first 8, 4, 2 or 1 bytes, as many as it has, are looked up in the bytes of the texts.

    The worker functions are built here so that they travel with the job by value.
    """
    n = F.octet_length("_g")
    width = F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    starts = anchors.select(pattern, F.substring(F.col("_g").cast("binary"), F.lit(1), width).alias("_k"))
    widths = sorted(r["_w"] for r in starts.select(F.octet_length("_k").alias("_w")).distinct().collect())
    bits = 1 << 10
    while bits < min(BITS_MOST, BITS_EACH * anchors.count()):
        bits *= 2
    shift, odd, piece = np.uint64(65 - bits.bit_length()), np.uint64(0x9E3779B97F4A7C15), PIECE

    def places(values: np.ndarray, width: int) -> np.ndarray:
        return ((values.astype(np.uint64) + np.uint64(width)) * odd) >> shift

    def mark(batches):
        for batch in batches:
            at = [int(places(np.frombuffer(k, f"<u{len(k)}"), len(k))[0]) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x // 8 for x in at], pa.int32()), pa.array([1 << x % 8 for x in at], pa.int32())], names=["_at", "_b"])

    marks = starts.select("_k").distinct().mapInArrow(mark, "_at int, _b int").groupBy("_at").agg(F.bit_or("_b").alias("_b")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in marks:
        bitmap[r["_at"]] = r["_b"]
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches):
        known = np.unpackbits(held.value, bitorder="little").view(bool)
        for batch in batches:
            col = batch.column(batch.num_columns - 1).cast(pa.large_string())
            if not len(col) or col.buffers()[2] is None:
                continue
            ends, data = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1], np.frombuffer(col.buffers()[2], np.uint8)
            for width in widths:
                for start in range(int(ends[0]), int(ends[-1]) - width + 1, piece):
                    windows = np.ndarray((min(piece, int(ends[-1]) - width + 1 - start),), f"<u{width}", data, start, (1,))
                    at = np.flatnonzero(known[places(windows, width)])
                    row = np.searchsorted(ends, at + start, "right") - 1
                    inside = at + start + width <= ends[row + 1]
                    row, value = row[inside], windows[at[inside]]
                    order = np.lexsort((value, row))
                    row, value = row[order], value[order]
                    first = np.ones(len(row), bool)
                    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                    row, value = row[first], value[first]
                    if len(row):
                        offsets = pa.py_buffer(np.arange(0, width * len(row) + 1, width, dtype=np.int32))
                        found = pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(np.ascontiguousarray(value))])
                        taken = pa.array(row)
                        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in range(batch.num_columns - 1)), found], names=[*batch.schema.names[:-1], "_k"])

    read = texts.where(F.col(text).isNotNull()).select(*keys, text)
    schema = StructType([*read.schema.fields[:-1], StructField("_k", BinaryType())])
    return read.mapInArrow(scan, schema).join(starts, "_k").select(*keys, pattern)


def _verified(texts: DataFrame, hits: DataFrame, text: str, pattern: str, keys: list[str], holds) -> DataFrame:
    """Only keys and patterns of the candidates meet the texts again, once each, and they are verified inside the row."""
    hits = hits.groupBy(*keys).agg(F.collect_set(pattern).alias("_p"))  # at most the patterns whose anchors a text has
    return texts.select(*keys, text).join(hits, keys).select(*keys, F.explode(F.filter("_p", holds)).alias(pattern))


def tag_entities(df: DataFrame, text: Column, aliases: DataFrame, out: str = "tags") -> DataFrame:
    """``df`` with ``out``: the sorted distinct entities whose aliases the text names, as whole words in any case.

    ``aliases`` is (entity, alias), of any size. Tags belong to a text, so they are found by its digest and copies
    share them; texts without a hit, and null, get an empty array.
    """
    keyed = df.withColumn("_low", F.lower(text)).withColumn("_key", F.sha2("_low", 256))
    names = aliases.select("entity", F.lower("alias").alias("_alias")).distinct()
    hits = word_pairs(keyed.where("_key is not null"), names, "_low", "_alias", ["_key"])
    tags = hits.join(names, "_alias").groupBy("_key").agg(F.array_sort(F.collect_set("entity")).alias(out))
    return keyed.drop("_low", out).join(tags, "_key", "left").drop("_key").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def first_security(holdings: DataFrame, targets: DataFrame) -> DataFrame:
    """(ticker, cusip): the first listed security whose cleaned issuer name contains any pattern.

    ``holdings`` is (ord, cusip, issuer); ``targets`` is (ticker, pattern).
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))
    names = holdings.groupBy(clean("issuer").alias("_n")).agg(F.min(F.struct("ord", "cusip")).alias("_first"))
    wanted = targets.select("ticker", clean("pattern").alias("_p"))
    hits = contains_pairs(names.select("_n"), wanted.select("_p"), "_n", "_p", ["_n"])
    return hits.join(wanted, "_p").join(names, "_n").groupBy("ticker").agg(
        F.min("_first").alias("_f")).select("ticker", F.col("_f.cusip").alias("cusip"))
