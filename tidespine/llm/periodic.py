"""Periodic runs of words, by Lyndon roots.

The first phase of Baier's suffix sorter groups the suffixes of a word sequence by their longest Lyndon prefix, so the lengths of the group contexts
are the Lyndon array. It runs under both orders of the words; every run has a Lyndon root that stands in one of the two arrays, and the longest
common extensions of a root and of what stands one root further give the whole run.

Most words are in no run of four periods. Before the sorter, whole slices of texts are cut down to the stretches that could hold the repeating part
of one, by the distance from each word to its next occurrence; that part is never lost (``stretches``).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidespine.llm.common import ship, slices

#: The least length of a run, in words and in periods.
LEAST, TIMES = 6, 4


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place (a proper prefix counts as smaller).

    Groups are taken from the largest. When a group is taken its contexts are final; each of its suffixes hangs on the nearest place before it that is
    in a smaller group, whose context takes in the group's, once for each suffix that hangs there. Places of one group that took in more go to larger groups.
    """
    n = len(ranks)
    size, before = [1] * n, list(range(-1, n - 1))  # context lengths; a place before, between which and this one all are taken
    by_rank: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        by_rank.setdefault(r, []).append(i)
    members = [by_rank[r] for r in sorted(by_rank)]
    lower, upper = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    group, taken = [0] * n, [False] * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    g = len(members) - 1
    while g >= 0:
        places = [i for i in members[g] if group[i] == g]  # others have moved up since they were listed
        for i in places:
            taken[i] = True
        hung: dict[int, int] = {}
        for i in places:
            at, path = i, []
            while at >= 0 and taken[at]:
                path.append(at)
                at = before[at]
            for p in path:
                before[p] = at
            if at >= 0:
                hung[at] = hung.get(at, 0) + 1
        if hung:
            length, moved = size[places[0]], {}
            for at, k in hung.items():
                size[at] += k * length
                moved.setdefault((k, group[at]), []).append(at)
            for (_, h), up in sorted(moved.items(), reverse=True):  # each goes just above its old group, so those that took in most are linked first
                new, next_up = len(members), upper[h]
                members.append(up)
                for at in up:
                    group[at] = new
                lower.append(h)
                upper.append(next_up)
                upper[h] = lower[next_up] = new  # the group taken now is above every h
        g = lower[g]
    return size


def common_ahead(a: list[int], i: int, j: int) -> int:
    """Length of the longest common extension of places i < j to the right."""
    k, step, n = 0, 8, len(a)
    while j + k + step <= n and a[i + k:i + k + step] == a[j + k:j + k + step]:
        k, step = k + step, 2 * step
    while step:
        if j + k + step <= n and a[i + k:i + k + step] == a[j + k:j + k + step]:
            k += step
        step //= 2
    return k


def common_behind(a: list[int], i: int, j: int) -> int:
    """Length of the longest common extension of what ends before places i < j to the left."""
    k, step = 0, 8
    while i - k - step >= 0 and a[i - k - step:i - k] == a[j - k - step:j - k]:
        k, step = k + step, 2 * step
    while step:
        if i - k - step >= 0 and a[i - k - step:i - k] == a[j - k - step:j - k]:
            k += step
        step //= 2
    return k


def runs_of(ranks: list[int]) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``LEAST`` words and ``TIMES`` periods; the period is the smallest, as a Lyndon word repeats no part.

    Such a run holds its Lyndon root three times in a row, which tells the few places to extend from.
    """
    n, found = len(ranks), set()
    for order in (ranks, [-r for r in ranks]):
        root, place = np.array(lyndon_array(order), np.int64), np.arange(n)
        once, twice = np.minimum(place + root, n - 1), np.minimum(place + 2 * root, n - 1)
        thrice = (place + 3 * root <= n) & (root[once] == root) & (root[twice] == root)
        covered: dict[int, int] = {}  # by period, where the last run ended
        for i in np.flatnonzero(thrice).tolist():
            q = int(root[i])
            if i + q < covered.get(q, 0):  # more than a period of it is in that run
                continue
            start, end = i - common_behind(ranks, i, i + q), i + q + common_ahead(ranks, i, i + q)
            covered[q] = end
            if end - start >= max(LEAST, TIMES * q):
                found.add((start, end - start, q))
    return found


def stretches(words: np.ndarray, ends: np.ndarray, rounds: int = 64) -> list[tuple[int, int, int]]:
    """(first, last, limit) of the parts of texts that may hold runs: every run's words but its last period lie in one of [first, last), its end is at most ``limit``.

    ``words`` are the word numbers of texts laid end to end, ``ends`` where each ends. A word of a run of period q has an equal word at most q further on, but for the
    last q; those with one are at least three times q. So in a stretch of m such words none counts whose next equal word is more than m / 3 off, and the stretch
    falls apart there; again until nothing changes. Fewer ``rounds`` only leave more words than needed.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    ahead = np.full(n, n, np.int64)
    ahead[order[:-1]] = np.where(words[order[:-1]] == words[order[1:]], order[1:], n)
    text_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    off = np.where(ahead < text_end, ahead - np.arange(n), n)
    alive = np.flatnonzero(off < n)
    for _ in range(rounds):
        cut = np.flatnonzero(np.diff(alive) != 1) + 1
        starts = np.concatenate([[0], cut])[:len(alive)]
        long = np.diff(np.concatenate([starts, [len(alive)]]))
        room = np.repeat(np.where(long >= LEAST - 1, long // (TIMES - 1), 0), long)
        kept = alive[off[alive] <= room]
        if len(kept) == len(alive):
            break
        alive = kept
    if not len(alive):
        return []
    cut = np.flatnonzero(np.diff(alive) != 1) + 1
    first, last = alive[np.concatenate([[0], cut])], alive[np.concatenate([cut - 1, [len(alive) - 1]])] + 1
    limit = np.minimum(text_end[first], last + (last - first) // (TIMES - 1))
    return list(zip(first.tolist(), last.tolist(), limit.tolist()))


def runs_by_text(texts: list[bytes]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words of each text, and its runs by start, then period."""
    words = [t.split() for t in texts]
    flat = [w for ws in words for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ends = np.cumsum([len(ws) for ws in words])
    numbers = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, last, limit in stretches(numbers, ends) if flat else []:
        text = int(np.searchsorted(ends, first, "right"))
        base = first - (int(ends[text - 1]) if text else 0)
        # a run that starts past the stretch belongs to a later one, and may be cut off here
        found[text] += sorted((base + s, n, q) for s, n, q in runs_of(numbers[first:limit].tolist()) if first + s < last)
    return words, [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", rest: str = "collapsed") -> DataFrame:
    """``docs`` without its text, with ``runs`` (start, length, period in words, by start, then period) and ``collapsed``, the text less its repetitions.

    Words are parted by ASCII white space and numbered from 0; words are equal if their bytes are. One pass without a shuffle: a row depends on its own text,
    so repeated rows and ties need no rule and an empty table stays empty. Null and empty texts have no runs and an empty rest. A text of any
    length is taken whole; a task holds 4 MB of texts, or one longer one. Other columns pass through, one named like a result is replaced by it.
    """
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, runs, rest)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(runs, T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField(rest, T.StringType())])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, size=4 << 20):
            words, found = runs_by_text([(t or "").encode() for t in piece.column(piece.schema.get_field_index(text)).to_pylist()])
            as_rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
            left = pa.array([collapsed(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(n)) for n in names), pa.array(as_rows, run_type), left], names=[*names, runs, rest])

    return docs.select(*names, text).mapInArrow(run, schema)


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null where there is none."""
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a made repetition in about a tenth of the texts, drawn by h = crc32 of the id (h % 10 = 0; null: none): with g = h div 10 and n words, from word
    a = g % n on the next 1 + (n - a) div (3 + g % 8) words follow each other again and again to the end."""
    h = F.crc32(F.col(doc_id).cast("string"))

    def again(x: Column) -> Column:
        n = F.size(x["words"]).cast("long")
        a = x["g"] % n
        period = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        at = F.transform(F.array(F.struct(x["words"].alias("words"), a.alias("a"), period.alias("period"), n.alias("n"))), lambda y: F.transform(
            F.sequence(F.lit(0).cast("long"), y["n"] - 1), lambda i: F.get(y["words"], F.when(i < y["a"], i).otherwise(y["a"] + (i - y["a"]) % y["period"]).cast("int"))))
        return F.when(n > 0, F.array_join(F.get(at, 0), " ")).otherwise("")

    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.get(F.transform(F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g"))), again), 0)
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), made).otherwise(F.col(text)))
