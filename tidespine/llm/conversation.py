"""Conversation structure repair: the cheapest edits that make a conversation an optional system message and then user and assistant in turn.

Four states tell what was said last: nothing, system, user, assistant. Hirschberg's divide and conquer finds the edits: forward and backward vectors of
four costs meet in the middle of the rows, the optimal crossing with the least audit is chosen, and both halves are solved alone, so a solver holds two
vectors and the crossings, never a table of back-pointers. Two cheapest paths to different states have different audits of which none begins the
other, so the four audits of a forward vector are told apart by their order alone, and no audit is carried along.

A conversation may be as long as the table. Its rows are sorted by range, cut into blocks, and each block is reduced to one 4 x 4 table of costs
and audit orders; blocks of blocks likewise, up to one table. Crossings are then chosen from the top down, by the same solver.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidespine.llm.common import ship, stored

#: Costs of the edits, initials of the roles by class, and what a message is expected to say after each state.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
#: Inserts that end a conversation, by state.
TAIL = {START: "", SYSTEM: "IuIa", USER: "Ia", ASSISTANT: ""}
NEVER = 1 << 60
#: Rows of a leaf block, and blocks of a higher one: what a task holds of one conversation.
BLOCK, FAN = 1 << 14, 1 << 10

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs of the four states, and their order by least audit
Table = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]  # the same from each state


def row_steps(code: str) -> list[dict[int, tuple[int, str]]]:
    """For each state before a row, the states after it, with cost and edits: letter and role initial of each, ``-`` for none.

    A code is a letter: four for each of (whole, truncated, to be deleted), in the order of initials s, u, a, other.
    """
    kind, status = (ord(code) - 97) % 4, (ord(code) - 97) // 4
    out: list[dict[int, tuple[int, str]]] = []
    for start in range(4):
        found: dict[int, tuple[int, str]] = {}
        at, cost, edits = start, 0, ""
        for _ in range(3):
            due, role = DUE[at]
            ways = [(at, cost + DELETE, edits + "D-")]
            if status < 2:
                extra = TRUNCATED if status else 0
                ways.append((due, cost + REROLE + extra, edits + "R" + role))
                if kind == 0 and at == START:
                    ways.append((SYSTEM, cost + extra, edits + "Ks"))
                elif kind in (1, 2) and due == kind + 1:
                    ways.append((due, cost + extra, edits + "K" + role))
            for to, c, e in ways:
                found[to] = min(found.get(to, (NEVER, "")), (c, e))
            at, cost, edits = due, cost + INSERT, edits + "I" + role
        out.append(found)
    return out


STEPS = {c: row_steps(c) for c in "abcdefghijkl"}


def _ranked(order: dict[int, tuple]) -> tuple[int, ...]:
    rank = {s: i for i, s in enumerate(sorted(order, key=order.get))}
    return tuple(rank.get(s, 0) for s in range(4))


#: The edits are compared by their letters; roles follow from letters, so pairs of both compare alike.
LEAF: dict[str, Table] = {c: (tuple(tuple(found[e][0] if e in found else NEVER for e in range(4)) for found in steps),
                              tuple(_ranked({e: (found[e][1],) for e in found}) for found in steps)) for c, steps in STEPS.items()}


def from_state(s: int) -> Vector:
    return tuple(0 if x == s else NEVER for x in range(4)), (0, 0, 0, 0)


def ahead(vector: Vector, table: Table) -> Vector:
    """The vector after a table's rows: least cost, then least audit."""
    (cost, rank), (costs, ranks) = vector, table
    best = {}
    for e in range(4):
        ways = [(cost[s] + costs[s][e], rank[s], ranks[s][e]) for s in range(4) if cost[s] < NEVER and costs[s][e] < NEVER]
        if ways:
            best[e] = min(ways)
    return tuple(best[e][0] if e in best else NEVER for e in range(4)), _ranked({e: w[1:] for e, w in best.items()})


def back(cost: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """Costs from before a table's rows to the end, from those after them."""
    return tuple(min(NEVER, min(c + x for c, x in zip(row, cost))) for row in table[0])


class RowTables(Sequence):
    """Tables of the rows of a block, by code. Vectors less their least cost are few, so steps are looked up."""

    ahead_of: dict[tuple[Vector, str], tuple[int, Vector]] = {}
    back_of: dict[tuple[tuple[int, ...], str], tuple[int, tuple[int, ...]]] = {}

    def __init__(self, codes: str):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, i):
        return LEAF[self.codes[i]]

    def forward(self, lo: int, hi: int, vector: Vector) -> Vector:
        base, known = 0, self.ahead_of
        for c in self.codes[lo:hi]:
            step = known.get((vector, c))
            if step is None:
                step = known[vector, c] = _levelled(ahead(vector, LEAF[c]))
            base, vector = base + step[0], step[1]
        return tuple(min(NEVER, x + base) for x in vector[0]), vector[1]

    def backward(self, lo: int, hi: int, cost: tuple[int, ...]) -> tuple[int, ...]:
        base, known = 0, self.back_of
        for c in reversed(self.codes[lo:hi]):
            step = known.get((cost, c))
            if step is None:
                low, (level, _) = _levelled((back(cost, LEAF[c]), ()))
                step = known[cost, c] = low, level
            base, cost = base + step[0], step[1]
        return tuple(min(NEVER, x + base) for x in cost)


def _levelled(vector: Vector) -> tuple[int, Vector]:
    low = min(vector[0])
    return low, (tuple(x - low if x < NEVER else NEVER for x in vector[0]), vector[1])


class BlockTables(Sequence):
    """Tables of the blocks of a larger block, each 16 costs and 16 orders."""

    def __init__(self, flat: Sequence[Sequence[int]]):
        four = lambda x: tuple(tuple(map(int, x[i:i + 4])) for i in (0, 4, 8, 12))
        self.tables = [(four(x[:16]), four(x[16:])) for x in flat]

    def __len__(self) -> int:
        return len(self.tables)

    def __getitem__(self, i):
        return self.tables[i]

    def forward(self, lo: int, hi: int, vector: Vector) -> Vector:
        for t in self.tables[lo:hi]:
            vector = ahead(vector, t)
        return vector

    def backward(self, lo: int, hi: int, cost: tuple[int, ...]) -> tuple[int, ...]:
        for t in reversed(self.tables[lo:hi]):
            cost = back(cost, t)
        return cost


def table_of(parts: RowTables | BlockTables) -> list[int]:
    """One table for all parts: 16 costs, then 16 orders."""
    vectors = [parts.forward(0, len(parts), from_state(s)) for s in range(4)]
    return [x for v in vectors for x in v[0]] + [x for v in vectors for x in v[1]]


def crossings(parts: RowTables | BlockTables, start: int, end: int | None) -> list[int]:
    """The state after each part of the cheapest path with the least audit, from ``start`` to ``end`` (None: to any legal end)."""
    if end is None:
        cost, rank = parts.forward(0, len(parts), from_state(start))
        end = min((cost[s] + INSERT * (len(TAIL[s]) // 2), rank[s], s) for s in range(4))[2]
    out, open_ = [0] * len(parts), [(0, len(parts), start, end)]
    while open_:
        lo, hi, s, e = open_.pop()
        if hi - lo == 1:
            out[lo] = e
            continue
        mid = (lo + hi) // 2
        cost, rank = parts.forward(lo, mid, from_state(s))
        rest = parts.backward(mid, hi, from_state(e)[0])
        crossing = min((cost[x] + rest[x], rank[x], x) for x in range(4))[2]
        open_ += [(lo, mid, s, crossing), (mid, hi, crossing, e)]
    return out


def block_edits(codes: str, start: int, end: int | None, last: bool) -> tuple[list[str], int]:
    """Edits of each row of a block, and their cost; the last block of a conversation ends with what it lacks."""
    after = crossings(RowTables(codes), start, end)
    ways = [STEPS[c][s][e] for c, s, e in zip(codes, [start, *after], after)]
    edits, cost = [w[1] for w in ways], sum(w[0] for w in ways)
    if last:
        edits[-1] += TAIL[after[-1]]
        cost += INSERT * (len(TAIL[after[-1]]) // 2)
    return edits, cost


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after a made fault, by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, cut of its sentence ends,
    said twice, or given to the user; nulls of role and text are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place): every row, places ascending by conversation, turn (nulls first), role and hash of the text.

    Rows are dealt into ranges, so a conversation of any size is spread over tasks; rows alike in all are told apart by their place in the input.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("input"))
    key = ["conv_id", "turn", "role", F.xxhash64("text"), "input"]
    rows = stored(rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("input").withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # as many rows as parts
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = rows.withColumn("part", part).join(F.broadcast(before), "part")
    return rows.select("conv_id", "turn", "role", "text", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def examined(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, fault, code) of the rows of ``in_order``; the first of blank, duplicate and truncated counts, null is none.

    The first row of each (conversation, role, text) is a minimum that is combined before the shuffle; it is joined back by its place, a key without copies.
    """
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    short = rows.select("conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), (seen == "").alias("empty"), F.substring(seen, -1, 1).isin(".", "!", "?").alias("ended"))
    fault = F.when(F.col("empty"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")) * F.sign(F.length("initial")), F.lit(0.0)), F.lit(4.0)).cast("int") - 1
    status = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    judged = short.join(first, "place", "left").withColumn("fault", fault).withColumn("code", F.char(97 + kind + 4 * status))
    return stored(judged.select("conv_id", "turn", "place", "fault", "code"), "conversation-faults")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def solved(faults: DataFrame) -> DataFrame:
    """(conv_id, block, places, codes, edits, cost): the edits of each row, by blocks of at most ``BLOCK`` rows of one conversation."""
    spark = faults.sparkSession
    ship(spark)
    block = F.floor(F.col("place") / BLOCK).cast("long")
    rows = F.array_sort(F.collect_list(F.struct("place", "code")))
    leaves = faults.groupBy("conv_id", block.alias("block")).agg(rows.alias("rows"))
    leaves = stored(leaves.select("conv_id", "block", F.col("rows.place").alias("places"), F.array_join("rows.code", "").alias("codes")), "conversation-blocks")
    blocks = leaves.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("least"))
    alone = blocks.where("n = 1").select(F.col("conv_id").alias("conv"), F.col("least").alias("node"), F.lit(START).alias("start"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("last"))
    many = stored(blocks.where("n > 1").select(F.col("conv_id").alias("conv")), "long-conversations")
    ends = alone if many.isEmpty() else alone.union(block_ends(leaves.join(many, same(F.col("conv_id"), F.col("conv")), "left_semi")))
    names = leaves.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, start, end, last = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            found = [block_edits(*x) for x in zip(codes, start, end, last)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.int64())],
                                             names=[*names, "edits", "cost"])

    placed = leaves.join(ends, same(F.col("conv_id"), F.col("conv")) & (F.col("block") == F.col("node"))).select(*names, "start", "end", "last")
    schema = T.StructType([*leaves.schema.fields, T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("cost", T.LongType())])
    return stored(placed.mapInArrow(run, schema), "conversation-edits")


def block_ends(leaves: DataFrame) -> DataFrame:
    """(conv, node, start, end, last): the states before and after each block of conversations of several blocks."""
    @F.pandas_udf("array<long>")
    def of_codes(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: table_of(RowTables(c)))

    @F.pandas_udf("array<long>")
    def of_tables(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: table_of(BlockTables(t)))

    @F.pandas_udf("array<int>")
    def states(tables: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[s, *crossings(BlockTables(t), s, None if pd.isna(e) else int(e))] for t, s, e in zip(tables, start, end)])

    nodes, levels = leaves.select("conv_id", F.col("block").alias("node"), of_codes("codes").alias("table")), []
    while True:
        parent = F.floor(F.col("node") / FAN).cast("long")
        level = nodes.groupBy("conv_id", parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "table"))).alias("parts"))
        levels.append(stored(level, "conversation-levels"))
        if levels[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
            break
        nodes = levels[-1].select("conv_id", F.col("parent").alias("node"), of_tables("parts.table").alias("table"))
    ends = levels[-1].select(F.col("conv_id").alias("conv"), F.col("parent").alias("node"), F.lit(START).alias("start"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("last"))
    for level in reversed(levels):
        met = level.join(ends, same(F.col("conv_id"), F.col("conv")) & (F.col("parent") == F.col("node"))).select("conv_id", "parts", "last", states("parts.table", "start", "end").alias("states"))
        part = met.select("conv_id", "last", "states", F.size("parts").alias("n"), F.posexplode("parts.node").alias("i", "child"))
        ends = part.select(F.col("conv_id").alias("conv"), F.col("child").alias("node"), F.get("states", F.col("i")).alias("start"), F.get("states", F.col("i") + 1).alias("end"),
                           (F.col("last") & (F.col("i") == F.col("n") - 1)).alias("last"))
    return ends


def audits(blocks: DataFrame) -> DataFrame:
    """(conv_id, audit, cost): the initials of all edits in order, and their cost."""
    letters = F.array_join(F.transform("edits", lambda e: F.regexp_replace(e, "(.).", "$1")), "")
    parts = F.array_sort(F.collect_list(F.struct("block", letters.alias("audit"))))
    return blocks.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"), F.sum("cost").alias("cost"))


def illegal_pairs(blocks: DataFrame) -> DataFrame:
    """(conv_id, illegal): neighbouring rows whose role initials are not su, ua or au. Where blocks meet, the next block of the conversation is joined."""
    kinds = F.translate("codes", "abcdefghijkl", "suaxsuaxsuax")
    b = blocks.select("conv_id", "block", kinds.alias("kinds"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("kinds")), lambda i: F.substring(F.col("kinds"), i, F.lit(2)))
    inside = b.select("conv_id", F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"))
    after = b.select(F.col("conv_id").alias("conv"), (F.col("block") - 1).alias("before"), F.substring("kinds", 1, 1).alias("first"))
    met = b.join(after, same(F.col("conv_id"), F.col("conv")) & (F.col("block") == F.col("before")))
    between = met.select("conv_id", (~F.concat(F.substring("kinds", -1, 1), "first").isin("su", "ua", "au")).cast("long").alias("illegal"))
    return inside.union(between).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))


def repaired(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, place, n, role, text): the messages after repair, in order of place and n. Each row meets its edits by place, a key without copies."""
    edits = blocks.select(F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("edits").alias("edits"))).alias("x")).select("x.place", "x.edits")
    made = F.transform(F.sequence(F.lit(1), F.length("edits"), F.lit(2)), lambda i: F.substring(F.col("edits"), i, F.lit(2)))
    each = rows.join(edits, "place").select("conv_id", "place", "role", "text", F.posexplode(made).alias("n", "edit")).where("edit not like 'D%'")
    given = F.when(F.substring("edit", 2, 1) == "u", ROLES["u"]).otherwise(ROLES["a"])
    return each.select("conv_id", "place", "n", F.when(F.col("edit").startswith("K"), F.col("role")).otherwise(given).alias("role"),
                       F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text")).alias("text"))


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines in order. A SHA-256 is sequential: a conversation streams through one task, which holds its hash state only."""
    schema = T.StructType([messages.schema["conv_id"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashed = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                line = f"{role}:{text}".encode()
                if hashed is None or conv != held:
                    if hashed is not None:
                        out.append((held, hashed.hexdigest()))
                    held, hashed = conv, hashlib.sha256(line)
                else:
                    hashed.update(b"\n" + line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "sha256"])
            kind = batch.schema.field(0).type
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([hashed.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "place", "n").mapInArrow(run, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired messages, one row of figures for each conversation) of a table with conv_id, turn, role and text; other columns are not read.

    Messages: conv_id, place, n, role, text, in order of (place, n); an inserted message has an empty text. Figures: gaps in the turns, rows by
    fault, illegal neighbours, cost, audit. Null roles and texts are one space, a null conv_id is a conversation like any other, null turns come first
    and have no part in gaps. A role whose initial is not s, u or a, or that is empty, cannot be kept. Rows alike in turn stand in the order of role and
    hash of the text; of rows alike in role and text all but the first are duplicates. Texts of any length are taken whole, an empty table gives
    two empty ones.
    """
    rows = in_order(conversations)
    faults = examined(rows)
    blocks = solved(faults)
    turns = faults.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = faults.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in FAULTS))
    return repaired(rows, blocks), figures(turns, counts, illegal_pairs(blocks), audits(blocks))


def figures(*parts: DataFrame) -> DataFrame:
    """One row for each conv_id, null among them, with the columns of all parts, which have one row each at most."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in whole.columns if c != "conv_id"))
