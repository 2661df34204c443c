import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidespine.llm import conversation as C
from tidespine.llm.queries import QUERIES

COLUMNS = ["conv_id", "turn", "role", "text"]
SCHEMA = "conv_id long, turn long, role string, text string"


def space(x):
    return " " if x is None else x


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text, kind = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_faults(rows):
    """Fault of each row of one conversation, in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_best(rows, faults):
    """Least (cost, audit, messages) by a plain table over (rows used, initials given)."""
    last = {"": (0, "", ())}  # what was said: "", s, u, a
    follow = lambda said: {"": "u", "s": "u", "u": "a", "a": "u"}[said]
    name = {"u": "user", "a": "assistant"}

    def inserted(held):
        for _ in range(3):
            for said, (cost, audit, msgs) in list(held.items()):
                way = cost + 2, audit + "I", msgs + ((name[follow(said)], ""),)
                held[follow(said)] = min(held.get(follow(said), (10**9,)), way)
        return held

    for (_, _, role, text), fault in zip(rows, faults):
        nxt = {}

        def offer(said, way):
            nxt[said] = min(nxt.get(said, (10**9,)), way)
        for said, (cost, audit, msgs) in inserted(last).items():
            offer(said, (cost + 3, audit + "D", msgs))
            if fault in ("blank", "duplicate"):
                continue
            extra, due = int(fault == "truncated"), follow(said)
            offer(due, (cost + 2 + extra, audit + "R", msgs + ((name[due], text),)))
            if role[:1] == due:
                offer(due, (cost + extra, audit + "K", msgs + ((role, text),)))
            if role[:1] == "s" and not said:
                offer("s", (cost + extra, audit + "K", msgs + ((role, text),)))
        last = nxt
    return min(w for said, w in inserted(last).items() if said in ("", "a"))


def brute_rows(rows):
    """Result rows of damaged ``rows`` by conversation, in the operator's order of ties as given."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        faults = brute_faults(own)
        cost, audit, msgs = brute_best(own, faults)
        turns = {r[1] for r in own if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in msgs).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in C.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    found = brute_rows(brute_damage(rows))
    return {c: found.get(c, (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())) for c in {r[0] for r in rows}}


def as_dict(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def with_digests(messages, found):
    sha = {r.conv_id: r.sha256 for r in C.digests(messages).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in found.collect()}


def some_rows(rnd, convs, most):
    texts = ["Yes.", "No!", "cut", " ", "", None, "So?  \n", "Yes.", "x.\x0b", "two\nlines."]
    rows = []
    for c in convs:
        turns = sorted(rnd.sample(range(2 * most), rnd.randrange(1, most)))
        rows += [(c, t, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]), rnd.choice(texts) if rnd.random() < 0.5 else f"text {t} {c}.") for t in turns]
        if rnd.random() < 0.2:
            rows.append((c, None, "user", "no turn."))
    return rows


def test_solver_against_every_way_of_four_rows():
    # every sequence of edits, not a table: least cost, then least audit
    def ways(codes, said=C.START):
        if not codes:
            t = C.TAIL[said]
            yield C.INSERT * len(t) // 2, t[::2]
            return
        for ins in range(3):
            at = said
            for _ in range(ins):
                at = C.DUE[at][0]
            for letter, cost, to in edits(codes[0], at):
                for c, a in ways(codes[1:], to):
                    yield 2 * ins + cost + c, "I" * ins + letter + a

    def edits(code, at):
        kind, status = (ord(code) - 97) % 4, (ord(code) - 97) // 4
        yield "D", 3, at
        if status < 2:
            due = C.DUE[at][0]
            yield "R", 2 + status, due
            if kind < 3 and (kind + 1 == due or kind == 0 and at == C.START):
                yield "K", status, kind + 1

    for n, letters in ((1, "abcdefghijkl"), (2, "abcdefghl"), (3, "abcefil"), (4, "abcei")):
        for codes in itertools.product(letters, repeat=n):
            found, cost = C.block_edits("".join(codes), C.START, None, True)
            assert (cost, "".join(found)[::2]) == min(ways(codes)), codes


def test_blocks_of_blocks_equal_one_solution():
    rnd = random.Random(3)
    for _ in range(200):
        codes = "".join(rnd.choice("aabbbccdefgil") for _ in range(rnd.randrange(2, 60)))
        whole, cost = C.block_edits(codes, C.START, None, True)
        cuts = sorted(rnd.sample(range(1, len(codes)), rnd.randrange(1, min(6, len(codes)))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        ends = C.crossings(C.BlockTables([C.table_of(C.RowTables(p)) for p in parts]), C.START, None)
        got = [C.block_edits(p, s, e, i == len(parts) - 1) for i, (p, s, e) in enumerate(zip(parts, [C.START, *ends], ends))]
        assert ([e for g in got for e in g[0]], sum(g[1] for g in got)) == (whole, cost)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 5)
    monkeypatch.setattr(C, "FAN", 2)


@pytest.mark.parametrize("cut", [False, True])
def test_query_against_brute_force(spark, tmp_path, cut, request):
    if cut:
        request.getfixturevalue("small")
    rnd = random.Random(7)
    rows = some_rows(rnd, [*range(60), None], 12) + some_rows(rnd, [99], 60)
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", code int, place string").repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert as_dict(got) == expected(rows)


def test_one_conversation_holds_most_rows(spark, small):
    rnd = random.Random(9)
    rows = some_rows(rnd, [1], 400) + some_rows(rnd, [2, 3], 5)
    rows = [(c, t, space(r), space(x)) for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))]
    messages, found = C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want = brute_rows(rows)
    assert with_digests(messages, found) == want


def test_ties_and_empty_table(spark):
    alike = [(1, 0, "user", "Same.")] * 4 + [(1, 0, "assistant", "Same.")] * 2
    messages, found = C.repair(spark.createDataFrame(alike, SCHEMA))
    assert with_digests(messages, found) == brute_rows(sorted(alike, key=lambda r: r[2]))
    assert found.first().duplicate == 4
    messages, found = C.repair(spark.createDataFrame([], SCHEMA))
    assert messages.collect() == found.collect() == []


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(*COLUMNS).collect()]
    assert as_dict(QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001")) == expected(rows)
