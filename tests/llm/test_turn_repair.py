"""Repairs against a search over all edits, with conversations cut in blocks of every size, and against the SQL twin."""

import heapq
import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from cohera.llm.registry import SQL, table
from cohera.llm.turn_repair import TYPES, cheapest, combine, damage, parse, repair
from tests.conftest import SF

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def search(kinds):
    """Dijkstra over (turn, state) with (cost, audit) labels, an edit at a time."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(kinds) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in "ua":
            if (q, role) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[q, role]))
        if i < len(kinds):
            c, late = kinds[i], 3 * kinds[i].isupper()
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if c not in "bd":
                if (q, c.lower()) in NEXT:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, NEXT[q, c.lower()]))
                for role in "ua":
                    if (q, role) in NEXT:
                        heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, NEXT[q, role]))


def whole(rows):
    """Report of one conversation's rows (turn, role, text), after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, seen = "", set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        letter = role[:1] if role[:1] in ("u", "a", "s") else "o"
        kinds += "b" if not body else "d" if (role, text) in seen else letter if body[-1] in ".!?" else letter.upper()
        seen.add((role, text))
    cost, audit = search(kinds)
    turns, i, n = [], 0, len(audit.replace("D", ""))
    for e in audit:
        role = ("user", "assistant")[(len(turns) + n) % 2]
        if e != "D":
            turns.append((rows[i][1] if e == "K" else role, "" if e == "I" else rows[i][2]))
        i += e != "I"
    at = {t for t, _, _ in rows if t is not None}
    first = [r[1][:1] for r in rows]
    bad = sum(a + b not in ("su", "ua", "au") or not (a and b) for a, b in zip(first, first[1:]))
    gaps = max(at) - min(at) + 1 - len(at) if at else 0
    text = "\n".join(f"{r}:{x}" for r, x in turns)
    return (gaps, kinds.count("b"), kinds.count("d"), sum(c.isupper() for c in kinds), bad, cost, audit, sha256(text.encode()).hexdigest()), turns


def hurt(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if what == 1:
        text = ""
    if what == 2:
        text = "".join(c for c in text if c not in ".!?")
    return [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)


def expected(rows, damaged):
    groups = {}
    for conv, *r in rows:
        groups.setdefault(conv, []).extend(hurt(conv, *r) if damaged else [tuple(r)])
    return {c: whole(r) for c, r in groups.items()}


def got(out):
    reports = {r[0]: tuple(r)[1:] for r in out.reports.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    turns = {}
    for r in sorted(out.turns.collect(), key=lambda r: r.block):
        turns.setdefault(r.conv, []).extend((t.role, t.text) for t in r.turns)
    return {c: (reports[c], turns.get(c, [])) for c in reports}


RNG = random.Random(3)
TEXTS = ["Yes.", "No!", "cut off", "", " \t\n", "Why?", "x.\n ", "é", " ", None]


def _rows(conv, n, roles):
    return [(conv, RNG.choice([i, i, i, i + 1, None]), RNG.choice(roles), RNG.choice(TEXTS)) for i in range(n)]


ROWS = [r for c in range(40) for r in _rows(c, RNG.randrange(1, 14), ["user", "assistant", "system", "tool", "", None])]
ROWS += [(100, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(70)] + [(None, 1, "user", "Hi."), (None, 2, "user", "Hi."), (101, None, None, None)]
ROWS += [(102, 5, "user", "Same.")] * 9 + [(103, 0, "u" * 3, "word " * 50_000 + "."), (103, 9, "a", "b.")]


@pytest.mark.parametrize("seed", range(4))
def test_parse_against_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        kinds = "".join(rng.choice("uaUAsSobd"[: rng.choice([2, 4, 9])]) for _ in range(rng.randrange(0, 13)))
        want = search(kinds)
        assert cheapest(parse(kinds)) == want
        cut = sorted({0, len(kinds), *(rng.randrange(0, len(kinds) + 1) for _ in range(3))})
        parts = [parse(kinds[a:b], block=True) for a, b in zip(cut, cut[1:])] or [parse("", block=True)]
        assert cheapest(combine(parts)) == want
        assert combine(parts) == parse(kinds, block=True)
    assert len(parse("ua", block=True)) == len(TYPES)


def test_a_long_conversation():
    rng = random.Random(9)
    kinds = "".join(rng.choice("uaUAo") for _ in range(120))
    assert cheapest(parse(kinds)) == search(kinds)


@pytest.mark.parametrize("block", [64, 5])
def test_repair_against_search(spark, block):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, conv string, cost int").repartition(5)
    assert got(repair(df, block=block)) == expected(ROWS, False)
    assert got(repair(df, damaged=damage, block=block)) == expected(ROWS, True)


def test_blocks_over_many_levels(spark, monkeypatch):
    import cohera.llm.turn_repair as m

    monkeypatch.setattr(m, "FAN", 2)
    rows = [(1, i, RNG.choice(["user", "assistant"]), RNG.choice(TEXTS[:4]) and f"{i % 30}.") for i in range(60)] + _rows(2, 30, ["user", "system"])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got(repair(df, block=3)) == expected(rows, False)


def test_table_and_sql(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    want = expected(rows, True)
    assert got(repair(table(spark, SF, "conversations"), damaged=damage)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.execute(SQL["op11_turn_repair"]).fetchall()} == {c: r for c, (r, _) in want.items()}


def test_nothing(spark):
    assert got(repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == {}
    with pytest.raises(ValueError):
        repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), block=10_000)
