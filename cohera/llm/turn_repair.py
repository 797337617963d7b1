"""Repair of conversation structure by weighted interval parsing.

A repair keeps, reroles, deletes or inserts turns until the roles read ``(s?(ua)+)?``. Which repair is cheapest is a parse
of the turns under a grammar in Chomsky normal form, worked out for all spans, shorter spans first:

    E    -> D E | D                     deleted turns only, D one turn
    U    -> E u | u,  A -> E a | a      the next user or assistant turn with the deleted turns before it
    Pair -> U A,      UA -> Pair UA | Pair
    UU   -> UA U | U                    and, for blocks of long conversations, AA -> A UA | A,  AU -> A UU,
    S    -> E s | s,  SU -> S UU,  SA -> S UA      and each of these with deleted turns after it

A cell holds the least (cost, audit), the audit being the initials of the edits. ``u`` and ``a`` also derive the empty span
as an inserted turn, so U, A, Pair and UA have cells over empty spans and every split of a span includes its two ends:
that closes the table under insertion. Of equal costs the audit that is least in ASCII wins; audits of one cell with
equal costs are never prefixes of each other (they would differ by inserted turns, which cost), so least parts make the
least whole.

Conversations of at most ``BLOCK`` turns and ``BLOCK_BYTES`` are bounded groups. Longer ones are cut into blocks over all
tasks; a block's cells say how its repaired turns begin and end, and adjacent blocks are combined, shorter spans first,
``FAN`` at a time, until a conversation is one span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 64  # turns parsed as one table of spans
BLOCK_BYTES = 4 << 20
FAN = 64  # blocks combined in one step
MEMORY = 50_000  # parses that a worker process keeps, for all its tasks
TASK_TURNS = 4_096  # turns of long conversations in a task: parsing takes long for their bytes
BLANK = " \t\n\x0b\x0c\r"
NONE = 1 << 40  # the cost of what can't be derived
ROLES = {"u": "user", "a": "assistant"}
#: What a block's repaired turns begin and end with; all that can follow each other are ua, au and su.
TYPES = ("", "ua", "uu", "aa", "au", "ss", "su", "sa")
FOLLOW = {("u", "a"), ("a", "u"), ("s", "u")}
NOTHING = sha256(b"").hexdigest()


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str


def kinds_of(rows: list[Turn], duplicate: list[bool] | None = None) -> str:
    """A letter per turn: u, a, s, o by the role's initial, upper case if truncated; b blank and d duplicate."""
    out, seen = [], set()
    for i, r in enumerate(rows):
        text = r.text.rstrip(BLANK)
        again = duplicate[i] if duplicate is not None else (r.role, r.text) in seen
        if duplicate is None:
            seen.add((r.role, r.text))
        if not text:
            out.append("b")
        elif again:
            out.append("d")
        else:
            letter = r.role[:1] if r.role[:1] in ("u", "a", "s") else "o"
            out.append(letter if text[-1] in ".!?" else letter.upper())
    return "".join(out)


def _row_costs(kinds: str, role: str) -> list[tuple[int, str]]:
    """Cost and edit of taking each turn as a turn of ``role``."""
    out = []
    for c in kinds:
        late = TRUNCATED if c.isupper() else 0
        if c in "bd" or (role == "s" and c.lower() != "s"):
            out.append((NONE, ""))
        else:
            out.append((late, "K") if c.lower() == role else (late + REROLE, "R"))
    return out


class Table:
    """Cells of one nonterminal over the spans (i, j) of a conversation, i <= j."""

    def __init__(self, n: int):
        self.cost = np.full((n + 1, n + 1), NONE, dtype=np.int64)  # by start and length
        self.by_end = np.full((n + 1, n + 1), NONE, dtype=np.int64)  # by end and length
        self.audit: list[list[str]] = [[""] * (n + 1 - i) for i in range(n + 1)]  # by start and length

    def put(self, start: int, length: int, cost: int, audit: str) -> None:
        self.cost[start, length] = self.by_end[start + length, length] = cost
        self.audit[start][length] = audit


def _next_turn(n: int, rows: list[tuple[int, str]], inserted: bool) -> Table:
    """Deleted turns, then one turn: the last of the span, or an inserted one."""
    t = Table(n)
    for i in range(n + 1):
        for m in range(n + 1 - i):
            best = (DELETE * m + INSERT, "D" * m + "I") if inserted else (NONE, "")
            if m and rows[i + m - 1][0] < NONE:
                cost, edit = rows[i + m - 1]
                best = min(best, (DELETE * (m - 1) + cost, "D" * (m - 1) + edit))
            t.put(i, m, *best)
    return t


def _join(out: Table, left: Table, right: Table, length: int, starts: range, alone: Table | None = None) -> None:
    """Cells of ``out`` over all spans of a length: the least over all splits, both ends included, or ``alone``.

    Parts of ``out`` itself are used only on shorter spans; over the whole span they are not yet known and cost NONE.
    """
    a, b = starts.start, starts.stop
    total = left.cost[a:b, : length + 1] + right.by_end[a + length : b + length, length::-1]
    if alone is not None:
        total = np.concatenate([total, alone.cost[a:b, length : length + 1]], axis=1)
    least = total.min(axis=1)
    where, split = np.nonzero((total == least[:, None]) & (least < NONE)[:, None])
    for i, k in zip((where + a).tolist(), split.tolist()):
        audit = alone.audit[i][length] if k > length else left.audit[i][k] + right.audit[i + k][length - k]
        if out.cost[i, length] == NONE or audit < out.audit[i][length]:
            out.put(i, length, int(least[i - a]), audit)


def parse(kinds: str, block: bool = False) -> list[tuple[int, str | None]]:
    """Least (cost, audit) of the turns for each of ``TYPES``; those not needed for a whole conversation only if ``block``."""
    n = len(kinds)
    user, assistant = _next_turn(n, _row_costs(kinds, "u"), True), _next_turn(n, _row_costs(kinds, "a"), True)
    pair, pairs, odd = Table(n), Table(n), Table(n)
    for m in range(n + 1):
        starts = range(n + 1 - m)
        _join(pair, user, assistant, m, starts)
        _join(pairs, pair, pairs, m, starts, alone=pair)
        if block:
            _join(odd, pairs, user, m, starts, alone=user)
    system = _next_turn(n, _row_costs(kinds, "s"), False)
    made = {"ua": pairs, "sa": Table(n)}
    if block:
        made |= {"uu": odd, "aa": Table(n), "au": Table(n), "ss": system, "su": Table(n)}
    for m in range(n + 1):
        _join(made["sa"], system, pairs, m, range(1))
        if block:
            _join(made["aa"], assistant, pairs, m, range(1), alone=assistant)
            _join(made["au"], assistant, odd, m, range(1))
            _join(made["su"], system, odd, m, range(1))
    out: list[tuple[int, str | None]] = [(DELETE * n, "D" * n)]
    for t in TYPES[1:]:
        ends = [(int(made[t].cost[0, k]) + DELETE * (n - k), made[t].audit[0][k] + "D" * (n - k)) for k in range(n + 1) if made[t].cost[0, k] < NONE] if t in made else []
        out.append(min(ends, default=(NONE, None)))
    return out


def combine(cells: Iterable[list[tuple[int, str | None]]]) -> list[tuple[int, str | None]]:
    """Cells of adjacent spans as the cells of the span over all of them."""
    cells = iter(cells)
    total = next(cells)
    for right in cells:
        best = {t: (NONE, None) for t in TYPES}
        for s, (c1, x) in zip(TYPES, total):
            for t, (c2, y) in zip(TYPES, right):
                if x is None or y is None or (s and t and (s[1], t[0]) not in FOLLOW):
                    continue
                kind = s[0] + t[1] if s and t else s or t
                old = best[kind]
                if c1 + c2 < old[0] or (c1 + c2 == old[0] and x + y < old[1]):
                    best[kind] = (c1 + c2, x + y)
        total = [best[t] for t in TYPES]
    return total


def cheapest(cells: list[tuple[int, str | None]]) -> tuple[int, str]:
    """The least of the cells that a whole conversation may be: nothing, ua, sa."""
    return min((cells[TYPES.index(t)] for t in ("", "ua", "sa") if cells[TYPES.index(t)][1] is not None))


@lru_cache(maxsize=MEMORY)
def best_parse(kinds: str) -> tuple[int, str]:
    return cheapest(parse(kinds))


def apply(rows: list[Turn], audit: str, position: int = 0, odd: bool | None = None) -> list[tuple[str, str]]:
    """Role and text of the repaired turns; ``position`` turns come before, ``odd`` says that a system turn is first."""
    if odd is None:
        odd = (len(audit) - audit.count("D")) % 2 == 1
    out, at = [], iter(rows)
    for edit in audit:
        role = "user" if (position + len(out) - odd) % 2 == 0 else "assistant"
        row = None if edit == "I" else next(at)
        if edit != "D":
            out.append((row.role if edit == "K" else role, "" if row is None else row.text))
    return out


def flat(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in turns)


def illegal_pairs(initials: list[str]) -> int:
    return sum((a, b) not in FOLLOW for a, b in zip(initials, initials[1:]))


class Damage(NamedTuple):
    role: Column
    text: Column
    copies: Column


def damage(conv: Column, turn: Column, role: Column, text: Column, every: int = 20) -> Damage:
    """The contract's damage by a checksum of conversation and turn: dropped, emptied, without ends, twice, other role."""
    key = F.concat(*(F.coalesce(c.cast("string"), F.lit(s)) for c, s in ((conv, " "), (F.lit(":"), ""), (turn, " "))))
    what = F.crc32(key.cast("binary")) % every
    return Damage(
        F.when(what == 4, F.lit("user")).otherwise(role),
        F.when(what == 1, F.lit("")).when(what == 2, F.translate(text, ".!?", "")).otherwise(text),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1),
    )


def undamaged(conv: Column, turn: Column, role: Column, text: Column) -> Damage:
    return Damage(role, text, F.lit(1))


class Repaired(NamedTuple):
    """``reports``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. ``turns``: conv, block
    (from 0), turns (role, text): the repaired conversations, long ones in several blocks."""

    reports: DataFrame
    turns: DataFrame


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "turns array<struct<role:string,text:string>>"
TURNS_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _counts(kinds: str) -> tuple[int, int, int]:
    return kinds.count("b"), kinds.count("d"), sum(c.isupper() for c in kinds)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, rows (turn, role, text in order) -> conv, the report, the repaired turns."""
    for batch in batches:
        reports, turns = [], []
        for rows in batch.column(1).to_pylist():
            rows = [Turn(r["turn"], r["role"], r["text"]) for r in rows]
            kinds = kinds_of(rows)
            cost, audit = best_parse(kinds)
            at = {r.turn for r in rows if r.turn is not None}
            repaired = apply(rows, audit)
            gaps = max(at) - min(at) + 1 - len(at) if at else 0
            reports.append((gaps, *_counts(kinds), illegal_pairs([r.role[:1] for r in rows]), cost, audit, sha256(flat(repaired).encode()).hexdigest()))
            turns.append([{"role": r, "text": t} for r, t in repaired])
        columns = list(zip(*reports)) or [()] * 8
        types = [pa.int64()] * 6 + [pa.string()] * 2
        names = [f.split()[0] for f in REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array(turns, TURNS_TYPE)], names=["conv", *names, "turns"])


CELLS = "blank long, duplicate long, truncated long, illegal long, first string, last string, n long, costs array<long>, audits array<string>"


def _blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (conv, turn, role, text, later) -> blocks with their cells and turns."""
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple[Turn, bool]] = []
        conv, room, before = None, 0, None

        def close() -> pa.RecordBatch:
            rows = [r for r, _ in held]
            kinds = kinds_of(rows, [d for _, d in held])
            cells = parse(kinds, block=True)
            initials = [r.role[:1] for r in rows]
            values = [
                conv, task, number, *_counts(kinds), illegal_pairs(initials), initials[0], initials[-1], len(rows), [c for c, _ in cells], [a for _, a in cells],
                [{"role": r.role, "text": r.text} for r in rows],
            ]
            held.clear()
            i, s = pa.int64(), pa.string()
            types = [conv_type, i, i, i, i, i, i, s, s, i, pa.list_(i), pa.list_(s), TURNS_TYPE]
            names = ["conv", "task", "number", *(f.split()[0] for f in CELLS.split(", ")), "turns"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for a in range(0, len(batch), BLOCK):  # rows become Python objects a few at a time
                for c, turn, role, text, later in zip(*(col.slice(a, BLOCK).to_pylist() for col in batch.columns)):
                    row = Turn(turn, role, text)
                    if held and (c != conv or len(held) >= block or room > BLOCK_BYTES):
                        yield close()
                        number, room = number + 1, 0
                    same = before is not None and c == conv and before == row
                    conv, before = c, row
                    held.append((row, later or same))
                    room += len(text)
        if held:
            yield close()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, up, parts (in order) -> conv, up, the cells of all parts."""
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            cells = combine([list(zip(p["costs"], p["audits"])) for p in parts])
            border = sum((a["last"], b["first"]) not in FOLLOW for a, b in zip(parts, parts[1:]))
            out.append((sum(p["illegal"] for p in parts) + border, parts[0]["first"], parts[-1]["last"], [c for c, _ in cells], [a for _, a in cells]))
        columns = list(zip(*out)) or [()] * 5
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv", "at", "illegal", "first", "last", "costs", "audits"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, costs, audits, sizes of its blocks -> conv, cost, audit, and each block's piece of the audit."""
    piece = pa.struct([("at", pa.int64()), ("audit", pa.string()), ("position", pa.int64()), ("odd", pa.bool_())])
    for batch in batches:
        costs, audits, pieces = [], [], []
        for c, a, sizes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            cost, audit = cheapest(list(zip(c, a)))
            odd = (len(audit) - audit.count("D")) % 2 == 1
            own, at, position = [], 0, 0
            for k, n in enumerate(sizes):
                end = at
                while n or (k == len(sizes) - 1 and end < len(audit)):  # inserted turns go with the next turn's block
                    n -= audit[end] != "I"
                    end += 1
                own.append({"at": k, "audit": audit[at:end], "position": position, "odd": odd})
                position += end - at - audit.count("D", at, end)
                at = end
            costs.append(cost), audits.append(audit), pieces.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(pieces, pa.list_(piece))], names=["conv", "cost", "audit", "pieces"])


def _repair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, turns, audit, position, odd -> conv, block, repaired turns."""
    for batch in batches:
        for i in range(len(batch)):
            conv, at, turns, audit, position, odd = (batch.column(k).slice(i, 1) for k in range(6))
            rows = [Turn(None, t["role"], t["text"]) for t in turns[0].as_py()]
            repaired = apply(rows, audit[0].as_py(), position[0].as_py(), odd[0].as_py())
            yield pa.RecordBatch.from_arrays([conv, at, pa.array([[{"role": r, "text": t} for r, t in repaired]], TURNS_TYPE)], names=["conv", "block", "turns"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order -> a digest per conversation; a task holds one running digest only."""
    conv, digest, kind = None, None, None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(len(batch)):
            c, turns = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if digest is None or c != conv:
                if digest is not None:
                    yield close()
                conv, digest, some = c, sha256(), False
            if turns:
                digest.update((("\n" if some else "") + flat([(t["role"], t["text"]) for t in turns])).encode())
                some = True
    if digest is not None:
        yield close()


def _long(rows: DataFrame, kind: str, block: int) -> Repaired:
    """Reports and turns of conversations that are more than a block."""
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = Stored(rows.select("conv", "turn", "role", "text", digest.alias("digest")), "turns-long")
    first = rows.df.groupBy("conv", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = Stored(first.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first"), "turns-first")
    marked = rows.df.join(first.df, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    marked = marked.select("conv", "turn", "role", "text", F.coalesce(order > F.col("first"), F.lit(False)).alias("later"))
    nulls = [F.asc_nulls_first(c) for c in ("conv", "turn", "role")]
    tasks = max(rows.spark.sparkContext.defaultParallelism, rows.df.count() // TASK_TURNS)
    dealt = marked.repartitionByRange(tasks, *nulls, F.substring("text", 1, 64)).sortWithinPartitions(*nulls, "text")
    blocks = Stored(dealt.mapInArrow(_blocks(block), f"conv {kind}, task long, number long, {CELLS}, {TURNS}"), "turn-blocks")
    place = (F.row_number().over(Window.partitionBy("conv").orderBy("task", "number")) - 1).cast("long")
    spans = Stored(blocks.df.drop("turns").withColumn("at", place), "turn-spans")
    total = spans.df.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda s: s["n"]).alias("sizes"),
    )
    fields = ["illegal", "first", "last", "costs", "audits"]
    level = Stored(spans.df.select("conv", "at", *fields), "turn-level")
    most = spans.df.agg(F.max("at")).first()[0] or 0
    schema = f"conv {kind}, at long, illegal long, first string, last string, costs array<long>, audits array<string>"
    while most > 0:
        parts = level.df.groupBy("conv", F.floor(F.col("at") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", *fields))).alias("parts"))
        above = Stored(parts.mapInArrow(_merge, schema), "turn-level")
        level.drop()
        level, most = above, most // FAN
    top = level.df.join(total.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    done = Stored(
        top.select("conv", "costs", "audits", "sizes").mapInArrow(_finish, f"conv {kind}, cost long, audit string, pieces array<struct<at:long,audit:string,position:long,odd:boolean>>"), "turn-audits",
    )
    pieces = done.df.select(F.col("conv").alias("c"), F.explode("pieces").alias("p"))
    pieces = spans.df.select("conv", "at", "task", "number").join(pieces, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("p.at"))).drop("conv", "c")
    both = blocks.df.select("conv", "task", "number", "turns").join(pieces, ["task", "number"])
    turns = Stored(both.select("conv", "at", "turns", "p.audit", "p.position", "p.odd").mapInArrow(_repair_blocks, f"conv {kind}, block long, {TURNS}"), "turns-repaired")
    digests = turns.df.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_digests, f"conv {kind}, repaired_sha256 string")
    gaps = rows.df.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    reports = done.df.select("conv", "cost", "audit")
    for i, more in enumerate((gaps, total.drop("sizes"), level.df.select("conv", "illegal"), digests)):
        reports = reports.join(more.withColumnRenamed("conv", f"c{i}"), F.col("conv").eqNullSafe(F.col(f"c{i}"))).drop(f"c{i}")
    return Repaired(reports, turns.df)


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damaged=undamaged, block: int = BLOCK,
) -> Repaired:
    """Cheapest repair of every conversation (see :class:`Repaired`).

    Turns are taken in the order of ``turn`` (nulls first), then role, then text. Null roles and texts are one space; an
    empty role has no initial, which is like any initial but u, a, s. A null conversation id is one conversation. Rows
    repeated are duplicates but for the first. A conversation without rows after damage has zeros, an empty audit and the
    digest of the empty string. Other columns are not looked at; an empty table gives no rows.
    """
    if block > BLOCK:
        raise ValueError(f"blocks hold at most {BLOCK} turns")
    conv, turn = F.col(conv_col), F.col(turn_col)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    d = damaged(conv, turn, role, text)
    rows = conversations.select(conv.alias("conv"), turn.cast("long").alias("turn"), d.role.alias("role"), d.text.alias("text"), d.copies.alias("copies"))
    kind = rows.schema["conv"].dataType.simpleString()
    size = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text").cast("long")).alias("bytes"))
    long = Stored(size.where((F.col("n") > block) | (F.col("bytes") > BLOCK_BYTES)).select(F.col("conv").alias("c")), "conversations-long")
    some = not long.df.isEmpty()
    which = F.col("conv").eqNullSafe(F.col("c"))
    short = rows.join(long.df, which, "left_anti") if some else rows
    turns = F.sort_array(F.flatten(F.collect_list(F.array_repeat(F.struct("turn", "role", "text"), F.col("copies"))))).alias("rows")
    done = short.groupBy("conv").agg(turns).mapInArrow(_short, f"conv {kind}, {REPORT}, {TURNS}")
    reports, repaired = done.drop("turns"), done.select("conv", F.lit(0).cast("long").alias("block"), "turns")
    if some:
        copies = rows.join(long.df, which, "left_semi").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        more = _long(copies.select("conv", "turn", "role", "text"), kind, block)
        reports, repaired = reports.unionByName(more.reports), repaired.unionByName(more.turns)
    return Repaired(reports, repaired)


#: The same repair as a search over turns from the front: per automaton state (start, after s, after u, after a) the least
#: cost and audit. Inserted turns before a row are written out; crc32 is folded over the bytes of the key.
SQL = """
WITH RECURSIVE bits(k, b, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT k, b + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE b < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM bits WHERE b = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS MATERIALIZED (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
  list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda h, x: xor(h >> 8, t[CAST(xor(h, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS what FROM raw, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN what = 0 THEN [] WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
rows AS MATERIALIZED (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faults AS MATERIALIZED (SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
  CASE WHEN blank OR duplicate THEN NULL WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS late FROM rows),
size AS (SELECT conv_id, max(i) AS n FROM faults GROUP BY 1),
-- s0 nothing yet, s1 after s, s2 after u, s3 after a; each a struct (cost, audit), closed under insertion after the row
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {'k': 0, 'a': ''}, {'k': NULL::INTEGER, 'a': NULL::VARCHAR}, {'k': 3, 'a': 'I'}, {'k': 6, 'a': 'II'} FROM size
  UNION ALL
  SELECT conv_id, i, s0, s1, least(r2, {'k': s0.k + 3, 'a': s0.a || 'I'}, {'k': s1.k + 3, 'a': s1.a || 'I'}, {'k': r3.k + 3, 'a': r3.a || 'I'}),
    least(r3, {'k': r2.k + 3, 'a': r2.a || 'I'}, {'k': s0.k + 6, 'a': s0.a || 'II'}, {'k': s1.k + 6, 'a': s1.a || 'II'}) FROM (
    SELECT w.conv_id, w.i + 1 AS i, {'k': s0.k + 4, 'a': s0.a || 'D'} AS s0,
      least(CASE WHEN s1.k IS NOT NULL THEN {'k': s1.k + 4, 'a': s1.a || 'D'} END, CASE WHEN f.c = 's' AND late IS NOT NULL THEN {'k': s0.k + late, 'a': s0.a || 'K'} END) AS s1,
      least({'k': s2.k + 4, 'a': s2.a || 'D'}, CASE WHEN late IS NOT NULL THEN least(
        {'k': s0.k + late + u, 'a': s0.a || ue}, CASE WHEN s1.k IS NOT NULL THEN {'k': s1.k + late + u, 'a': s1.a || ue} END, {'k': s3.k + late + u, 'a': s3.a || ue}) END) AS r2,
      least({'k': s3.k + 4, 'a': s3.a || 'D'}, CASE WHEN late IS NOT NULL THEN {'k': s2.k + late + a, 'a': s2.a || ae} END) AS r3
    FROM walk w JOIN (SELECT *, CASE WHEN c = 'u' THEN 0 ELSE 3 END AS u, CASE WHEN c = 'u' THEN 'K' ELSE 'R' END AS ue,
      CASE WHEN c = 'a' THEN 0 ELSE 3 END AS a, CASE WHEN c = 'a' THEN 'K' ELSE 'R' END AS ae FROM faults) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
best AS MATERIALIZED (SELECT size.conv_id, least(s0, s3) AS b, n FROM walk JOIN size ON walk.conv_id IS NOT DISTINCT FROM size.conv_id AND walk.i = size.n),
edits AS (SELECT conv_id, unnest(string_split(b.a, '')) AS e, unnest(range(1, len(b.a) + 1)) AS p, len(replace(b.a, 'D', '')) % 2 AS odd FROM best WHERE b.a <> ''),
numbered AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
turns AS (SELECT x.conv_id, p, CASE WHEN e = 'K' THEN f.role WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM numbered x LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i AND x.e <> 'I' WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS repaired FROM turns GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.k, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_turn_repair", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damaged=damage).reports.withColumnRenamed("conv", "conv_id")
