"""Removal of long repeated byte strings by a column-wise built suffix order of many texts.

Any ``length`` consecutive bytes hold an anchor: the least hash of the 32-byte grams in them, wherever the same bytes
stand. So equal strings meet at equal anchors, and only the surroundings of anchors that occur more than once need be
compared. Equal surroundings are one fragment; a fragment that occurs twice is repeated as a whole. A string of
``length`` bytes around an anchor takes in half of what is beside it on the left or on the right, so fragments meet by
equal left halves and, for the other strings, by equal right halves; a half that no other fragment has is done. Those
that share a half are a collection whose suffix order, Burrows-Wheeler style, grows by one symbol of every fragment a
round, from the last column to the first: fragments are aligned at their anchor, so the suffixes that a round inserts
only compare with each other, the round's segment follows from the order of the round before (a stable sort by the new
symbol) and so do the common prefixes (one more than the least between neighbours). Symbols come from and common
prefixes go to sequential files in the task's temporary folder. A start whose common prefix with a neighbour is
``length`` or more is a repeated string.

A crowd of fragments with one half is ordered in parts, and what a part leaves open is compared across the parts by hash.
Before that the crowd is sorted over all tasks by what stands left of the bytes that it shares, and by what stands right of
them: how far a fragment agrees with its neighbours there bounds which of its strings any other can have, and no others are
compared.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored, content_key, join_checked
from cohera.llm.textcore import BYTE, U, gram_mask, mix, powers, text_slices

LENGTH = 400
GRAM = 32
COLLECTION = 16_384  # fragments that a task orders at once
CROWD = 4_096  # fragments with one half that are ordered together; larger crowds are split and their windows compared by hash
BYTE2 = mix(BYTE ^ U(0x589965CC75374CC3))


def _sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][:-1], out=total[1:])
    return total


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a slice: of each full window the leftmost of its least grams."""
    n, span = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, down = _sums(data, BYTE), powers(n + 1)[1]
    g = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = U((1 << int(n).bit_length()) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    pad = -len(key) % span
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(gram_mask(offs, length))
    chosen = np.zeros(n, dtype=bool)
    chosen[(np.minimum(behind[starts], ahead[starts + span - 1]) & low).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, g[at]


class Side:
    """Columns of the fragments of one side: how far they reach from the anchor, and which starts of strings are theirs."""

    def __init__(self, side: int, length: int):
        beside = length - GRAM
        half = beside // 2
        self.left, self.right = (beside, length - half) if side == 0 else (half - 1, length)
        self.starts = beside - half + 1 if side == 0 else half  # start columns 0 .. starts - 1, column ``left`` is the anchor
        self.core = self.left - half if side == 0 else self.left  # first column of the half and gram that a group shares
        self.shared = GRAM + half
        self.spare = length - self.shared


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(content, text) to one row per anchor: place, gram hash, 128-bit hash of the fragment around it, its reach, and
    hashes of its left and right halves (null where the text ends before)."""
    reach, half = length - GRAM, (length - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(1), lower=False, limit=1 << 20):
                at, g = anchors(t.data, t.offs, length)
                row = np.searchsorted(t.offs, at, "right") - 1
                lo, hi = np.maximum(t.offs[row], at - reach), np.minimum(t.offs[row + 1], at + length)
                down = powers(len(t.data) + 1)[1]
                one, two = _sums(t.data, BYTE), _sums(t.data, BYTE2)
                f = [mix(mix((x[hi] - x[lo]) * down[lo] + (hi - lo).astype(np.uint64)) + (at - lo).astype(np.uint64)) for x in (one, two)]
                far = [at - half, np.minimum(at + GRAM + half, len(t.data))]
                halves = [mix((one[at] - one[np.maximum(far[0], 0)]) * down[np.maximum(far[0], 0)]), mix((one[far[1]] - one[at]) * down[at])]
                short = [at - lo < half, hi - at < GRAM + half]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[t.lo : t.hi].take(pa.array(row)), pa.array(at - t.offs[row], pa.int64()), pa.array(g.view(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(at - lo, pa.int32()), pa.array(hi - at, pa.int32()),
                    *[pa.array(h.view(np.int64), mask=no) for h, no in zip(halves, short)],
                ], names=["content", "pos", "anchor", "f1", "f2", "left", "right", "h0", "h1"])

    return texts.mapInArrow(run, "content binary, pos long, anchor long, f1 long, f2 long, left int, right int, h0 long, h1 long")


FRAGMENT = "side int, anchor long, half long, salt int, f1 long, f2 long, c long, left int, bytes binary"
BOUNDED = f"{FRAGMENT}, lo int, hi int"  # first and last start column that may be repeated
GROUP = ["side", "anchor", "half", "salt"]


def _cut(length: int):
    """(text, list of wanted fragments) to the fragments' bytes, as far as their side reaches."""
    sides = (Side(0, length), Side(1, length))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=[*GROUP, "f1", "f2", "c", "left", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    side = sides[w["side"]]
                    left, right = min(w["left"], side.left), min(w["right"], side.right)
                    out.append((*(w[x] for x in GROUP), w["f1"], w["f2"], w["c"], left, raw[w["pos"] - left : w["pos"] + right]))
                if len(out) >= 4096:
                    yield pack(out)
                    out = []
            yield pack(out)

    return run


def _agreement(pieces: list[bytes], cut: np.ndarray, leftwards: bool) -> np.ndarray:
    """Of each neighbouring two of the pieces, how many bytes agree on the given side of the cuts, going away from them."""
    parts = [p[:c][::-1] if leftwards else p[c:] for p, c in zip(pieces, cut)]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    cells = np.zeros((len(parts), int(size.max(initial=0)) + 1), dtype=np.uint8)
    for i, p in enumerate(parts):
        cells[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
    differ = cells[1:] != cells[:-1]
    differ[:, -1] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))


def _bound(length: int, leftwards: bool):
    """Fragments in the order of what stands beside their shared bytes: ``lo`` (``hi`` on the right) becomes the first
    (last) start column that such agreement allows. A task's first and last row, whose neighbours may be elsewhere, stay."""
    sides = (Side(0, length), Side(1, length))
    name = "lo" if leftwards else "hi"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before = length  # how far the held row agrees with the one before
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch])
            if not len(rows):
                continue
            kind = np.stack([rows[x].to_numpy().astype(np.int64) for x in ("side", "anchor", "half")])
            left, core, shared, spare = (np.array([getattr(x, y) for x in sides])[kind[0]] for y in ("left", "core", "shared", "spare"))
            cut = rows["left"].to_numpy() - left + core + (0 if leftwards else shared)
            same = (kind[:, 1:] == kind[:, :-1]).all(axis=0)
            meets = np.where(same, _agreement(rows["bytes"].to_pylist(), cut, leftwards), -length)
            most = np.maximum(np.append(before, meets[:-1]), meets) if len(meets) else meets
            old = rows[name].to_numpy()
            new = np.maximum(old[:-1], (core[:-1] - most)) if leftwards else np.minimum(old[:-1], (core - spare)[:-1] + most)
            at = rows.schema.get_field_index(name)
            yield from rows.slice(0, len(rows) - 1).set_column(at, name, pa.array(new, pa.int32())).to_batches()
            held = rows.slice(len(rows) - 1).combine_chunks().to_batches()[0]
            before = int(meets[-1]) if len(meets) else before
        if held is not None:
            yield held

    return run


def repeated_starts(group: np.ndarray, left: np.ndarray, pieces: list[bytes], side: Side, length: int) -> np.ndarray:
    """Which strings of each fragment stand in another fragment of its group at the same place: n x side.starts.

    ``group`` is sorted. Column ``side.left`` is the anchor's first byte.
    """
    n, width = len(pieces), side.left + side.right
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    first = side.left - left.astype(np.int64)
    last = first + size
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as prefixes:
        cells = np.zeros((width, n), dtype=np.uint8)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        of = np.repeat(np.arange(n), size)
        cells[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + first[of], of] = flat
        cells[::-1].tofile(symbols)  # in the order in which the rounds read
        del cells, flat, of
        symbols.seek(0)
        order, common = np.arange(n), np.zeros(n + 1, dtype=np.int32)
        for j in range(width - 1, -1, -1):
            inside = (first <= j) & (j < last)
            symbol = np.fromfile(symbols, dtype=np.uint8, count=n).astype(np.int64)
            key = (group * 257 + np.where(inside, symbol, 256))[order]
            to = np.argsort(key, kind="stable")
            new, key = order[to], key[to]
            meets = np.zeros(n, dtype=bool)
            meets[1:] = (key[1:] == key[:-1]) & inside[new[1:]]
            at = np.flatnonzero(meets)
            grown = np.zeros(n + 1, dtype=np.int32)
            if len(at):
                pairs = np.stack([to[at - 1] + 1, to[at] + 1], axis=1).ravel()
                grown[at] = np.minimum(np.minimum.reduceat(common, pairs)[::2] + 1, length)
            order, common = new, grown
            if j < side.starts:
                most = np.empty(n, dtype=np.int16)
                most[order] = np.maximum(common[:-1], common[1:])
                most.tofile(prefixes)
        prefixes.seek(0)
        out = np.zeros((n, side.starts), dtype=bool)
        for j in range(side.starts - 1, -1, -1):
            out[:, j] = np.fromfile(prefixes, dtype=np.int16, count=n) >= length
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1] - 1


SOLVED = "anchor long, f1 long, f2 long, a int, b int, w1 long, w2 long, half long, open boolean"


def _part_windows(of: np.ndarray, pieces: list[bytes], left: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: Side, length: int) -> tuple[np.ndarray, ...]:
    """One fragment, start column and 128-bit hash for each distinct string of a part that its bounds allow."""
    size = np.array([len(pieces[i]) for i in of])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pieces[i] for i in of), dtype=np.uint8)
    count = np.maximum(size - length + 1, 0)
    k = np.repeat(np.arange(len(of)), count)
    step = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    col, place = side.left - left[of][k] + step, begin[k] + step
    mine = (col >= lo[of][k]) & (col <= hi[of][k])
    k, col, place = k[mine], col[mine], place[mine]
    down = powers(len(data) + 1)[1]
    w1, w2 = (mix((x[place + length] - x[place]) * down[place]).view(np.int64) for x in (_sums(data, BYTE), _sums(data, BYTE2)))
    order = np.lexsort((w2, w1, col))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (w1, w2, col)])
    at = order[new]
    return of[k[at]], col[at], w1[at], w2[at]


def _solve(rows: pa.Table, side: Side, length: int) -> pa.RecordBatch:
    """Sorted fragments of one side to the first and last start (from the anchor) of each run of repeated strings.

    Of parts of a split crowd also the hashes of strings that are not yet repeated (``open`` if the fragment occurs once)
    and of one of each kind that is, to be compared across the parts.
    """
    anchor, half, salt, f1, f2, c, left, lo, hi = (rows[x].to_numpy() for x in ("anchor", "half", "salt", "f1", "f2", "c", "left", "lo", "hi"))
    group = np.stack([anchor, half, salt.astype(np.int64)])
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
    at = np.flatnonzero(new)
    anchor, half, salt, f1, f2, c, left, lo, hi, group = anchor[at], half[at], salt[at], f1[at], f2[at], c[at], left[at], lo[at], hi[at], group[:, at]
    pieces = rows["bytes"].take(pa.array(at)).to_pylist()
    border = np.ones(len(anchor), dtype=bool)
    border[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
    number = np.cumsum(border)
    flags = repeated_starts(number, left, pieces, side, length)
    single = c == 1
    row, a, b = _runs(flags & single[:, None])
    found = [(np.zeros(0, np.int64),) * 4]
    for part in np.unique(number[salt >= 0]):  # at most CROWD fragments each, in the mean
        found.append(_part_windows(np.arange(*np.searchsorted(number, [part, part + 1])), pieces, left, lo, np.minimum(hi, side.starts - 1), side, length))
    who, col, w1, w2 = (np.concatenate(x) for x in zip(*found))
    source = np.concatenate([row, who]).astype(np.int64)
    none = np.arange(len(source)) < len(row)
    hashes = [pa.array(np.concatenate([np.zeros(len(row), np.int64), x]), mask=none) for x in (w1, w2)]
    starts = [pa.array(np.concatenate([x, col]) - side.left, pa.int32()) for x in (a, b)]
    open_ = np.concatenate([np.zeros(len(row), bool), single[who] & ~flags[who, col]])
    return pa.RecordBatch.from_arrays([pa.array(anchor[source]), pa.array(f1[source]), pa.array(f2[source]), *starts, *hashes, pa.array(half[source]), pa.array(open_)], names=["anchor", "f1", "f2", "a", "b", "w1", "w2", "half", "open"])


def _collections(length: int):
    """Fragments sorted by group to :func:`_solve`, in whole groups of about COLLECTION fragments at a time."""
    sides = (Side(0, length), Side(1, length))

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side = rows["side"].to_numpy()
        for k in (0, 1):
            lo, hi = np.searchsorted(side, [k, k + 1])
            if hi > lo:
                yield _solve(rows.slice(lo, hi - lo), sides[k], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(h) for h in held) < COLLECTION:
                continue
            rows = pa.Table.from_batches(held)
            group = np.stack([rows[x].to_numpy().astype(np.int64) for x in GROUP])
            border = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            begin = 0
            while len(border) and begin < border[-1]:
                end = int(border[max(np.searchsorted(border, begin + COLLECTION, "right") - 1, np.searchsorted(border, begin, "right"))])
                yield from solve(rows.slice(begin, end - begin))
                begin = end
            held = rows.slice(begin).to_batches()
        if sum(len(h) for h in held):
            yield from solve(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Per distinct text (``content``: MD5 of it) that has repeated bytes: ``spans``, an unsorted list of (lo, hi)."""
    texts = docs.select(content_key(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = Stored(anchor_rows(texts, length), "repeat-anchors")
    fragment = places.df.groupBy("anchor", "f1", "f2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("content", "pos", "left", "right", "h0", "h1")).alias("at"))
    fragment = Stored(fragment, "repeat-fragments")
    shared = fragment.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total")).where("total > 1")
    known = Stored(fragment.df.join(shared, "anchor").select("anchor", "f1", "f2", "c", "kinds", "at"), "repeat-shared")
    fragment.drop()
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("at.h0").alias("half")), F.struct(F.lit(1).alias("side"), F.col("at.h1").alias("half")))
    half = known.df.where("kinds > 1").select("anchor", "f1", "f2", "c", "at.content", "at.pos", "at.left", "at.right", F.explode(sides).alias("s"))
    half = half.select("*", "s.*").drop("s").where(F.col("half").isNotNull() & (F.col("left") + F.col("right") >= length))
    met = Stored(half.groupBy("side", "anchor", "half").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "repeat-halves").df

    def cut(rows: DataFrame, salt: Column, source: DataFrame) -> DataFrame:
        wanted = rows.withColumn("salt", salt).groupBy("content").agg(F.collect_list(F.struct(*GROUP, "f1", "f2", "c", "pos", "left", "right")).alias("wanted"))
        once = source.groupBy("content").agg(F.min("text").alias("text"))  # copies merge before the shuffle, so a group's rows are its kinds
        pieces = once.join(wanted, "content").select("text", "wanted").mapInArrow(_cut(length), FRAGMENT)
        return pieces.withColumns({"lo": F.lit(0), "hi": F.lit(length)})

    pieces = cut(half.join(met.where(F.col("kinds") <= crowd), ["side", "anchor", "half"]), F.lit(-1), texts)
    large = met.where(F.col("kinds") > crowd)
    if not large.isEmpty():
        many = join_checked(half, large, ["side", "anchor", "half"], "inner")  # one row of ``large`` for over ``crowd`` fragments
        here = Stored(many.select("content").distinct(), "repeat-crowded").df
        part = F.pmod(F.xxhash64("f1", "f2"), F.ceil(F.col("kinds") / F.lit(float(crowd))).cast("long")).cast("int")
        crowds = Stored(cut(many, part, join_checked(texts, here, ["content"], "left_semi")), "repeat-crowds").df
        of_side = lambda x: F.when(F.col("side") == 0, getattr(Side(0, length), x)).otherwise(getattr(Side(1, length), x))
        begin = F.col("left") - of_side("left") + of_side("core")
        outside = {True: F.reverse(F.hex(F.substring("bytes", F.lit(1), begin))), False: F.substring("bytes", begin + of_side("shared") + 1, F.lit(length))}
        for leftwards, beside in outside.items():
            key = ["side", "anchor", "half", "beside", "f1", "f2"]
            crowds = crowds.withColumn("beside", beside).repartitionByRange(*key).sortWithinPartitions(*key).drop("beside").mapInArrow(_bound(length, leftwards), BOUNDED)
        pieces = pieces.unionByName(crowds.where("lo <= hi"))
    ordered = pieces.repartition(*GROUP).sortWithinPartitions(*GROUP, "f1", "f2")
    solved = Stored(ordered.mapInArrow(_collections(length), SOLVED), "repeat-solved")
    starts = solved.df.where("w1 IS NULL").select("anchor", "f1", "f2", "a", "b")
    crowds = solved.df.where("w1 IS NOT NULL")
    if not crowds.isEmpty():
        same = ["anchor", "half", "a", "w1", "w2"]
        twice = crowds.groupBy(*same).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*same)
        starts = starts.unionByName(crowds.where("open").join(twice, same, "left_semi").select("anchor", "f1", "f2", "a", "b"))
    partial = starts.groupBy("anchor", "f1", "f2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    whole = known.df.where("c > 1").select("anchor", "f1", "f2", F.lit(None).cast(partial.schema["runs"].dataType).alias("runs"))
    hit = places.df.join(whole.unionByName(partial), ["anchor", "f1", "f2"])
    pos = F.col("pos")
    all_of_it = F.array(F.struct((pos - F.col("left")).alias("lo"), (pos + F.col("right")).alias("hi")))
    some = F.transform("runs", lambda r: F.struct((pos + r["a"]).alias("lo"), (pos + r["b"] + length).alias("hi")))
    spans = F.when(F.col("runs").isNull(), F.when(F.col("left") + F.col("right") >= length, all_of_it)).otherwise(some)
    each = hit.select("content", F.explode(spans).alias("s")).distinct()  # copies of a text bring the same spans
    return each.groupBy("content").agg(F.collect_list("s").alias("spans"))


def remove_repeats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """The ``keep`` columns of every row with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes).

    A byte goes if a string of ``length`` bytes that covers it starts in more than one place of all texts. Null texts are
    empty; texts shorter than ``length`` stay; rows with the same text (and at least ``length`` bytes) lose all of it,
    repeated rows and rows with null ids too; an empty table gives no rows.
    """
    keep = tuple(keep)
    spans = Stored(repeated_spans(docs, text_col, length, crowd), "repeat-spans").df
    base = docs.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)], content_key(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nk = len(keep)
    ids = "".join(f"k{j} {base.schema[j].dataType.simpleString()}, " for j in range(nk))
    joined = base.join(spans, "content", "left").select(*[f"k{j}" for j in range(nk)], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, len(batch), 512):
                part = batch.slice(cut, 512)
                got = []
                for text, spans_ in zip(part.column(nk), part.column(nk + 1)):
                    raw = text.as_py().encode()
                    merged: list[list[int]] = []
                    for s in sorted((x["lo"], x["hi"]) for x in (spans_.as_py() or [])):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    ends = [0, *(x for m in merged for x in m), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    got.append((len(raw), len(raw) - len(kept), len(merged), kept))
                new = [pa.array([g[j] for g in got], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:nk], *new], names=[*part.schema.names[:nk], "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(run, f"{ids}n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept")


@query("op5_repeated_bytes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
