"""Near duplicates by BagMinHash: signatures of word-shingle multisets, banding, verified multiset overlap.

Weights of a bag are the counts of its shingles, discretised in steps of one. Each shingle carries independent Poisson
processes over the dyadic weight blocks (0,1], (1,2], (2,4], (4,8], ...; a point has a place in time, a register and a
weight in its block, and belongs to a bag if its weight is at most the bag's count. A register holds the first point
that falls into it; processes stop once they are past the last register of their bag. Two bags agree in a register with
the probability of their weighted Jaccard similarity.

Bags that are equal are one node. Shingles that a node of a crowded bucket has alone bound what it can share with any
other, so nodes with too many of them are out; the node with the fewest is the centre of its bucket, and the others meet
it, not each other. The likeliest pairs are verified first, and only nodes of a bucket that are not connected by then, and
could share enough, are paired: a bit that only one of two bags sets is a shingle that the other has not. So every pair that shares a band ends up connected, verified or excluded by a bound,
without all pairs of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored, join_checked
from cohera.llm.textcore import U, Words, gram_mask, grams, list_column, mix, rows_of, text_slices, words
from cohera.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6  # a pair at 0.8 shares no band with probability 5e-6
REGISTERS = BANDS * ROWS
LANES = 4  # longs of one-bit registers
#: Two signatures at 0.8 differ in 24 of 240 one-bit registers on average, standard deviation 4.6; six of them above.
MOST_BITS = 52
WORDS = 32  # longs of a bag's shingle marks
STEP = U(0x9E3779B97F4A7C15)


def bags(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row: row, hash, count. A text of fewer than k words, but not none, is one shingle."""
    row = rows_of(w.offs)
    g, ok = grams(w.hashes, k), gram_mask(w.offs, k)
    h, r = g[ok], row[: len(ok)][ok]
    n = np.diff(w.offs)
    short = np.flatnonzero((n > 0) & (n < k))
    for m in range(1, k):
        at = short[n[short] == m]
        if len(at):
            at_words = w.offs[:-1][at]
            x = w.hashes[at_words].copy()
            for j in range(1, m):
                x = mix(x * U(0xE7037ED1A0B428DB) + w.hashes[at_words + j])
            h, r = np.concatenate([h, x ^ U(m)]), np.concatenate([r, at])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    return r[begin], h[begin], np.diff(np.append(begin, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n x m, uint64) of the bags; rows without shingles keep the value of an empty register."""
    first = np.full(n * m, np.inf)
    top = int(count.max()).bit_length() if len(count) else 0
    procs = []
    for level in range(top + 1):  # block (2^(level-1), 2^level], the first is (0, 1]
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        at = np.flatnonzero(count > low)
        if len(at):
            procs.append((row[at], mix(h[at] + U((level + 1) * 0xA0761D6478BD642F % (1 << 64))), np.full(len(at), float(width)), np.minimum(count[at] - low, width)))
    if not procs:
        return mix(first.view(np.uint64)).reshape(n, m)
    row, seed, width, part = (np.concatenate(x) for x in zip(*procs))
    time, t = np.zeros(len(row)), 0
    while len(row):
        t += 1
        r = mix(seed + U(t * int(STEP) % (1 << 64)))
        u = ((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / width
        r = mix(r ^ STEP)
        register = (r >> U(40)) % U(m)
        counts = (r & U(0xFFFFFFFFFF)).astype(np.float64) * (width * 2.0**-40) < part  # the point's weight lies within the bag
        np.minimum.at(first, row[counts] * m + register[counts].astype(np.int64), time[counts])
        alive_rows = np.unique(row)
        last = np.full(n, -1.0)
        last[alive_rows] = first.reshape(n, m)[alive_rows].max(axis=1)
        go = time < last[row]
        row, seed, width, part, time = row[go], seed[go], width[go], part[go], time[go]
    return mix(first.view(np.uint64)).reshape(n, m)


def sketch(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Per row: kept columns (k0, k1, ...), 16-byte key and size of the bag, band keys, one-bit registers, text."""
    base = docs.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nk = len(keep)
    ids = "".join(f"k{j} {base.schema[j].dataType.simpleString()}, " for j in range(nk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(nk)):
                n = t.hi - t.lo
                row, h, count = bags(words(t))
                sig = signatures(row, h, count, n)
                band = sig[:, ::ROWS].copy()
                for j in range(1, ROWS):
                    band = mix(band * U(0xE7037ED1A0B428DB) + sig[:, j::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * STEP)
                bits = (sig & U(1)).reshape(n, LANES, REGISTERS // LANES)
                lanes = (bits << np.arange(REGISTERS // LANES, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                key = np.zeros((n, 2), dtype=np.uint64)
                for j, salt in enumerate((0x589965CC75374CC3, 0x1D8E4E27C47D124F)):
                    np.add.at(key[:, j], row, mix(mix(h ^ U(salt)) + count.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    *[c[t.lo : t.hi] for c in batch.columns[:nk]], pa.array([k.tobytes() for k in key], pa.binary()), pa.array(np.bincount(row, weights=count, minlength=n).astype(np.int64)),
                    list_column(band.view(np.int64).ravel(), np.arange(n + 1) * BANDS, pa.int64()), list_column(lanes.view(np.int64).ravel(), np.arange(n + 1) * LANES, pa.int64()), batch.column(nk)[t.lo : t.hi],
                ], names=[*batch.schema.names[:nk], "bag", "size", "bands", "bits", "text"])

    return base.mapInArrow(run, f"{ids}bag binary, size long, bands array<long>, bits array<long>, text string")


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the shingle bags of two texts."""
    _, x, n = bags(words(next(text_slices(pa.array([a], pa.string())))))
    _, y, m = bags(words(next(text_slices(pa.array([b], pa.string())))))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    total = int(n.sum() + m.sum()) - common
    return common / total if total else 1.0


def _own_shingles(texts: DataFrame) -> DataFrame:
    """Per node the weight of the shingles that no other of the given nodes has: node, own (nodes with none are absent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(1)):
                row, h, count = bags(words(t))
                yield pa.RecordBatch.from_arrays([batch.column(0)[t.lo : t.hi].take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(count, pa.int64())], names=["node", "shingle", "c"])

    rows = texts.select("node", "text").mapInArrow(run, "node long, shingle long, c long")
    single = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node"), F.min("c").alias("c")).where("k = 1")
    return single.groupBy("node").agg(F.sum("c").alias("own"))


def _shingle_marks(texts: DataFrame) -> DataFrame:
    """Per node a bit set of its shingles, one of 64 ``WORDS`` places each: node, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(1)):
                n = t.hi - t.lo
                row, h, _ = bags(words(t))
                place = (mix(h) >> U(64 - (64 * WORDS).bit_length() + 1)).astype(np.int64)
                bit = np.zeros((n, 64 * WORDS), dtype=np.uint8)
                bit[row, place] = 1
                marks = np.packbits(bit, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[t.lo : t.hi], list_column(marks.ravel(), np.arange(n + 1) * WORDS, pa.int64())], names=["node", "marks"])

    return texts.select("node", "text").mapInArrow(run, "node long, marks array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose texts are at least that similar."""
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components, with the components."""
    if label is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    j = pairs.join(la, "a", "left").join(lb, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return j.where("ca <> cb")


def _label(label: DataFrame | None, nodes: DataFrame) -> DataFrame:
    return label if label is not None else nodes.limit(0).select("node", F.col("node").alias("component"))


def _differing_bits(x: str, y: str):
    return sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(LANES)), F.lit(0))


def _marked_only(x: str, y: str):
    """How many shingles the first bag has, at least, that the second has not."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)


def near_duplicates(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), similarity: float = SIMILARITY) -> DataFrame:
    """The ``keep`` columns of every row with ``class`` (long): rows of one class are connected by links of texts whose
    weighted Jaccard similarity over five-word shingles is at least ``similarity`` (0.8 or more, for which the bands are
    laid out).

    Words are runs of digits, letters and other non-ASCII characters after lower-casing A-Z. Texts of fewer than five words
    compare as one shingle; null, empty and wordless texts are one class; repeated rows stay repeated. Numbers of classes
    are not stable between runs, membership is.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the bands find similarities of {SIMILARITY} and more")
    keep = tuple(keep)
    rows = Stored(sketch(docs, text_col, keep), "near-rows")
    nodes = Stored(rows.df.select("bag", "size", "bands", "bits").dropDuplicates(["bag"]).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    member = nodes.df.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = Stored(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "near-buckets")
    bits = nodes.df.select("node", "bits")
    near = lambda p: p.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b").withColumn("d", _differing_bits("x", "y")).where(F.col("d") <= MOST_BITS).drop("x", "y")
    alone = Stored(near(buckets.df.where("n = 2").select("a", "b").distinct()), "near-alone")
    crowd = Stored(member.join(buckets.df.where("n > 2").select("bucket"), "bucket"), "near-crowd")
    involved = alone.df.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.df.select("node")).distinct().join(nodes.df.select("node", "bag"), "node")
    texts = Stored(join_checked(rows.df.select("bag", "text"), involved, ["bag"], "inner").select("node", "text").dropDuplicates(["node"]), "near-texts")
    # what a node of a crowded bucket has alone bounds what it can share: beyond a fifth of its bag it has no link there
    # a node is joined once, not once a bucket: its buckets (at most one a band) travel with it
    own = Stored(_own_shingles(texts.df.join(crowd.df.select("node").distinct(), "node", "left_semi")), "near-own").df
    placed = crowd.df.groupBy("node", "size").agg(F.collect_list("bucket").alias("places")).join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    linkable = Stored(placed.where(F.col("own") <= F.lit(1 - similarity) * F.col("size") + 1e-6), "near-linkable")
    crowd = linkable.df.select("node", "own", F.explode("places").alias("bucket"))
    centre = crowd.groupBy("bucket").agg(F.min(F.struct("own", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    star = crowd.join(centre, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    likely = Stored(alone.df.unionByName(near(star)).distinct(), "near-pairs")
    tried: list[Stored] = []
    label: DataFrame | None = None

    def settle_links(chosen: DataFrame) -> None:
        """Verify pairs and merge the components that the true ones join: only components are nodes of a later graph."""
        nonlocal label
        tried.append(Stored(chosen.select("a", "b"), "near-tried"))
        links = Stored(_apart(_verify(tried[-1].df, texts.df, similarity), label).select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct(), "near-links").df
        if links.isEmpty():
            return
        merged = connected_components(links)
        if label is not None:
            joins = merged.withColumnsRenamed({"node": "old", "component": "new"})
            inner = label.join(joins, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
            merged = inner.unionByName(merged.join(label.select("node"), "node", "left_anti"))
        label = Stored(merged, "near-classes").df

    def untried(p: DataFrame) -> DataFrame:
        for x in tried:
            p = p.join(x.df, ["a", "b"], "left_anti")
        return p

    # the likeliest pair of every node first; then what is still open between components
    best = likely.df.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b")
    settle_links(best)
    settle_links(untried(_apart(likely.df, label)))
    # nodes of one crowded bucket that are still apart: pair them with each other, not only with the ends
    tagged = linkable.df.join(_label(label, nodes.df), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = tagged.select("node", "component", F.explode("places").alias("bucket"))
    split = apart.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    places = Stored(apart.join(split, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("places")), "near-places").df
    marks = _shingle_marks(texts.df.join(places, "node", "left_semi"))
    loose = Stored(tagged.drop("places").join(places, "node").join(bits, "node").join(marks, "node"), "near-loose")
    left, right = (loose.df.select(F.explode("places").alias("bucket"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "bits", "own", "size", "marks", "places")]) for x in "ab")
    enough = F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-6
    could = F.least(F.col("size_a") - F.col("own_a"), F.col("size_b") - F.col("own_b")) >= enough  # what the two can share
    also = F.least(F.col("size_a") - _marked_only("marks_a", "marks_b"), F.col("size_b") - _marked_only("marks_b", "marks_a")) >= enough
    once = F.get(F.array_intersect("places_a", "places_b"), F.lit(0)) == F.col("bucket")  # at the first bucket that they share
    cross = left.join(right, "bucket").where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & could & (_differing_bits("bits_a", "bits_b") <= MOST_BITS) & once & also)
    cross = cross.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    settle_links(untried(cross))
    named = rows.df.select(*[F.col(f"k{j}") for j in range(len(keep))], "bag").join(nodes.df.select("bag", "node"), "bag").join(_label(label, nodes.df), "node", "left")
    return named.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], F.coalesce("component", "node").alias("class"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id stays (a null id last; of
    rows that share the id the one with the smallest hash of all columns, and one of wholly equal rows). Texts without
    words are one class."""
    base = docs.withColumn("_mark", F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns]))
    found = near_duplicates(base, text_col, (id_col, "_mark"), similarity)
    first = found.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_mark")).alias("f"))
    stay = Stored(first.select("f.id", "f._mark").distinct(), "near-stay").df.withColumnsRenamed({"id": "_stay", "_mark": "_stay_mark"})
    hit = base.join(stay, F.col(id_col).eqNullSafe(F.col("_stay")) & (F.col("_mark") == F.col("_stay_mark")))
    one = F.row_number().over(Window.partitionBy("_stay", "_stay_mark").orderBy("_stay_mark"))
    return hit.withColumn("_one", one).where("_one = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i : i + 4], ' ')))
                                                             ELSE [hash(array_to_string(ws, ' '))] END) AS s FROM d) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(c) AS n FROM b GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS common FROM b x JOIN b y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE common >= 0.8 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id AND r.m < e.b),
c AS (SELECT doc_id, min(m) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c
"""


@query("op4_near_dedup", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Stored(near_duplicates(table(spark, sf_dir, "documents")), "near-result").df
    named = found.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(named, "class").select("doc_id", "class_id", "class_size")
