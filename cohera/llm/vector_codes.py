"""Vector codes of a product quantiser in whole numbers, with memoised grid cells.

Vectors become integers and are cut into equal parts; each part position has a codebook that rounds of assignment and
averaging move. To assign a part, the coarse grid cell that it falls in is hashed; for each cell a task keeps which
entries can be nearest to any point of the cell's box: those whose least distance to the box is no more than the least
of all greatest distances. Only these entries are evaluated, exactly. A round is one pass: a task sends one row of sums
per entry, so frequent vectors and labels cost nothing more; the driver sees sums of the codebook's own size only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored
from cohera.llm.textcore import U, is_in, mix

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LARGEST = 1 << 62  # components beyond it are held there
LONG = (1 << 63) - 1  # errors beyond it are held there
MEMORY = 100_000  # cells that a task keeps for a part; others are worked out again when they come again
CHUNK = 8_192  # rows or cells that are worked on together
#: The side of a cell is a power of two of about this share of the mean distance from an entry to its nearest other.
SIDE = 0.25


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int = SCALE, parts: int = PARTS) -> tuple[Stored, int]:
    """The table id, label, vec (longs, ``parts`` times the returned width) of the rows whose vectors can be coded."""
    vec = F.col(vec_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bound = F.lit(float(LARGEST))
    whole = F.transform(vec, lambda x: F.floor(F.greatest(F.least(x * scale, bound), -bound)))
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    kept = Stored(vectors.where(F.col(vec_col).isNotNull()).where(sound).select(F.col(id_col).alias("id"), label.alias("label"), whole.alias("vec")), "vectors")
    low, high = kept.df.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    width = max(1, -(-(high or 0) // parts))
    if low is not None and low < width * parts:  # of different lengths, or no multiple: zeros follow
        short = F.greatest(F.lit(width * parts) - F.size("vec"), F.lit(0))
        padded = Stored(kept.df.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), short))), "vectors")
        kept.drop()
        kept = padded
    return kept, width


class Cells:
    """Nearest entries of one part position's codebook, by cells that are remembered."""

    def __init__(self, book: np.ndarray, memory: int = MEMORY):
        self.book, self.memory = book, memory
        self.width = book.shape[1]
        gap = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for j, y in enumerate(book) if j != i), default=0) for i, x in enumerate(book)]
        side = int(SIDE * sum(g**0.5 for g in gap) / max(1, len(gap)))
        self.shift = min(max(side.bit_length() - 1, 0), 60)
        self.largest = int(max((abs(int(v)) for v in book.ravel()), default=0))
        self.keys, self.cells, self.masks = np.zeros(0, np.uint64), np.zeros((0, self.width), np.int64), np.zeros((0, len(book)), bool)

    def _exact(self, x: np.ndarray) -> bool:
        """Whether squared distances to ``x``, and to the cells around it, fit in 64 bits."""
        m = max(self.largest, int(np.abs(x).max(initial=0))) + (1 << self.shift)
        return 4 * m * m * self.width < LONG

    def candidates(self, cells: np.ndarray, exact: bool = True) -> np.ndarray:
        """Per cell: which entries are not dominated over its whole box."""
        out = np.zeros((len(cells), len(self.book)), dtype=bool)
        kind = np.int64 if exact else object
        book = self.book.astype(kind)
        for a in range(0, len(cells), CHUNK):
            low = cells[a : a + CHUNK].astype(kind)[:, None, :] * (1 << self.shift)
            below, above = low - book, book - (low + ((1 << self.shift) - 1))
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            near, far = (least * least).sum(axis=2), (most * most).sum(axis=2)
            out[a : a + CHUNK] = (near <= far.min(axis=1)[:, None]).astype(bool)
        return out

    def _masks(self, x: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of the cells that the rows fall in, and each row's cell among them."""
        cell = x >> self.shift
        key = np.zeros(len(x), dtype=np.uint64)
        for j in range(self.width):
            key = mix(key * U(0xE7037ED1A0B428DB) + cell[:, j].view(np.uint64) + U(j + 1))
        h, first, at = np.unique(key, return_index=True, return_inverse=True)
        if (cell != cell[first][at]).any():  # two cells of one hash in this chunk: cells themselves are compared
            _, first, at = np.unique(cell, axis=0, return_index=True, return_inverse=True)
            return self.candidates(cell[first], exact), at.ravel()
        masks = np.zeros((len(h), len(self.book)), dtype=bool)
        known = np.flatnonzero(is_in(h, self.keys))
        place = np.searchsorted(self.keys, h[known])
        same = (self.cells[place] == cell[first[known]]).all(axis=1) if len(known) else np.zeros(0, bool)
        masks[known[same]] = self.masks[place[same]]
        new = np.setdiff1d(np.arange(len(h)), known[same])
        if len(new):
            masks[new] = self.candidates(cell[first[new]], exact)
            add = np.setdiff1d(new, known)[: max(0, self.memory - len(self.keys))]
            if len(add):
                keys = np.concatenate([self.keys, h[add]])
                order = np.argsort(keys, kind="stable")
                self.keys = keys[order]
                self.cells = np.concatenate([self.cells, cell[first[add]]])[order]
                self.masks = np.concatenate([self.masks, masks[add]])[order]
        return masks, at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of two at the same distance) and the squared distance, per row."""
        exact = self._exact(x)
        masks, at = self._masks(x, exact)
        row, entry = np.nonzero(masks[at])
        kind = np.int64 if exact else object
        gap = x.astype(kind)[row] - self.book.astype(kind)[entry]
        d = (gap * gap).sum(axis=1)
        begin = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(d, begin) if len(x) else d
        hit = np.flatnonzero((d == least[row]).astype(bool))[::-1]
        index = np.zeros(len(x), dtype=np.int64)
        index[row[hit]] = entry[hit]  # in descending order: the lowest entry is written last
        return index, least


def _blocks(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows a to b of a batch as a matrix of longs."""
    for a in range(0, len(batch), CHUNK):
        part = batch.column(column).slice(a, CHUNK)
        yield a, a + len(part), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def _sums(books: list[np.ndarray], width: int) -> Callable:
    """One row per part, entry and position: rows that chose the entry, and the sum of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        n = np.zeros((len(books), len(books[0])), dtype=np.int64)
        total = np.zeros((len(books), len(books[0]), width), dtype=object)
        for batch in batches:
            for _, _, x in _blocks(batch, 0, width * len(books)):
                kind = np.int64 if int(np.abs(x).max(initial=0)) < 1 << 48 else object
                for p, c in enumerate(cells):
                    part = x[:, p * width : (p + 1) * width]
                    index, _ = c.nearest(part)
                    n[p] += np.bincount(index, minlength=len(c.book))
                    add = np.zeros((len(c.book), width), dtype=kind)
                    np.add.at(add, index, part.astype(kind))
                    total[p] += add.astype(object)
        p, e, j = (a.ravel() for a in np.indices(total.shape))
        used = np.flatnonzero(n[p, e])
        p, e, j = p[used], e[used], j[used]
        sums = pa.array([Decimal(int(v)) for v in total[p, e, j]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array(n[p, e], pa.int64()), sums], names=["p", "e", "j", "n", "s"])

    return run


def train(kept: Stored, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook per part position: from the ``entries`` smallest ids, moved ``rounds`` times over all vectors."""
    first = [r.vec for r in kept.df.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()]
    books = [np.array([v[p * width : (p + 1) * width] for v in first], dtype=np.int64).reshape(-1, width) for p in range(parts)]
    for _ in range(rounds if first else 0):
        rows = kept.df.select("vec").mapInArrow(_sums(books, width), "p int, e int, j int, n long, s decimal(38,0)")
        books = [b.copy() for b in books]
        for r in rows.groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # the size of the codebooks
            books[r.p][r.e, r.j] = int(r.s) // r.n
    return books


def encode(kept: Stored, books: list[np.ndarray], width: int) -> DataFrame:
    """id, label, code (a byte per part), error (squared distance to the entries, over all parts)."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            for a, b, x in _blocks(batch, 2, width * len(books)):
                found = [c.nearest(x[:, p * width : (p + 1) * width]) for p, c in enumerate(cells)]
                code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                error = [min(int(e), LONG) for e in sum(d.astype(object) for _, d in found)]
                new = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *new], names=["id", "label", "code", "error"])

    return kept.df.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Per coded vector: id, label, code, error, label_error; and the codebooks (part, entry, position).

    Rows whose vector is null or has null, NaN or infinite components are left out. Vectors of other lengths than the
    longest, or of no multiple of ``parts``, end in zeros. Null ids come after all others in the choice of the first
    entries, and repeated ids are rows of their own; with fewer rows than entries the codebooks are that small. Equal
    labels (nulls together) share the sum of their errors. Other columns are not looked at; an empty table gives no rows.
    Whole components beyond 2^62 and errors beyond 2^63 - 1 are held there.
    """
    kept, width = whole_vectors(vectors, id_col, vec_col, label_col, scale, parts)
    books = train(kept, width, parts, entries, rounds)
    coded = Stored(encode(kept, books, width), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = Stored(coded.df.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "label-errors").df
    return coded.df.join(labels, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def books_digest(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def _sql() -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, range({PARTS}) AS r(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES})""",
    ]
    chosen = """SELECT vec_id, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
  FROM parts JOIN book{r} USING (p) GROUP BY ALL"""
    for r in range(ROUNDS):
        steps.append(f"near{r} AS MATERIALIZED ({chosen.format(r=r)})")
        steps.append(f"""sum{r} AS MATERIALIZED (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT p, m.e AS e, x, unnest(range(1, len(x) + 1)) AS j FROM near{r} JOIN parts USING (vec_id, p)) GROUP BY ALL)""")
        steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM book{r} b
  LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM sum{r} GROUP BY ALL) u ON b.p = u.p AND b.e = u.e)""")
    steps.append(f"last AS MATERIALIZED ({chosen.format(r=ROUNDS)})")
    steps.append("""coded AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM last GROUP BY vec_id)""")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""


@query("op12_vector_codes", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("code")).alias("code")
    return out.select(F.col("id").alias("vec_id"), code, "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
