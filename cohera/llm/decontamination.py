"""Benchmark decontamination by winnowing: fingerprints of documents and items are joined and hits are extended.

The fingerprint of a text is the least 5-gram hash of each window of six consecutive 5-grams, so any ten consecutive
words that two texts share leave a common fingerprint at the same place of the shared span. A joined fingerprint is
extended word by word to both sides; a run of at least ten words (the whole item if it is shorter) is a hit. Items of
m < 10 words are too short for that; all their m-grams (one) are kept, and documents are asked for all m-grams of the
lengths that occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored, content_key, small_enough
from cohera.llm.textcore import U, Words, gram_mask, grams, is_in, list_column, rows_of, text_slices, words

WINDOW = 10  # words of a window
GRAM = 5  # words of a fingerprint; WINDOW - GRAM + 1 of them per winnowing window
FILTER_ROWS = 4_000_000  # fingerprints of all items (8 bytes each) that are sent to tasks to leave out the other rows early


def winnow(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their word positions; the leftmost least hash of every full winnowing window."""
    span = WINDOW - GRAM + 1
    g = grams(w.hashes, GRAM)
    if len(g) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.flatnonzero(gram_mask(w.offs, WINDOW))
    least = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.unique(np.concatenate([[-1], *(p + least[p].argmin(axis=1) for p in np.array_split(full, max(1, len(full) // 200_000)) if len(p))]))[1:]
    return g[at], at


def short_prints(w: Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All m-grams of the given lengths: fingerprint, word position, m."""
    hs, at, ms = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in lengths:
        p = np.flatnonzero(gram_mask(w.offs, m))
        hs.append(grams(w.hashes, m)[p] + U(m))
        at.append(p)
        ms.append(np.full(len(p), m))
    return np.concatenate(hs), np.concatenate(at), np.concatenate(ms)


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per distinct word sequence: key, one of the texts, ids of all items that have it, number of words.
    Items without words have no window and are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for t in text_slices(column):
                w = words(t)
                n = np.diff(w.offs)
                digest = [w.hashes[a:b].tobytes() for a, b in zip(w.offs[:-1], w.offs[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[t.lo : t.hi], column[t.lo : t.hi], pa.array(digest, pa.binary()), pa.array(n, pa.int64())], names=["item", "text", "seq", "n"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text.alias("text")).mapInArrow(run, "item string, text string, seq binary, n long")
    grouped = rows.where("n > 0").groupBy(F.unhex(F.sha2("seq", 256)).alias("key"))
    return grouped.agg(F.min("text").alias("item_text"), F.sort_array(F.collect_set("item")).alias("items"), F.max("n").alias("n"))


def item_prints(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(1)):
                w = words(t)
                n = np.diff(w.offs)
                long, at = winnow(w)
                short, p, m = short_prints(w, sorted({int(x) for x in n[n < WINDOW]}))
                whole = n[rows_of(w.offs)[p]] == m
                f, pos = np.concatenate([long, short[whole]]), np.concatenate([at, p[whole]])
                row = rows_of(w.offs)[pos]
                key = pa.array(batch.column(0)[t.lo : t.hi]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([key, pa.array(f.view(np.int64)), pa.array(pos - w.offs[row], pa.int64())], names=["key", "print", "item_pos"])

    return items.select("key", "item_text").mapInArrow(run, "key binary, print long, item_pos long")


def _extend(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document starts and ends of the runs of equal words around aligned positions."""
    lo, hi = d.copy(), d.copy()
    going = np.arange(len(d))
    while len(going):
        going = going[(lo[going] > 0) & (i[going] - (d[going] - lo[going]) > 0)]
        going = going[doc[lo[going] - 1] == item[i[going] - (d[going] - lo[going]) - 1]]
        lo[going] -= 1
    going = np.arange(len(d))
    while len(going):
        going = going[(hi[going] < len(doc)) & (i[going] + hi[going] - d[going] < len(item))]
        going = going[doc[hi[going]] == item[i[going] + hi[going] - d[going]]]
        hi[going] += 1
    return lo, hi


def _text_words(text: str) -> np.ndarray:
    return words(next(text_slices(pa.array([text], pa.string())))).hashes


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate documents with their hits per item: extended, and merged per document."""
    for batch in batches:
        for row in batch.to_pylist():
            doc = _text_words(row["text"])
            hit, items = np.zeros(len(doc) + 1, dtype=np.int64), set()
            for c in row["candidates"]:
                item = _text_words(c["item_text"])
                least = min(WINDOW, len(item))
                at = np.array([(h["pos"], h["item_pos"]) for h in c["hits"]], dtype=np.int64).reshape(-1, 2)
                lo, hi = _extend(doc, item, at[:, 0], at[:, 1])
                ok = hi - lo >= least
                if ok.any():
                    items.update(c["items"])
                    np.add.at(hit, lo[ok], 1)
                    np.add.at(hit, hi[ok], -1)
            yield pa.RecordBatch.from_pydict({"content": [row["content"]], "n_hit": [int((np.cumsum(hit) > 0).sum())], "items": [sorted(items)]}, schema=pa.schema([("content", pa.binary()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), filter_rows: int = FILTER_ROWS) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids), ``contaminated``.

    Null texts have no words; an item without words never hits; items with equal words count once per distinct id (a null
    id counts as ''); rows with the same text get the same answer whatever their ids are; without items nothing is hit.
    Results don't depend on ``filter_rows``: beyond it fingerprints of documents are joined without the early filter.
    """
    keep = tuple(keep)
    items = Stored(item_table(benchmark, item_col, item_text_col), "items")
    prints = Stored(item_prints(items.df), "item-prints")
    lengths = sorted(int(r.n) for r in items.df.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most nine
    known = None
    if small_enough(prints.df, filter_rows):
        known = np.unique(np.array(prints.df.select("print").distinct().toArrow()["print"].to_numpy(), dtype=np.int64).view(np.uint64))
    base = docs.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)], content_key(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nk = len(keep)
    ids = ", ".join(f"k{j} {base.schema[j].dataType.simpleString()}" for j in range(nk))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(nk + 1)
            for t in text_slices(column):
                w = words(t)
                n = t.hi - t.lo
                f, at = winnow(w)
                g, p, _ = short_prints(w, lengths)
                f, at = np.concatenate([f, g]), np.concatenate([at, p])
                if known is not None:
                    hit = is_in(f, known)
                    f, at = f[hit], at[hit]
                order = np.argsort(at, kind="stable")
                f, at = f[order], at[order]
                row = rows_of(w.offs)[at]
                offs = np.searchsorted(row, np.arange(n + 1))
                has = np.diff(offs) > 0
                hits = pa.StructArray.from_arrays([pa.array(f.view(np.int64)), pa.array(at - w.offs[row], pa.int64())], names=["print", "pos"])
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), pa.int32()), hits)
                text = column.take(pa.array(np.arange(t.lo, t.hi), mask=~has))  # only texts with hits are needed again
                front = [c[t.lo : t.hi] for c in batch.columns[: nk + 1]]
                yield pa.RecordBatch.from_arrays([*front, text, pa.array(np.diff(w.offs), pa.int64()), lists], names=[*batch.schema.names[: nk + 1], "text", "n_words", "hits"])

    scanned = Stored(base.mapInArrow(scan, f"{ids}{', ' if ids else ''}content binary, text string, n_words long, hits array<struct<print: long, pos: long>>"), "doc-prints")
    found = scanned.df.where(F.col("text").isNotNull())
    texts = found.groupBy("content").agg(F.min("text").alias("text"))
    hits = found.select("content", "hits").dropDuplicates(["content"]).select("content", F.inline("hits"))
    per_item = hits.join(prints.df, "print").groupBy("content", "key").agg(F.collect_list(F.struct("pos", "item_pos")).alias("hits"))
    per_doc = per_item.join(items.df, "key").groupBy("content").agg(F.collect_list(F.struct("item_text", "items", "hits")).alias("candidates"))
    verdicts = per_doc.join(texts, "content").select("content", "text", "candidates").mapInArrow(_verdicts, "content binary, n_hit long, items array<string>")
    out = scanned.df.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "content", "n_words").join(verdicts.where("n_hit > 0"), "content", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(ws[s : s + m - 1], ' ') AS win
       FROM (SELECT item, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, s, array_to_string(ws[s : s + m - 1], ' ') AS win
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, ms WHERE len(ws) >= m)),
h AS (SELECT doc_id, s, m, item FROM dw JOIN iw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op2_decontamination", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
