"""Toxicity: a linear classifier whose score must not depend on which group a sentence mentions.

Features are the presence of words, of word pairs, and of several distinct words with the same beginning (insults come in
inflected and compounded forms that are each too rare to be learned). Of a bounded labelled sample one text of each family of near copies
stays; features are screened by a two-sample test; the logistic loss is minimised by Newton steps with two penalties:
the usual one on weights, and the counterfactual one, the squared change of the score when the identity terms of a
labelled text are swapped for others of their kind. A neutral mention of a group so adds nothing to a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohera.llm.language_id import sample_by_class
from cohera.llm.registry import query, table
from cohera.llm.textcore import U, Words, gram_mask, grams, is_in, list_column, mix, rows_of, span_hashes, text_slices, words

#: Identity terms by kind; a term is swapped for the next of its kind. A parameter of the operator.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"), ("transgender", "cisgender"), ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "citizens", "refugees", "natives"), ("immigrant", "citizen", "refugee", "native"), ("old", "young", "elderly"), ("disabled", "deaf", "blind", "autistic"), ("poor", "rich"),
)
PAIR = U(0x8EBC6AF09C88C6E3)
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
LEVELS = {2: U(0x589965CC75374CC3), 4: U(0x1D8E4E27C47D124F)}  # distinct words with one beginning


def term_hashes(terms: list[str]) -> np.ndarray:
    """Word hashes as texts have them."""
    raw = [t.encode() for t in terms]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    return span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)


def swap_table(kinds=IDENTITY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms and the hash that replaces each."""
    here = [t for kind in kinds for t in kind]
    there = [kind[(i + 1) % len(kind)] for kind in kinds for i in range(len(kind))]
    if not here:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = term_hashes(here), term_hashes(there)
    order = np.argsort(a)
    return a[order], b[order]


def features(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and pair hashes of all rows with the row of each, unsorted."""
    row = rows_of(offs)
    ok = gram_mask(offs, 2)
    return np.concatenate([h, grams(h, 2)[ok] ^ PAIR]), np.concatenate([row, row[: len(ok)][ok]])


def beginnings(data: np.ndarray, w: Words, terms: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A feature for each beginning that 2, and one that 4, distinct words of a row share. Identity terms don't count.

    With ``known`` only those features are counted that are in it.
    """
    row, length = rows_of(w.offs), w.ends - w.starts
    plain = ~is_in(w.hashes, terms)
    xs, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in BEGINNINGS:
        at = np.flatnonzero(plain & (length >= k))
        p = span_hashes(data, w.starts[at], w.starts[at] + k)
        if known is not None:
            may = np.logical_or.reduce([is_in(p ^ tag, known) for tag in LEVELS.values()])
            at, p = at[may], p[may]
        first = first_of_each(row[at], w.hashes[at])
        at, p = at[first], p[first]
        order = np.lexsort((p, row[at]))
        r, p = row[at][order], p[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(p)))
        for least, tag in LEVELS.items():
            many = begin[count >= least]
            xs.append(p[many] ^ tag)
            rows.append(r[many])
    return np.concatenate(xs), np.concatenate(rows)


def first_of_each(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of one element of each distinct (row, hash)."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    return order[new]


def distinct_rows(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = first_of_each(row, x)
    return x[at], row[at]


@dataclass(frozen=True)
class ToxicModel:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    terms: np.ndarray

    def scores(self, data: np.ndarray, w: Words) -> np.ndarray:
        x, row = features(w.hashes, w.offs)
        hit = is_in(x, self.known)
        x, row = distinct_rows(x[hit], row[hit])
        more, at = beginnings(data, w, self.terms, self.known)
        hit = is_in(more, self.known)
        x, row = np.concatenate([x, more[hit]]), np.concatenate([row, at[hit]])
        z = self.bias + np.bincount(row, weights=self.weights[np.searchsorted(self.known, x)], minlength=len(w.offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample_features(rows: DataFrame, kinds) -> DataFrame:
    """Labelled texts as distinct features, the same after swapping identity terms, and a family key (a near copy most
    likely shares the least 5-gram hash)."""
    here, there = swap_table(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(1)):
                w = words(t)
                n = t.hi - t.lo
                swapped, hit = w.hashes.copy(), is_in(w.hashes, here)
                swapped[hit] = there[np.searchsorted(here, w.hashes[hit])]
                mentions = np.bincount(rows_of(w.offs)[hit], minlength=n) > 0
                more, at = beginnings(t.data, w, here)
                both = lambda h: distinct_rows(*(np.concatenate(z) for z in zip(features(h, w.offs), (more, at))))
                x, rx = both(w.hashes)
                y, ry = both(swapped)
                y, ry = y[mentions[ry]], ry[mentions[ry]]
                five, fam = grams(w.hashes, 5), np.zeros(n, np.uint64)
                ok = gram_mask(w.offs, 5)
                row5 = rows_of(w.offs)[: len(ok)][ok]
                np.add.at(fam, rows_of(w.offs), mix(w.hashes))  # short texts: the bag itself
                if ok.any():
                    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                    np.minimum.at(least, row5, five[ok])
                    long = np.bincount(row5, minlength=n) > 0
                    fam[long] = least[long]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[t.lo : t.hi], pa.array(fam.view(np.int64)),
                     list_column(x.view(np.int64), np.searchsorted(rx, np.arange(n + 1)), pa.int64()),
                     list_column(y.view(np.int64), np.searchsorted(ry, np.arange(n + 1)), pa.int64())],
                    names=["label", "family", "x", "swapped"],
                )

    return rows.mapInArrow(run, "label int, family long, x array<long>, swapped array<long>")


def _matrix(rows: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(known)), dtype=np.float32)
    for i, r in enumerate(rows):
        r = np.asarray(r, dtype=np.int64).view(np.uint64)
        out[i, np.searchsorted(known, r[is_in(r, known)])] = 1
    return out


def fit(sample: pa.Table, max_features: int = 400, least_z: float = 5.0, ridge: float = 1e-4, fair: float = 1.0, kinds=IDENTITY) -> ToxicModel:
    """Screen features and minimise the penalised loss; one row per family and label counts."""
    y = sample["label"].to_numpy().astype(np.int64)
    _, first = np.unique(sample["family"].to_numpy(), return_index=True)
    first = np.sort(first)
    y = y[first]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    terms = swap_table(kinds)[0]
    rate = (n1 + 0.5) / (n1 + n0 + 1)
    empty = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))), terms)
    if not n1 or not n0:
        return empty
    xs = [sample["x"][int(i)].values.to_numpy() for i in first]
    flat = np.concatenate(xs)
    label = np.repeat(y, [len(x) for x in xs])
    ids, at = np.unique(flat, return_inverse=True)
    ones = np.bincount(at, weights=label, minlength=len(ids))
    every = np.bincount(at, minlength=len(ids))
    p = every / len(y)
    z = (ones / n1 - (every - ones) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    picked = np.flatnonzero((np.abs(z) >= least_z) & (every >= 8))
    picked = picked[np.argsort(-np.abs(z[picked]), kind="stable")][:max_features]
    known = np.unique(np.concatenate([ids[picked].view(np.uint64), terms]))
    a = _matrix(xs, known)
    mention = [k for k, i in enumerate(first) if len(sample["swapped"][int(i)])]
    change = _matrix([sample["swapped"][int(first[k])].values.to_numpy() for k in mention], known) - a[mention] if mention else np.zeros((0, len(known)), np.float32)
    pull = ridge * np.eye(len(known)) + fair * (change.T @ change) / max(1, len(mention))
    w, b = np.zeros(len(known)), empty.bias
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(a @ w + b, -30, 30)))
        v = np.maximum(q * (1 - q), 1e-6)
        gw, gb = a.T @ (q - y) / len(y) + pull @ w, float((q - y).mean())
        av = a * v[:, None]
        top = av.T @ a / len(y) + pull
        side = av.sum(axis=0) / len(y)
        step = np.linalg.solve(np.block([[top, side[:, None]], [side[None, :], np.array([[v.mean()]])]]), np.append(gw, gb))
        w, b = w - step[:-1], b - float(step[-1])
        if np.abs(step).max() < 1e-8:
            break
    return ToxicModel(known, w, b, terms)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, max_chars: int = 20_000, kinds=IDENTITY) -> ToxicModel | None:
    """Fit on at most ``per_class`` labelled rows of each class (texts up to ``max_chars`` characters). None without labels.

    Ids with several labels count as toxic if any is; null labels and ids don't count.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(may_learn).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    picked = sample_by_class(marks, "label", F.col(id_col), per_class, 2 * per_class)
    rows = docs.where(F.length(text_col) <= max_chars).join(F.broadcast(picked), id_col).select("label", F.col(text_col).alias("t"))  # 2 * per_class rows at most
    got = sample_features(rows, kinds).toArrow()
    if not len(got):
        return None
    return fit(got.sort_by([("family", "ascending"), ("label", "descending")]), kinds=kinds)


def score_toxicity(docs: DataFrame, model: ToxicModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. Null and empty texts get the score of no evidence; without a model 0."""
    kept = docs.drop(out)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` double"])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.zeros(0)]
            for t in text_slices(batch.column(at)):
                w = words(t)
                got.append(model.scores(t.data, w) if model is not None else np.zeros(t.hi - t.lo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(np.concatenate(got), 9))], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs, labels, ~held_out)
    out = score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
