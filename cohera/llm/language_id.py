"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its hashed byte 3- and 4-grams inside words (word borders included) and of its
words. Training is stochastic gradient descent in numpy on a bounded sample; since mean and softmax layer are both
linear before the softmax, scoring needs one logit per bucket and language, a table of fixed size that every task gets.

A softmax is sure of itself on text unlike anything it was trained on, so rejection looks at two things: the winning
probability, and the share of a text's subwords that no learned text has (its novelty). Both levels are calibrated.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.textcore import Texts, U, letters_in, mix, rows_of, runs, span_hashes, text_slices

BITS = 15  # 2^BITS hash buckets
DIM = 16
SEEN_BITS = 22  # 2^SEEN_BITS places of the set of learned subwords (half a megabyte)
PRIOR = 8  # subwords taken as known in every text, so that one new word does not make a short text foreign
UNKNOWN = "und"
SMALL = 1 << 18  # bytes of a slice in training, which shares its executor with other tasks
#: Letters (a-z and bytes of letters outside ASCII) stay, everything else is a word border.
AS_LETTER = np.full(256, 32, dtype=np.uint8)
AS_LETTER[97:123] = np.arange(97, 123)
AS_LETTER[128:] = np.arange(128, 256)


def subwords(t: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (one of 2^``bits``) of every subword of a slice and the n + 1 row offsets into them.

    A bucket of fewer bits is the leading part of one of more.
    """
    n = len(t.offs) - 1
    data = np.full(len(t.data) + n + 1, 32, dtype=np.uint8)
    data[np.arange(len(t.data)) + rows_of(t.offs) + 1] = AS_LETTER[t.data]
    offs = t.offs + np.arange(n + 1)
    letter = data != 32
    where, bucket = [], []
    wide = data.astype(np.uint64)
    for k in (3, 4):
        m = len(data) - k + 1
        if m <= 0:
            continue
        ok = letter[1 : 1 + m].copy()
        for j in range(2, k - 1):
            ok &= letter[j : j + m]
        at = np.flatnonzero(ok)
        g = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            g = (g << U(8)) | wide[at + j]
        where.append(at)
        bucket.append((g + U(k << 40)) * U(0x9E3779B97F4A7C15) >> U(64 - bits))
    starts, ends = runs(letter, np.array([0, len(data)]))
    where.append(np.maximum(starts - 1, 0))
    bucket.append(span_hashes(data, starts, ends) >> U(64 - bits))
    where, bucket = np.concatenate(where), np.concatenate(bucket).astype(np.int32)
    row = np.searchsorted(offs, where, "right") - 1
    order = np.argsort(row, kind="stable")
    return bucket[order], np.searchsorted(row[order], np.arange(n + 1))


@dataclass(frozen=True)
class LanguageModel:
    """Logits per bucket and language (bias included), the temperature of the scores, the probability below which and the
    novelty above which a text is rejected, and the learned subwords as a packed bit set (None: novelty is not judged)."""

    langs: tuple[str, ...]
    logits: np.ndarray
    temperature: float
    reject_below: float
    novel_above: float = 1.0
    seen: np.ndarray | None = None

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        z = mean_logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def mean_logits(table_: np.ndarray, bucket: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean logits per row; rows without subwords get zeros."""
    out = np.zeros((len(offs) - 1, table_.shape[1]))
    count = np.diff(offs)
    full = count > 0
    if full.any():
        for lang in range(table_.shape[1]):
            out[full, lang] = np.add.reduceat(table_[:, lang][bucket], offs[:-1][full], dtype=np.float64) / count[full]
    return out


def novelty(known: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of the subwords of each row that are not ``known``, with ``PRIOR`` known ones added."""
    strange = np.concatenate([[0], np.cumsum(~known)])[offs]
    return np.diff(strange) / (np.diff(offs) + PRIOR)


@dataclass
class Learned:
    """How many rows (up to 255), and which least and largest language, have a subword: three tables of fixed size."""

    rows: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, y: np.ndarray) -> Learned:
        size = 1 << SEEN_BITS
        got = cls(np.zeros(size, np.uint8), np.full(size, np.iinfo(np.int32).max, np.int32), np.full(size, -1, np.int32))
        for t in text_slices(texts, limit=SMALL):
            wide, offs = subwords(t, SEEN_BITS)
            key = np.unique((np.repeat(np.arange(len(offs) - 1), np.diff(offs)) << SEEN_BITS) | wide)
            at, lang = key & (size - 1), y[t.lo + (key >> SEEN_BITS)].astype(np.int32)
            each, n = np.unique(at, return_counts=True)
            got.rows[each] = np.minimum(got.rows[each] + n, 255)
            np.minimum.at(got.least, at, lang)
            np.maximum.at(got.largest, at, lang)
        return got

    def levels(self, texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Novelty of learned rows, each against the other rows, and against the rows of all languages but its own."""
        own, other = [], []
        for t in text_slices(texts, limit=SMALL):
            wide, offs = subwords(t, SEEN_BITS)
            lang = np.repeat(y[t.lo : t.hi], np.diff(offs))
            own.append(novelty(self.rows[wide] > 1, offs))
            other.append(novelty((self.least[wide] != lang) | (self.largest[wide] != lang), offs))
        return np.concatenate(own), np.concatenate(other)


def fit(texts: pa.Array, langs: list[str], least_examples: int = 36_000, rate: float = 2.0, seed: int = 7, accept: float = 0.998) -> LanguageModel:
    """Train on four fifths of the rows, calibrate on the rest. Rows are passed over six times at least, and until
    ``least_examples`` have been seen: small samples need more passes.

    The temperature minimises the log loss of the calibration rows. A text is rejected below the k-th smallest of their
    winning probabilities, k = (1 - ``accept``) (rows + 1) rounded down, so that a clean text is rejected with probability
    1 - ``accept`` at most (never by probability if k is 0); or above a level of novelty: each calibration row is compared
    with all other rows (a clean text) and with the rows of all other languages (a text of a language not learned). The
    level is the k-th largest of the clean ones (the largest if k is 0), moved half way up to the 5% quantile of the
    foreign ones where that lies higher. With fewer than five rows that have a letter nothing can be calibrated and
    nothing is rejected.
    """
    names = tuple(sorted(set(langs)))
    y = np.array([names.index(v) for v in langs], dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t in text_slices(texts, limit=SMALL):
        bucket, offs = subwords(t)
        key, n = np.unique((np.repeat(np.arange(len(offs) - 1), np.diff(offs)) << BITS) | bucket, return_counts=True)
        row = key >> BITS
        found.append(((key & ((1 << BITS) - 1)).astype(np.uint16), (n / np.diff(offs)[row]).astype(np.float32), np.bincount(row, minlength=len(offs) - 1)))
    ids_all, part_all, sizes = (np.concatenate(x) for x in zip(*found))  # a few large arrays, freed as a whole
    del found
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows = lambda i: slice(at[i], at[i + 1])
    keep = np.flatnonzero(sizes)
    rng = np.random.default_rng(seed)
    order = rng.permutation(keep)
    train, held = order[len(order) // 5 :], order[: len(order) // 5]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    passes = max(6, -(-least_examples // max(1, len(train))))
    steps, done = max(1, passes * len(train)), 0
    for _ in range(passes if len(train) else 0):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 16)):
            if not len(batch):
                continue
            lr = rate * max(0.05, 1 - done / steps)
            ids = np.concatenate([ids_all[rows(i)] for i in batch])
            part = np.concatenate([part_all[rows(i)] for i in batch])[:, None]
            of = np.repeat(np.arange(len(batch)), sizes[batch])
            starts = np.searchsorted(of, np.arange(len(batch)))
            hidden = np.add.reduceat(embed[ids] * part, starts, axis=0)
            z = hidden @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ weight.T
            weight -= lr * hidden.T @ p / len(batch)
            bias -= lr * p.mean(axis=0)
            np.add.at(embed, ids, -lr * part * back[of])
            done += len(batch)
    model = LanguageModel(names, (embed @ weight + bias).astype(np.float32), 1.0, 0.0)
    if not len(held):
        return model
    z = np.stack([part_all[rows(i)] @ model.logits[ids_all[rows(i)]] for i in held])

    def loss(t: float) -> float:
        p = LanguageModel(names, model.logits, t, 0.0).probabilities(z)
        return -np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-12)).mean()

    t = min((float(2.0**k) for k in np.arange(-3, 3.25, 0.25)), key=loss)
    best = np.sort(LanguageModel(names, model.logits, t, 0.0).probabilities(z).max(axis=1))
    learned = Learned.of(texts, y)
    clean, foreign = learned.levels(texts.take(pa.array(held)), y[held])
    k = int((1 - accept) * (len(held) + 1) + 1e-9)
    level = float(np.sort(clean)[-max(k, 1)])
    level = max(level, (level + float(np.quantile(foreign, 0.05, method="lower"))) / 2)
    return LanguageModel(names, model.logits, t, float(best[k - 1]) if k else 0.0, level, np.packbits(learned.rows > 0))


def sample_by_class(rows: DataFrame, label: str, key: Column, per_class: int, total: int) -> DataFrame:
    """About ``per_class`` rows of each label, ``total`` at most, picked by a hash of ``key``: no sort, no shuffle of texts."""
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()  # one row per label
    per_class = max(1, min(per_class, total // max(1, len(sizes))))
    u = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.coalesce(*[F.when(F.col(label) == r[label], F.lit(min(1.0, per_class / r["count"]))) for r in sizes], F.lit(0.0))
    return rows.where(u < rate).limit(total)


def train(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str, per_lang: int = 800, total: int = 8_000, max_chars: int = 20_000) -> LanguageModel | None:
    """Fit on a bounded sample of the rows that ``may_learn`` allows: at most ``per_lang`` rows a language and ``total``
    rows in all, of texts up to ``max_chars`` characters. None if there is nothing to learn from.

    One task learns from the sample; the driver only gets the finished model, about a megabyte for four languages."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars)).select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = sample_by_class(rows, "lang", F.col("i"), per_lang, total).select("text", "lang").coalesce(1).sortWithinPartitions("lang", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            whole = pa.Table.from_batches(got)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(whole["text"], whole["lang"].to_pylist()))], pa.binary())], names=["model"])

    made = sample.mapInArrow(learn, "model binary").collect()  # one row
    return pickle.loads(made[0]["model"]) if made else None


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted language, the calibrated probability of it and whether it is rejected.

    ``und`` with score 0, rejected, if the text is null, has no letter, or there is no model. Whole texts are read. Existing
    columns of the three names are replaced; all other columns pass through; an empty table gives no rows.
    """
    kept = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"])
    at = kept.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None if model is None or model.seen is None else np.unpackbits(model.seen).view(bool)
        for batch in batches:
            langs, probs, rejected = [], [], []
            column = batch.column(at)
            for t in text_slices(column):
                n = t.hi - t.lo
                if model is None:
                    langs += [UNKNOWN] * n
                    probs += [0.0] * n
                    rejected += [True] * n
                    continue
                wide, offs = subwords(t, SEEN_BITS)
                p = model.probabilities(mean_logits(model.logits, wide >> (SEEN_BITS - BITS), offs))
                strange = np.zeros(n) if seen is None else novelty(seen[wide], offs)
                ascii_letters = np.concatenate([[0], np.cumsum((t.data >= 97) & (t.data <= 122))])[t.offs]
                for i in range(n):
                    known = ascii_letters[i + 1] > ascii_letters[i] or letters_in(column[t.lo + i].as_py() or "")
                    best = int(p[i].argmax())
                    langs.append(model.langs[best] if known else UNKNOWN)
                    probs.append(round(float(p[i, best]), 9) if known else 0.0)
                    rejected.append(not known or p[i, best] < model.reject_below or strange[i] > model.novel_above)
            new = [pa.array(langs, pa.string()), pa.array(probs, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return kept.mapInArrow(score, schema)


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, F.coalesce(~held_out, F.lit(False)), "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return out.drop("text")
