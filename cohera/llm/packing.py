"""Token sequences of fixed capacity by harmonic packing.

Lengths belong to reciprocal-capacity classes: class k holds lengths above C / (k + 1) up to C / k, and a bin of class k
is full with k pieces, whatever the others hold. A document is cut into pieces of exactly C, C / 2, C / 4, ... down to
``smallest`` and a rest below that. Exact pieces fill their bins without padding; the rests, short as they are, leave
less than ``smallest`` of C open. Every task fills bins of its own and keeps only the open ones (fewer than k pieces a
class), so there is no shuffle and no shared state. When a task ends, rests in open bins are cut into powers of two, and
the open exact bins are closed as sequences whose lengths are powers of two, which need no padding.

Ids come from the ``tokenizers`` file, for every distinct word of a slice once: no match of the splitting pattern has a
character that is no white space before one that is, nor a letter or digit before a sign other than an apostrophe, so a
text may be cut there and its ids are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.textcore import is_in, span_hashes, text_slices

CAPACITY = 2048
SMALLEST = 64  # exact pieces are not cut below this length, but for the rests of a task's last bins
END = 1  # the id after each document
MEMORY = 1_000_000  # words whose ids a task keeps; others are looked up again when they come again
OUT_BYTES = 4 << 20
TASK_BITS = 36  # sequence ids: the task's number above this many bits, the number in the task below
#: White space of ASCII, with the four separators that some engines count as such.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


#: ASCII signs before which a word may be cut; the bar is part of the file's special token.
SIGN = np.zeros(256, dtype=bool)
SIGN[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'|"]] = True
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[i for i in range(128) if chr(i).isalnum()]] = True


def word_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts may be cut: at row starts, at ASCII white space after a character that is certainly no white space, and
    at signs after what is certainly a letter (ASCII or Latin-1) or a digit."""
    n = len(data)
    start = np.zeros(n + 1, dtype=bool)
    if n > 1:
        before = data[:-1]
        plain = ~ASCII_SPACE[before]
        second, third = np.zeros(n - 1, np.uint8), np.zeros(n - 1, np.uint8)
        second[1:], third[2:] = data[:-2], data[:-3]
        wide = (before >= 0x80) & ((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3)))  # Unicode spaces among others
        letter = PLAIN[before] | ((second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        start[1:n] = (ASCII_SPACE[data[1:]] & plain & ~wide) | (SIGN[data[1:]] & letter)
    start[offs[:-1][offs[1:] > offs[:-1]]] = True
    return np.flatnonzero(start[:n])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process: the words it remembers serve the next task too."""
    return Encoder(path)


class Encoder:
    """Ids of texts by a tokenizer file, word by word, with a bounded memory of words."""

    def __init__(self, path: str, memory: int = MEMORY):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.spans = np.zeros((0, 2), np.int64)  # place and number of the ids of each known word

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(g) for g in got], dtype=np.int64)
        return np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(sizes.sum())), sizes

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, one after the other, and the n + 1 offsets of the rows."""
        starts = word_starts(data, offs)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        h, first, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        old = is_in(h, self.known)
        new = np.flatnonzero(~old)
        raw = data.tobytes()
        ids, sizes = self._encode([raw[starts[i] : ends[i]].decode() for i in first[new]]) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # the ids of the slice's words: those known first, then the new ones
        base, place = len(self.ids), np.zeros(len(h), dtype=np.int64)
        count = np.zeros(len(h), dtype=np.int64)
        k = np.searchsorted(self.known, h[old])
        place[old], count[old] = self.spans[k, 0], self.spans[k, 1]
        place[new], count[new] = base + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([self.ids, ids])
        n = count[at]
        edge = np.append(0, np.cumsum(n))
        pick = np.repeat(place[at] - edge[:-1], n) + np.arange(edge[-1])
        rows = edge[np.searchsorted(starts, offs)]
        if 0 < len(new) <= self.memory - len(self.known):
            keys = np.concatenate([self.known, h[new]])
            spans = np.concatenate([self.spans, np.stack([place[new], sizes], axis=1)])
            order = np.argsort(keys, kind="stable")
            self.known, self.spans, self.ids = keys[order], spans[order], pool
        return pool[pick], rows


def pieces(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids: whole capacities, powers of two, a rest."""
    out, at = [(a, capacity) for a in range(0, n - capacity + 1, capacity)], n - n % capacity
    size = capacity >> 1
    while size >= smallest:
        if n - at >= size:
            out.append((at, size))
            at += size
        size >>= 1
    if at < n:
        out.append((at, n - at))
    return out


@dataclass
class Bins:
    """The open bins of one task. ``put`` returns the pieces of a bin that has just become full."""

    capacity: int
    smallest: int
    task: int
    closed: int = 0
    open: dict = field(default_factory=dict)

    def _close(self, members: list) -> list:
        number = (self.task << TASK_BITS) + self.closed
        self.closed += 1
        out, at = [], 0
        for piece in members:
            out.append((*piece, number, at))
            at += len(piece[2])
        return out

    def put(self, piece: tuple) -> list:
        """``piece``: (document, start, ids, ids of the document)."""
        n = len(piece[2])
        kind = (n & (n - 1) == 0 and n >= self.smallest, self.capacity // n)
        held = self.open.setdefault(kind, [])
        held.append(piece)
        if len(held) < kind[1]:
            return []
        del self.open[kind]
        return self._close(held)

    def finish(self) -> Iterator[list]:
        """Close what is open: rests are cut into powers of two, and equal powers form sequences of a power of two."""
        rests = [p for (exact, _), held in self.open.items() if not exact for p in held]
        self.open = {kind: held for kind, held in self.open.items() if kind[0]}
        self.smallest = 1
        for doc, start, ids, total in rests:
            for a, size in pieces(len(ids), self.capacity, 1):
                full = self.put((doc, start + a, ids[a : a + size], total))
                if full:
                    yield full
        for _, held in sorted(self.open.items()):
            while held:
                part = 1 << (len(held).bit_length() - 1)
                yield self._close(held[:part])
                held = held[part:]
        self.open = {}


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, smallest: int = SMALLEST, end: int = END,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Every id of a document lies in one piece; a sequence's pieces follow each
    other from offset 0. Rows repeated, also with one id, are documents of their own; null ids are kept; other columns
    are not looked at; an empty table gives no rows. ``capacity`` and ``smallest`` are powers of two.
    """
    if min(capacity, smallest) < 1 or capacity & (capacity - 1) or smallest & (smallest - 1) or smallest > capacity:
        raise ValueError("capacity and smallest must be powers of two, and smallest no larger than capacity")
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, doc_type = encoder_of(tokenizer), None
        bins, ready, room = Bins(capacity, smallest, TaskContext.get().partitionId()), [], 0

        def flush() -> pa.RecordBatch:
            doc, start, ids, total, number, at = zip(*ready)
            columns = [
                pa.array(doc, doc_type), pa.array(start, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array(at, pa.int64()),
            ]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for t in text_slices(batch.column(1), lower=False, limit=1 << 20):
                ids, rows = encoder(t.data, t.offs)
                for i, doc in enumerate(batch.column(0)[t.lo : t.hi].to_pylist()):
                    own = np.append(ids[rows[i] : rows[i + 1]], np.uint32(end)).astype("<u4")
                    for a, size in pieces(len(own), capacity, smallest):
                        full = bins.put((doc, a, own[a : a + size].copy(), len(own)))
                        ready += full
                        room += sum(4 * len(p[2]) for p in full)
                    if room > OUT_BYTES:
                        yield flush()
                        room = 0
        for full in bins.finish():
            ready += full
        if ready:
            yield flush()

    out = slim.mapInArrow(run, f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)


@query("op13_harmonic_packing")
def op13(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
