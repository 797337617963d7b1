"""Token counts under a unigram vocabulary by dynamic programming on a trie of distinct pre-tokens.

A pre-token is a word with the space before it. The distinct pre-tokens of a slice form a trie; the forward score of a
node (the best sum of piece scores that spells the prefix) is computed once, however many words share the prefix, level
by level over all nodes of a depth; where a word ends, the number of pieces on its best path is stored. Counts of words
already met in a task are looked up. No row leaves its task: a document's count is a sum over its words.

A unigram model file brings log-probabilities. The scores of a BPE file are merge ranks and can't be added, so only its
pieces are used: their log-probabilities are estimated from all documents by expectation maximisation over the table of
distinct pre-tokens and their counts (:func:`estimated`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored
from cohera.llm.textcore import BYTE, U, Texts, _P, _PI, is_in, mix, rows_of, runs, span_hashes, text_slices

MARK = 32  # the byte that stands for the space before a word; no word contains it
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
MEMORY = 500_000  # word counts that a task keeps (16 bytes each); words beyond are counted again when they come again
FILTER_BITS = 22
#: What a character without a piece costs beyond the worst piece; it is then spelled in one token per byte.
NO_PIECE = 10.0
ROUNDS = 4  # of expectation maximisation
UNIT = 1 << 16  # expected counts are added in whole parts of 1 / UNIT, so that their sum has no order
HELD = 200_000  # words that a task merges before it sends them on
CHUNK = 1 << 20  # bytes of words that are segmented together


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by hash (sorted), their scores, and a bit filter on the hashes. Its size is that of the vocabulary file."""

    hashes: np.ndarray
    scores: np.ndarray
    filter: np.ndarray
    longest: int
    no_piece: float

    @staticmethod
    def of(pieces: dict[bytes, float]) -> Vocabulary:
        raw = [p for p in pieces if p]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in raw])
        h = span_hashes(data, ends - [len(p) for p in raw], ends)
        order = np.argsort(h)
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        bits[h >> U(64 - FILTER_BITS)] = True
        scores = np.array([pieces[p] for p in raw])
        return Vocabulary(h[order], scores[order], bits, max(map(len, raw)), float(scores.min()) - NO_PIECE)

    @staticmethod
    def from_sentencepiece(path: str) -> Vocabulary:
        """Pieces and scores of a unigram model file (see :func:`pieces_of`)."""
        return Vocabulary.of(pieces_of(path))


def pieces_of(path: str) -> dict[bytes, float]:
    """Pieces and scores of a model file; control, unknown and byte pieces spell no text and are left out, as are
    pieces with a space anywhere but at their start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            p = sp.id_to_piece(i).replace("▁", " ")
            if p and " " not in p[1:]:
                pieces[p.encode()] = sp.get_score(i)
    return pieces


def are_ranks(pieces: dict[bytes, float]) -> bool:
    """Whether the scores are merge ranks: whole numbers, which log-probabilities are not."""
    return all(float(x).is_integer() for x in pieces.values())


def expected_counts(words: list[bytes], counts: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Expected uses of each piece (in the order of ``v.hashes``, times UNIT) over all segmentations of the words.

    The edges of all words are ordered by the depth at which they end; forward and backward sums take a depth at a time.
    """
    size = np.array([len(w) + 1 for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    depth = np.arange(len(data)) - begin[of]
    left = size[of] - depth
    edges = []
    for k in range(1, v.longest + 1):
        at = np.flatnonzero(left >= k)
        h = span_hashes(data, at, at + k)
        may = v.filter[h >> U(64 - FILTER_BITS)]
        at, h = at[may], h[may]
        hit = is_in(h, v.hashes)
        edges.append((at[hit], np.full(int(hit.sum()), k), np.searchsorted(v.hashes, h[hit])))
    head = np.flatnonzero((data & 0xC0) != 0x80)  # whole characters as bytes
    edges.append((head, np.diff(np.append(head, len(data))), np.full(len(head), -1)))
    at, k, piece = (np.concatenate(x).astype(np.int64) for x in zip(*edges))
    score = np.where(piece < 0, v.no_piece, v.scores[piece])
    node = begin + np.arange(len(words))  # a word has a node more than bytes
    source = at + of[at]
    target = source + k
    forward, backward = np.full(len(data) + len(words), -np.inf), np.full(len(data) + len(words), -np.inf)
    forward[node], backward[node + size] = 0.0, 0.0

    def sweep(total: np.ndarray, here: np.ndarray, there: np.ndarray, level: np.ndarray) -> None:
        order = np.lexsort((here, level))
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        for part in np.split(order, cuts):
            x, to = total[there[part]] + score[part], here[part]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(x, first)
            base = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                total[to[first]] = base + np.log(np.add.reduceat(np.exp(x - np.repeat(base, np.diff(np.append(first, len(x))))), first))

    if len(at):
        sweep(forward, target, source, depth[at] + k)
        sweep(backward, source, target, left[at])
    share = np.exp(forward[source] + score + backward[target] - backward[node][of[at]])
    used = np.flatnonzero(piece >= 0)
    out = np.zeros(len(v.hashes), dtype=np.int64)
    np.add.at(out, piece[used], np.rint(share[used] * UNIT).astype(np.int64) * counts[of[at[used]]])
    return out


def word_table(docs: DataFrame, text_col: str = "text") -> Stored:
    """Distinct pre-tokens of all texts with their counts: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        room = 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in text_slices(batch.column(0), lower=False, limit=1 << 20):
                starts, ends = runs(~SPACES[t.data], t.offs)
                _, first, n = np.unique(span_hashes(t.data, starts, ends), return_index=True, return_counts=True)
                raw = t.data.tobytes()
                for a, b, c in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
                    w = raw[a:b]
                    if w not in held:
                        room += len(w)
                    held[w] = held.get(w, 0) + c
                if len(held) > HELD or room > 32 * CHUNK:
                    yield pack()
                    held.clear()
                    room = 0
        yield pack()

    words = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = Stored(words, "token-words")
    size = words.df.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    spread = Stored(words.df.repartition(1 + size // CHUNK), "token-words-spread")  # the rounds take long for their bytes
    words.drop()
    return spread


def estimated(docs: DataFrame, pieces: list[bytes], text_col: str = "text", rounds: int = ROUNDS) -> Vocabulary:
    """Unigram log-probabilities of the pieces from all texts: ``rounds`` of expectation maximisation from equal ones.

    Every piece counts once more than it is expected, so unseen pieces have a score, and of no text all are equal.
    """
    v = Vocabulary.of(dict.fromkeys(pieces, -float(np.log(len(pieces)))))
    words = word_table(docs, text_col)

    def expect(v: Vocabulary):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(v.hashes), dtype=np.int64)
            for batch in batches:
                size = np.cumsum([len(w.as_py()) + 1 for w in batch.column(0)])
                cuts = [0, *(np.flatnonzero(np.diff(size // CHUNK)) + 1).tolist(), len(batch)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        total += expected_counts(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_numpy(), v)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["piece", "n"])

        return run

    for _ in range(rounds):
        got = words.df.mapInArrow(expect(v), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row a piece
        n = np.ones(len(v.hashes))
        n[got["piece"].to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=np.float64) / UNIT
        scores = np.log(n / n.sum())
        v = Vocabulary(v.hashes, scores, v.filter, v.longest, float(scores.min()) - NO_PIECE)
    words.drop()
    return v


def count_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Tokens of each word (spans of ``data``, the mark before each is implied) on its best path.

    Of paths with equal scores the one whose last piece is longer wins, at every node.
    """
    out = np.zeros(len(starts), dtype=np.int64)
    length = ends - starts
    width = v.longest + 1
    # column j of a row: the ancestor j levels up (score, tokens, prefix hash); -inf where there is none
    score = np.full((1, width), -np.inf)
    tokens = np.zeros((1, width), dtype=np.int64)
    prefix = np.zeros((1, width), dtype=np.uint64)
    score[0, 0] = 0.0
    need, size = np.zeros(1, dtype=np.int8), np.ones(1, dtype=np.int8)
    alive, node = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    down, scale = [U(1)], 1 << 64
    up_i, down_i = 1, 1
    depth = 0
    while len(alive):
        byte = np.full(len(alive), MARK, dtype=np.int64) if depth == 0 else data[starts[alive] + depth - 1].astype(np.int64)
        key, at = np.unique(node * 256 + byte, return_inverse=True)
        parent, b = key >> 8, (key & 255).astype(np.uint8)
        depth += 1
        n = len(key)
        shift = lambda a, fill: np.concatenate([np.full((n, 1), fill, a.dtype), a[parent, :-1]], axis=1)
        old = prefix[parent, 0]
        score, tokens, prefix = shift(score, -np.inf), shift(tokens, 0), shift(prefix, 0)
        prefix[:, 0] = old + BYTE[b] * U(up_i)
        up_i = up_i * _P % scale
        down_i = down_i * _PI % scale
        down.append(U(down_i))
        lead = np.where(b < 0x80, 1, np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))).astype(np.int8)
        inner = (b & 0xC0) == 0x80
        need, size = np.where(inner, need[parent] - 1, lead - 1).astype(np.int8), np.where(inner, size[parent], lead).astype(np.int8)
        best, used = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
        for k in range(min(v.longest, depth), 0, -1):
            rows = np.flatnonzero(score[:, k] > -np.inf)
            h = mix((prefix[rows, 0] - prefix[rows, k]) * down[depth - k] + U(k * 0xA0761D6478BD642F % scale))
            may = v.filter[h >> U(64 - FILTER_BITS)]
            rows, h = rows[may], h[may]
            hit = is_in(h, v.hashes)
            rows, h = rows[hit], h[hit]
            s = score[rows, k] + v.scores[np.searchsorted(v.hashes, h)]
            win = s > best[rows]
            best[rows[win]], used[rows[win]] = s[win], tokens[rows[win], k] + 1
        for k in range(1, 5):  # a whole character as bytes
            rows = np.flatnonzero((need == 0) & (size == k))
            if k < width and len(rows):
                s = score[rows, k] + v.no_piece
                win = s > best[rows]
                best[rows[win]], used[rows[win]] = s[win], tokens[rows[win], k] + k
        score[:, 0], tokens[:, 0] = best, used
        done = length[alive] == depth - 1
        out[alive[done]] = used[at[done]]
        alive, node = alive[~done], at[~done]
    return out


class Counter:
    """Token counts of slices, with a bounded memory of words."""

    def __init__(self, v: Vocabulary, memory: int = MEMORY):
        self.v, self.memory = v, memory
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each row."""
        starts, ends = runs(~SPACES[t.data], t.offs)
        offs = np.searchsorted(starts, t.offs)
        h, first, at = np.unique(span_hashes(t.data, starts, ends), return_index=True, return_inverse=True)
        counts = np.zeros(len(h), dtype=np.int64)
        old = is_in(h, self.known)
        counts[old] = self.counts[np.searchsorted(self.known, h[old])]
        new = np.flatnonzero(~old)
        if len(new):
            counts[new] = count_words(t.data, starts[first[new]], ends[first[new]], self.v)
            room = self.memory - len(self.known)
            if room > 0:
                add = new[:room]
                keys, values = np.concatenate([self.known, h[add]]), np.concatenate([self.counts, counts[add]])
                order = np.argsort(keys, kind="stable")
                self.known, self.counts = keys[order], values[order]
        n = len(t.offs) - 1
        return np.diff(offs), np.bincount(rows_of(offs), weights=counts[at], minlength=n).astype(np.int64)


def count_tokens(docs: DataFrame, v: Vocabulary, text_col: str = "text", names: tuple[str, str] = ("n_pretokens", "n_tokens")) -> DataFrame:
    """``docs`` with the number of pre-tokens and of tokens of every whole text; null and blank texts have none.

    Columns of the two names are replaced; all others pass through; an empty table gives no rows.
    """
    kept = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema), f"`{names[0]}` long, `{names[1]}` long"])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(v)
        for batch in batches:
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            got += [counter(t) for t in text_slices(batch.column(at), lower=False, limit=1 << 20)]
            new = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*got)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    docs, pieces = table(spark, sf_dir, "documents"), pieces_of(vocabulary)
    v = estimated(docs, list(pieces)) if are_ranks(pieces) else Vocabulary.of(pieces)
    out = count_tokens(docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), v)
    return out.select("doc_id", "n_bytes", "n_pretokens", "n_tokens")
