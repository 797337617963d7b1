"""Packed sequences hold the tokenizer's ids of every text once, in order, without gaps, with hardly any padding."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from cohera.llm.packing import Bins, Encoder, pack, pieces, word_starts
from cohera.llm.registry import QUERIES, table
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "\n\n x  y\t z", "a b  c　 d   e", "don't  we'll <|endoftext|> x<|endoftext|>", "\u0085 a\u0085 b", "é è  à", "日本 語 です",
    "😀 😀😀  x", "12 345,6 7", "word " * 30_000, "x" * 5_000, "tail ", "à, é! (x)×. ÷- y÷. a|b <|endoftext|>, it's-x'S _a_b 5% \u00b7.", " \x1c a\x1f b", "a\r\n\r\n b", "tie", "tie",
]


def ids_of(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, expected, capacity):
    """``rows``: (doc, start, ids, doc_tokens, sequence, offset); returns the share of padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, seq, at in rows:
        docs[doc].append((start, ids, total))
        sequences[seq].append((at, len(ids)))
    assert set(docs) == set(expected)
    for doc, parts in docs.items():
        got = []
        for start, ids, total in sorted(parts, key=lambda p: p[0]):
            assert start == len(got) and total == len(expected[doc])
            got += ids
        assert got == expected[doc]
    used = padded = 0
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end and n > 0
            end += n
        assert end <= capacity
        used += end
        padded += 0 if end & (end - 1) == 0 else capacity - end
    return padded / used


def collect(df):
    return [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in df.collect()]


@pytest.mark.parametrize("capacity,smallest", [(2048, 64), (64, 8), (8, 1)])
def test_odd_texts(spark, capacity, smallest):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, start int, ids string").repartition(3)
    rows = collect(pack(docs, PATH, capacity=capacity, smallest=smallest))
    assert check(rows, dict(enumerate(ids_of(ODD))), capacity) < 0.02


def test_real_documents(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    expected = dict(zip(texts, ids_of(texts.values())))
    rows = collect(pack(docs.repartition(4), PATH))
    assert check(rows, expected, 2048) < 0.005
    assert len(rows) < 6 * len(texts) + sum(len(v) // 2048 for v in expected.values())
    out = {(r.doc_id, r.start): r for r in QUERIES["op13_harmonic_packing"](spark, SF).collect()}
    import zlib

    for (doc, start), r in out.items():
        part = np.array(expected[doc][start : start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length and r.doc_tokens == len(expected[doc])


def test_words_forgotten_are_the_same():
    texts = ODD * 2
    data = "".join(t or "" for t in texts).encode()
    offs = np.append(0, np.cumsum([len((t or "").encode()) for t in texts]))
    for memory in (0, 3, 1000):
        e = Encoder(PATH, memory)
        for _ in range(2):
            ids, rows = e(np.frombuffer(data, np.uint8), offs)
            assert [[*ids[rows[i] : rows[i + 1]], 1] for i in range(len(texts))] == ids_of(texts)


def test_cuts_and_bins():
    for n in range(1, 5000, 7):
        got = pieces(n)
        assert sum(s for _, s in got) == n and all(a == sum(s for _, s in got[:i]) for i, (a, _) in enumerate(got))
        assert all(s & (s - 1) == 0 for _, s in got[:-1])
    b = Bins(16, 4, 3)
    full = [x for i in range(9) if (x := b.put((i, 0, np.arange(5), 5)))]
    assert [len(x) for x in full] == [3, 3, 3] and {p[4] >> 36 for x in full for p in x} == {3}
    assert b.put((9, 0, np.arange(3), 3)) == [] and [[len(p[2]) for p in s] for s in b.finish()] == [[2], [1]]
    assert len(word_starts(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_nothing_and_bad_parameters(spark):
    assert pack(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0
    rows = collect(pack(spark.createDataFrame([(None, None), (None, "a b")], "doc_id string, text string"), PATH))
    assert sum(r[3] for r in rows) >= 2
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id string, text string"), PATH, capacity=1000)
