"""Near duplicates, decontamination, repeated bytes and line runs against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohera.llm import decontamination as dec
from cohera.llm import line_dedup as ld
from cohera.llm import near_dedup as nd
from cohera.llm import repeated_bytes as rb
from cohera.llm.textcore import text_slices, words


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = {}
    for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []:
        out[s] = out.get(s, 0) + 1
    return out


def similar(a, b):
    common = sum(min(n, b.get(s, 0)) for s, n in a.items())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def classes_of(texts, least=0.8):
    bags, up = [bag(t) for t in texts], list(range(len(texts)))
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if similar(bags[i], bags[j]) >= least:
                up[root(i)] = root(j)
    return {frozenset(i for i in range(len(texts)) if root(i) == r) for r in map(root, range(len(texts)))}


def family_texts(rng, families=6, size=12):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 200]))
        if f == 1:
            base = ["again"] * 60 + base[:30]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    return texts + ["", None, "!!!", "one", "One!", "a b c d", "a b c d e f", "long " * 20_000, "long " * 20_000 + "end"]


def test_near_duplicates_against_brute_force(spark):
    texts = family_texts(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class string")
    rows = nd.near_duplicates(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r["class"], set()).add(r.doc_id)
    assert len(rows) == len(texts) and {frozenset(s) for s in got.values()} == classes_of(texts)
    kept = {r.doc_id for r in nd.keep_one(docs).collect()}
    assert kept == {min(c) for c in classes_of(texts)}


def test_marks_bound_what_two_bags_share():
    """No bag holds fewer foreign shingles than the marks say, and a pair below the similarity is left out by them."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]

    def copy(edits):
        out = list(base)
        for i in rng.choice(150, edits, replace=False):
            out[i] = f"x{rng.integers(1 << 40)}"
        return " ".join(out)

    texts = [copy(e) for e in (0, 1, 2, 5, 5, 6, 6, 8, 8)]
    bag = [dict(zip(h.tolist(), c.tolist())) for h, c in ((x[1], x[2]) for x in (nd.bags(nd.words(next(nd.text_slices(pa.array([t]))))) for t in texts))]
    places = [{h: int((nd.mix(np.array([h], np.uint64)) >> nd.U(53))[0]) for h in b} for b in bag]
    assert nd.WORDS * 64 == 1 << 11
    left_out = 0
    for i in range(len(texts)):
        for j in range(len(texts)):
            seen = len({p for p in places[i].values()} - set(places[j].values()))
            alone = sum(n for h, n in bag[i].items() if h not in bag[j])
            assert seen <= alone
            left_out += nd.overlap(texts[i], texts[j]) < 0.8 and len(bag[i]) - seen < (0.8 / 1.8) * (len(bag[i]) + len(bag[j])) - 1e-6
    assert left_out >= 10


def test_pairs_of_a_crowd_that_is_not_similar_enough_are_not_verified(spark, monkeypatch):
    """Copies of one text with many own edits each: about 0.66 alike, no links, and hardly a pair gets as far as its texts."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(100):
        words_ = list(base)
        for i in rng.sample(range(150), 3):
            words_[i] = f"x{n}y{i % 7}"
        rows.append((n, " ".join(words_)))
    verified, real = [], nd._verify

    def counted(pairs, texts, least):
        verified.append(pairs.count())
        return real(pairs, texts, least)

    monkeypatch.setattr(nd, "_verify", counted)
    got = {r.doc_id: r["class"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true = [(i, j) for i in range(100) for j in range(i) if nd.overlap(rows[i][1], rows[j][1]) >= 0.8]
    assert all(got[i] == got[j] for i, j in true)
    assert verified[-1] < 300


def test_nodes_of_crowded_buckets_are_joined_once_not_once_a_bucket(spark, monkeypatch):
    """Near copies that meet in many buckets: tables that are joined by node have one row a node."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(40):
        words_ = list(base)
        for i in rng.sample(range(10, 110), 1 + n % 3):
            words_[i] = f"x{n}y{i}"
        rows.append((n, " ".join(words_)))
    sizes, real = {}, nd.Stored

    def stored(df, name):
        out = real(df, name)
        if "node" in out.df.columns:
            sizes[name] = (out.df.count(), out.df.select("node").distinct().count())
        return out

    monkeypatch.setattr(nd, "Stored", stored)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in nd.near_duplicates(docs).collect():
        got.setdefault(r["class"], set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == classes_of([t for _, t in rows])
    assert sizes["near-crowd"][0] > 5 * sizes["near-crowd"][1]  # the buckets' rows, where a node has many
    assert all(sizes[x][0] == sizes[x][1] for x in ("near-linkable", "near-loose"))


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(none).count() == 0 and nd.keep_one(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "A b c d e"), (1, "A b c d e")], "doc_id long, text string")
    assert [r.doc_id for r in nd.keep_one(rows).collect()] == [1]
    with pytest.raises(ValueError):
        nd.near_duplicates(rows, similarity=0.5)


def test_signatures_are_unbiased():
    rng = random.Random(2)
    off = []
    for _ in range(40):
        base = rng.choices([f"t{i}" for i in range(9)], k=120)  # many repeats: weights beyond one
        other = list(base)
        for _ in range(rng.randint(1, 12)):
            other[rng.randrange(120)] = "new"
        x, y = " ".join(base), " ".join(other)
        s = []
        for t in (x, y):
            row, h, count = nd.bags(words(next(text_slices(pa.array([t])))), 2)
            s.append(nd.signatures(row, h, count, 1, 600)[0])
        pair = lambda t: {k: sum(1 for i in range(len(t) - 1) if (t[i], t[i + 1]) == k) for k in zip(t, t[1:])}
        off.append((s[0] == s[1]).mean() - similar(pair(base), pair(other)))
    assert abs(np.mean(off)) < 0.012 and np.abs(off).max() < 0.1


def brute_windows(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for _, t in docs:
        w, hit, found = split(t), set(), set()
        for item, it in items:
            iw = split(it)
            m = min(10, len(iw))
            if m:
                wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)}
                for i in range(len(w) - m + 1):
                    if tuple(w[i : i + m]) in wins:
                        hit |= set(range(i, i + m))
                        found.add(str(item) if item is not None else "")
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("filter_rows", [0, 4_000_000])
def test_decontamination_against_brute_force(spark, filter_rows):
    rng = random.Random(4)
    vocabulary = ["a", "b", "cé", "d9", "e"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, text(rng.choice([0, 1, 3, 7, 9, 10, 11, 30, 60]))) for i in range(25)] + [(100, None), (None, "zz yy"), (3, "x " * 30), (101, "X, x! " * 20)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) not in (1, 3)]
    docs = [(i, text(rng.randint(0, 200))) for i in range(40)]
    for i in range(25):
        t = (items[i % len(items)][1] or "").split()
        a = rng.randint(0, max(0, len(t) - 12))
        docs.append((50 + i, text(20) + " " + " ".join(t[a : a + rng.randint(8, 40)]) + " " + text(20)))
    docs += [(90, None), (91, ""), (92, "x " * 500), (93, "ZZ-yy"), (94, text(30_000))]
    got = dec.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "n_hit").withColumnRenamed("n_hit", "doc_id"), spark.createDataFrame(items, "item_id long, text string"), filter_rows=filter_rows)
    rows = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()}
    assert [rows[i] for i, _ in docs] == brute_windows(docs, items)
    assert not any(r.contaminated for r in dec.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect())


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2, 4096])
def test_repeated_bytes_against_brute_force(spark, crowd):
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgé ", k=140))
    texts = [None, "", "short", "x" * 300, "ab" * 200, "ab" * 200 + "c"]
    for i in range(30):
        t = "".join(rng.choices("abcdefgé ", k=rng.randint(0, 120)))
        a = rng.randint(0, 30)
        p = list(passage[a : a + rng.randint(40, 110)])
        if i % 3 == 0:
            p[rng.randrange(len(p))] = "#"
        texts.append(t + "".join(p) + "".join(rng.choices("abcdefgé ", k=rng.randint(0, 60))))
    texts += [texts[10], texts[11] + "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rb.remove_repeats(docs, length=48, crowd=crowd).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got] == brute_repeats(texts, 48)
    assert rb.remove_repeats(docs.limit(0)).count() == 0


def test_a_crowd_compares_only_strings_that_its_neighbours_allow(spark, monkeypatch):
    """A passage in 60 texts that differ on both sides of it: a fragment leaves a few open strings, not one for each start."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgé ", k=150))
    texts = [t + passage + t[::-1] for t in ("".join(rng.choices("abcdefgé ", k=120)) for _ in range(60))] + [passage[:130], passage[20:]]
    seen, real = {}, rb.Stored

    def stored(df, name):
        out = real(df, name)
        seen[name] = out.df.count()
        return out

    monkeypatch.setattr(rb, "Stored", stored)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rb.remove_repeats(docs, length=128, crowd=6).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got] == brute_repeats(texts, 128)
    assert 0 < seen["repeat-solved"] < 12 * seen["repeat-shared"]


def test_copies_of_a_text_send_their_fragments_once(spark, monkeypatch):
    rng, sent = random.Random(4), spark.sparkContext.accumulator(0)
    cut = rb._cut

    def counted(length):
        run = cut(length)

        def each(batches):
            for b in run(batches):
                sent.add(len(b))
                yield b

        return each

    monkeypatch.setattr(rb, "_cut", counted)
    base = "".join(rng.choices("abcdef ", k=300))
    near = base[:150] + "#" + base[151:]
    numbers = []
    for copies in (1, 40):
        texts = [base] * copies + [near]
        before = sent.value
        got = rb.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=48).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got] == brute_repeats(texts, 48)
        numbers.append(sent.value - before)
    assert numbers[0] == numbers[1] > 0


def brute_lines(docs, least):
    order = sorted(range(len(docs)), key=lambda d: (docs[d][0] is not None, docs[d][0], hashlib.md5((docs[d][1] or "").encode()).digest()))
    lines = {d: [x.rstrip("\r") for x in (docs[d][1] or "").split("\n")] for d in order}
    full = {d: [i for i, x in enumerate(lines[d]) if re.findall("[^ \t]+", x)] for d in order}
    seen, gone = set(), {d: set() for d in order}
    for d in order:
        at = full[d]
        for a in range(len(at)):
            for b in range(a, len(at)):
                run = tuple(lines[d][i] for i in at[a : b + 1])
                if sum(len(re.findall("[^ \t]+", x)) for x in run) >= least:
                    if run in seen:
                        gone[d] |= set(at[a : b + 1])
                    seen.add(run)
    return [sorted(gone[d]) for d in range(len(docs))]


def test_line_runs_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choices(["u", "v", "w"], k=rng.randint(0, 6))) + f" {i}" * rng.randint(0, 1) for i in range(12)] + ["", "  "]
    docs = [(rng.randint(0, 60), "\n".join(rng.choices(pool, k=rng.randint(0, 14)))) for _ in range(40)]
    block = [pool[i % 12] for i in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8)]
    docs = list({(i, t): None for i, t in docs + [(70 + k, "\n".join(["x"] * k + block[k % 3 :] + ["y"])) for k in range(6)]})
    docs += [(200, None), (201, ""), (None, "\n".join(block)), (202, "\r\n".join(block)), (203, "\n".join(["z z"] * 300))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, no int")
    for least in (1, 7, 20):
        want = {(i, t): g for (i, t), g in zip(docs, brute_lines(docs, least))}
        rows = ld.repeated_lines(df, min_words=least).collect()
        got = {(r.id, bytes(r.content).hex()): list(r.gone) for r in rows}
        assert got == {(i, hashlib.md5((t or "").encode()).hexdigest()): g for (i, t), g in want.items() if g}
    out = {(r.doc_id, r.lines_deleted): r.text for r in ld.drop_repeated_lines(df, min_words=7).collect()}
    assert out[(200, 0)] is None and len(out) >= 1
    kept = [r for r in ld.drop_repeated_lines(df, min_words=7).where("doc_id = 203").collect()][0]
    assert kept.lines_before == 300 and kept.text.count("\n") == 300 - kept.lines_deleted - 1


def test_line_dedup_of_nothing(spark):
    assert ld.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
