"""Exact, near, byte and word duplicates against plain versions, with odd rows of every kind."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from conftest import duck, rows_of

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from quaysift.llm import anchors, codes, exact_dedup, minhash_dedup, substring_dedup, suffix_dedup  # noqa: E402


def odd_texts(seed, n=120):
    """Copies, near copies, shared passages, periods, white space of all kinds, empty and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeü") for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, base = prose(40), prose(150).split(" ")
    texts = [None, "", " ", "\t\n", "a", "a b", "A b", "ab " * 300, "ü" * 500, "x" * 99, "x" * 100, "x" * 101, passage, passage]
    while len(texts) < n:
        kind = r.randint(0, 6)
        if kind == 0:
            texts.append(r.choice([t for t in texts if t]))
        elif kind == 1:
            near = list(base)
            for _ in range(r.randint(1, 12)):
                near[r.randrange(len(near))] = word()
            texts.append(" ".join(near))
        elif kind == 2:
            texts.append(prose(r.randint(0, 60)) + r.choice([" ", "\n", "  "]) + passage + " " + prose(r.randint(0, 60)))
        elif kind == 3:
            texts.append(r.choice([prose(3), "ab "]) * r.randint(1, 60))
        elif kind == 4:
            texts.append(passage[r.randint(0, 60) :] + passage)
        else:
            texts.append(prose(r.randint(1, 200)))
    r.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, docs):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(d, t, "x", 1, 2, None) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n long, m long, a string").repartition(3)


def given(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    docs = odd_texts(seed)
    for w, num in ((3, 85), (5, 80)):
        got = {tuple(r) for r in minhash_dedup.near_duplicates(frame(spark, docs), shingle_words=w, threshold=(num, 100)).collect()}
        assert got == brute.near(docs, w, num, 100)


def test_near_long_lists(spark, monkeypatch):
    """Lists with more open pairs than three texts have give up their values, and blocks have some four texts."""
    monkeypatch.setattr(minhash_dedup, "LONG", 3)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "BUNDLE", 2)
    docs = odd_texts(5)
    got = {tuple(r) for r in minhash_dedup.near_duplicates(frame(spark, docs), shingle_words=3, threshold=(85, 100)).collect()}
    assert got == brute.near(docs, 3, 85, 100)


def test_near_large_family(spark, monkeypatch):
    """A family of near copies over several blocks, some of them only linked through others, beside a passage in many texts."""
    monkeypatch.setattr(minhash_dedup, "LONG", 30)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, passage, texts = [word() for _ in range(80)], " ".join(word() for _ in range(25)), []
    for _ in range(80):
        near = list(base)
        for _ in range(r.randint(1, 5)):
            near[r.randrange(80)] = word()
        texts.append(" ".join(near))
    texts += [passage + " " + " ".join(word() for _ in range(r.randint(1, 12))) for _ in range(80)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    got = {tuple(x) for x in minhash_dedup.near_duplicates(frame(spark, docs), shingle_words=3, threshold=(85, 100)).collect()}
    assert got == brute.near(docs, 3, 85, 100) and len({x[2] for x in got}) > 10


def test_what_is_retained_instead():
    """Given-up values are left out while the others are enough, and the first in one order else."""
    u = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    keep = lambda late: minhash_dedup.retained_but(u, np.sort(late), 85, 100)
    assert keep(np.array([5], np.uint64)) is None and keep(np.zeros(0, np.uint64)) is None
    assert keep(u[:1]).tolist() == u[1:12].tolist()  # 11: one in a thousand is given up
    half = keep(u[::2])
    assert 15 < len(half) < 25 and not np.isin(half, u[::2]).any()
    assert len(keep(u)) == 151 and len(keep(u[100:])) == 151 and keep(u[100:])[:100].tolist() == u[:100].tolist()


@pytest.mark.parametrize("classes", [2, 1 << 16])
def test_bytes(spark, monkeypatch, classes):
    monkeypatch.setattr(anchors, "CLASSES", classes)
    docs = odd_texts(3)
    got = {tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, docs)).drop("kept").collect()}
    assert got == brute.byte_repeats(docs, 100)


@pytest.mark.parametrize("classes", [2, 1 << 16])
def test_words(spark, monkeypatch, classes):
    monkeypatch.setattr(anchors, "CLASSES", classes)
    docs = odd_texts(4)
    got = {tuple(r) for r in substring_dedup.remove_spans(frame(spark, docs)).drop("kept").collect()}
    assert got == brute.word_repeats(docs, 20)


def test_given(spark, sf):
    docs = given(spark, sf)
    assert {tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, sf).collect()} == brute.byte_repeats(docs, 100)
    assert {tuple(r) for r in substring_dedup.op10_substring_dedup(spark, sf).collect()} == brute.word_repeats(docs, 20)
    assert {tuple(r) for r in minhash_dedup.op1_minhash_dedup(spark, sf).collect()} == brute.near(docs, 3, 85, 100)


def test_exact(spark, sf):
    assert rows_of(exact_dedup.op6_exact_dedup(spark, sf).toPandas()) == rows_of(duck(exact_dedup.OP6_SQL, sf))
    docs = frame(spark, [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "a b "), (None, "a b"), (6, "z"), (6, "z")])
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 6, 2, True)}


def test_null_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(None, text), (None, text), (1, text), (2, text), (2, text), (3, None)])
    near = minhash_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    assert suffix_dedup.remove_repeats(docs).filter("doc_id IS NULL AND n_removed = 0").count() == 2
    assert substring_dedup.remove_spans(docs).filter("doc_id = 2 AND n_removed = n_words").count() == 2


def test_text_ids(spark):
    docs = odd_texts(6, 60)
    named = spark.createDataFrame([(f"d{d:03}", t) for d, t in docs], "name string, body string")
    got = {tuple(r) for r in suffix_dedup.remove_repeats(named, "name", "body").drop("kept").collect()}
    assert got == {(f"d{x[0]:03}", *x[1:]) for x in brute.byte_repeats(docs, 100)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for out in (exact_dedup.exact_dedup(none), minhash_dedup.near_duplicates(none), suffix_dedup.remove_repeats(none), substring_dedup.remove_spans(none)):
        assert out.count() == 0


def test_interval_scan():
    texts = [b"abcd", b"abce", b"abx", b"zz", b"abcd"]
    assert sorted((n, sorted(m)) for n, m in suffix_dedup.intervals(texts, 1)) == [(2, [0, 1, 2, 4]), (3, [0, 1, 4]), (4, [0, 4])]


def test_automaton():
    r = random.Random(1)
    for _ in range(50):
        old = [[r.choice("ab") for _ in range(r.randint(1, 12))] for _ in range(3)]
        new = [r.choice("abc") for _ in range(12)]
        a = substring_dedup.Automaton()
        for x in old:
            a.add(x)
        runs = {tuple(x[i:j]) for x in old for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max((n for n in range(i + 2) if n == 0 or tuple(new[i + 1 - n : i + 1]) in runs)) for i in range(12)]
        assert a.statistics(new) == want


def test_full_filters(spark, monkeypatch):
    """Filters that let everything through change no result."""
    monkeypatch.setattr(anchors, "may_repeat", lambda table, codes, bits: np.ones(len(codes), bool))
    docs = odd_texts(8, 80)
    assert {tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, docs)).drop("kept").collect()} == brute.byte_repeats(docs, 100)
    assert {tuple(r) for r in substring_dedup.remove_spans(frame(spark, docs)).drop("kept").collect()} == brute.word_repeats(docs, 20)


def test_texts_longer_than_a_piece(spark):
    """Texts of more bytes than are coded at once, which repeat parts of themselves and of each other."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(120_000)]
    long = " ".join(words)
    assert len(long) > 2 * codes.PIECE
    docs = [(0, long), (1, " ".join(words[40_000:100_000]) + " new end " + long[:5000]), (2, "short text"), (3, long[:3000] + " " + long[:3000]), (4, long + " x")]
    assert {tuple(x) for x in suffix_dedup.remove_repeats(frame(spark, docs)).drop("kept").collect()} == brute.byte_repeats(docs, 100)
    assert {tuple(x) for x in substring_dedup.remove_spans(frame(spark, docs)).drop("kept").collect()} == brute.word_repeats(docs, 20)
    assert {tuple(x) for x in minhash_dedup.near_duplicates(frame(spark, docs), shingle_words=3, threshold=(85, 100)).collect()} == brute.near(docs, 3, 85, 100)
