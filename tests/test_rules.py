"""Many rules through the gram index, and rules over chunks through automata."""

import random
import re

import numpy as np
import pytest

from quaysift import lookups
from quaysift.operators import matching as M
from quaysift.operators import rules as R

BITS = ["the ", "then", "a", "ab", " und", "pour", "é", "日本", "\n", "cat", "3", ".", " "]


def texts(seed, n=120):
    r = random.Random(seed)
    return [(i, "".join(r.choice(BITS) for _ in range(r.randint(0, 40)))) for i in range(n)] + [(500, ""), (501, None)]


RULES = [
    (0, "lit", "literal", "the then"), (1, "short", "literal", "é"), (2, "two", "literal", "ab"), (3, "wide", "literal", "日本日"), (4, "cls", "regex", "[0-9]+"), (5, "mix", "regex", "then[ a]*und"), (6, "opt", "regex", "cat3?pour"), (7, "grp", "regex", "(cat|pour)+a"),
    (8, "hex", "hex", "706F7572"), (9, "hex2", "hex", "E697"), (10, "broken", "regex", "(["), (11, "odd", "hex", "XX"), (12, "flag", "regex", "(?i)THE"), (13, "rep", "regex", "(?:ab){2,3}c"), (14, "esc", "regex", r"cat\.the"), (15, "same", "literal", "the then"), (16, "nul", "literal", ""),
]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_many_equals_one_by_one(spark, seed):
    """The same rows as conditions for each rule, for lists and tables, with invalid rules, equal rules and rules of one byte."""
    files = spark.createDataFrame(texts(seed), "file_id long, content string").repartition(3)
    want = found(M.match_rules(files, RULES))
    assert found(R.match_many(files, RULES)) == want and want
    table = spark.createDataFrame(RULES, "ordinal int, rule_id string, kind string, pattern string")
    assert found(R.match_many(files, table)) == want
    clash = files.withColumnsRenamed({"file_id": "ordinal", "content": "pattern"})
    assert [r[0] for r in found(R.match_many(clash.withColumnRenamed("ordinal", "kind"), RULES[:1], "kind", "pattern"))] == [r[0] for r in want if r[1] == 0]
    assert found(R.match_many(files.limit(0), RULES)) == [] and found(R.match_many(files, [])) == []
    with pytest.raises(ValueError, match="more than 3"):
        R.match_many(files, RULES, most=3)


def test_many_rules_plan(spark):
    """Two thousand literals: no condition a rule in the plan, and texts are tried only on rules whose key they have."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(2000)]
    rules = [(i, f"r{i}", "literal", w) for i, w in enumerate(words)]
    docs = [(i, " ".join(r.sample(words, 3)) + " filler" * 50) for i in range(60)]
    files = spark.createDataFrame(docs, "file_id long, content string")
    df = R.match_many(files, rules)
    assert found(df) == sorted((i, k, f"r{k}") for i, t in docs for k, w in enumerate(words) if w in t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ontains(") < 10 and "Exchange hashpartitioning" not in plan


def test_required():
    of = lambda p: R.required((0, "", "regex", p)).decode()
    assert [of(p) for p in ("the [a-z]+ the", "abc+d", "ab?cd", "x{2}yz", r"a\.bcd", "(ab)cd", "ab|cd", "abc{0,2}", "(?i)abc", "[a&&[b]]cd", r"\Qab\E", r"\p{L}abc", "a{3}")] == ["the ", "abc", "cd", "yz", "a.bcd", "abcd", "", "ab", "", "", "", "", "a"]
    for p in ("the [a-z]+ the", "ab?cd", "(ab)+cd", "a(b|c)def", "(?:x*y)+z{2,}w"):
        need, r = of(p), random.Random(p)
        for _ in range(3000):
            t = "".join(r.choice("abcdefthe xyzw") for _ in range(12))
            assert not re.search(p, t) or need in t


PATTERNS = ["the [a-z]+ the", "a.b", "[^a]b", "(cat|po+ur){1,2}a?3", "日.*é", r"\d+\.", "ab*?c|then", "[é日]a", "x*", "(?:a|ab)(?:c|bcd)", r"\w\s\w", "[a-c0-9]{3}"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_automata(pattern):
    """An automaton says what a search says, on whole texts and put together from chunks of any size."""
    table = R.automaton((0, "r", "regex", pattern))
    for _, t in texts(pattern, 200):
        data, want = (t or "").encode(), re.search(pattern, t or "", re.ASCII) is not None
        last = len(table) - 1
        if not data:
            continue
        assert (R.effect(table, data)[0] == last) == want, t
        for size in (1, 2, 7):
            state = 0
            for i in range(0, len(data), size):
                state = R.effect(table, data[i : i + size])[state]
            assert (state == last) == want, t


def test_automata_refuse():
    for pattern in ("^a", "a$", r"\bthe", "(a)\\1", "(?=a)b", "(?i)a", "[^é]", "a{1000}{1000}"):
        with pytest.raises((ValueError, re.error)):
            R.automaton((0, "r", "regex", pattern))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_chunks_equal_whole_texts(spark, size):
    rules = [*lookups.RULES, (5, "wide", "literal", "日本"), (6, "cut", "hex", "97A5E6"), (7, "broken", "regex", "([")]
    docs = [(i, " ".join(t for _, t in texts(i, 6) if t) + " the a und the" * (i % 3)) for i in range(20)]
    whole = spark.createDataFrame(docs, "file_id long, content string")
    cut = [(i, k, bytearray(t.encode()[k * size : k * size + size]), "x") for i, t in docs for k in range(-(-len(t.encode()) // size))] + [(3, 10_000_000, None, "x"), (99, 0, bytearray(b""), "x")]
    random.Random(size).shuffle(cut)
    chunks = spark.createDataFrame(cut, "file_id long, chunk_idx int, chunk binary, rule string").repartition(4)
    want = found(M.match_rules(whole, rules))
    assert found(R.scan_chunks(chunks, rules)) == want and want
    assert found(R.scan_chunks(chunks.limit(0), rules)) == [] and found(R.scan_chunks(chunks, [])) == []


def test_effects_side_by_side():
    """Effects of many chunks at once, in pieces and of all lengths, are those of each chunk by itself, and are made in far less time."""
    import time

    r = random.Random(3)
    patterns = [("literal", " the "), ("regex", "the [a-z]+ the"), ("hex", "20706F757220"), ("regex", "(ab|b)*c{2,3}"), ("regex", "a[^b]*b"), ("regex", "x*"), ("literal", "aaab")]
    tables = [R.automaton((i, "r", *p)) for i, p in enumerate(patterns)]
    m = R.Automata(tables)
    words = [" the ", "the", " pour ", "ab", "b", "cc", "aaa", "aaab", "xyz ", "é"]
    chunks = ["".join(r.choices(words, k=k)).encode()[: r.choice((1, 2, 50, 9999))] for k in (1, 2, 5, 40, 900, 3000) for _ in range(20)] + [b"", b"a" * 5000, b"a" * R.PIECE, b"b" * (R.PIECE + 1)]
    got = m.effects(chunks)
    for row, chunk in zip(got, chunks, strict=True):
        want = np.concatenate([R.effect(t, chunk).astype(int) + f for t, f in zip(tables, m.first, strict=True)])
        assert row.tolist() == want.tolist()
    assert m.effects([]).shape == (0, m.total)
    many = [" ".join(r.choices(["the", "pour", "word", "und", "other"], k=200)).encode() for _ in range(1000)]
    times = []
    for run in (lambda: m.effects(many), lambda: [R.effect(t, c) for c in many for t in tables]):
        begin = time.perf_counter()
        run()
        times.append(time.perf_counter() - begin)
    assert times[0] < times[1] / 3
