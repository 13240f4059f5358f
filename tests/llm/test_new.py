"""Hard negatives, importance resampling and quality."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import duck, rows_of
from pyspark.sql import functions as F

from quaysift.llm import hard_negatives, importance, quality
from quaysift.llm.language_id import held_out
from quaysift.llm.queries import SQL

BIG = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance_resampling"])
@pytest.mark.parametrize("path", ["/root/testdata/sf0.001", BIG])
def test_same_rows(spark, name, path):
    from quaysift.llm.queries import QUERIES

    got, want = QUERIES[name](spark, path).toPandas(), duck(SQL[name], path)
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows_of(got) == rows_of(want)


def mined(rows, every, positives, negatives):
    """Plain version: all scores of every anchor."""
    good, seen = [], set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(256 * x) for x in v))
        if row not in seen:
            seen.add(row)
            good.append(row)
    out = []
    for i, label, v in (r for r in good if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other == label) for j, other, w in good if j != i)
        for p, pid, _ in [x for x in scored if x[2]][:positives]:
            fits = [(-s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, pid, k + 1, j, -p, s) for k, (s, j) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_odd_rows(spark, seed, monkeypatch):
    """Small blocks, files and chunks; nulls, infinities, empty and short vectors, equal vectors, repeated rows, negative ids, labels of all kinds."""
    for name, value in {"BLOCK": 5, "FILE": 16, "CHUNK": 3, "SLOT": 2, "PAGE": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(seed)
    rows = [(i - 20, r.choice([0, 1, 1, -7, None, 2**40]), [r.choice([0.0, 0.25, -0.5, r.gauss(0, 1), 1e6])] * 2 + [r.gauss(0, 1) for _ in range(r.choice([0, 1, 2, 2, 2]))]) for i in range(90)]
    rows += rows[:9] + [(90, 1, None), (100, 1, [1.0, None]), (105, 1, [NAN, 1.0]), (110, 0, [INF]), (115, 0, []), (120, 1, []), (None, 1, [1.0])]
    rows += [(200 + i, 1, [0.5, 0.5, 0.1]) for i in range(40)] + [(300 + i, 0, [0.5, 0.3, 0.1]) for i in range(40)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, label long, embedding array<double>, id int, q int").repartition(7)
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, 3, 4).collect())
    clipped = [(i, k, v and [max(-(1 << 24) / 256, min((1 << 24) / 256, x)) if x is not None and math.isfinite(x) else x for x in v]) for i, k, v in rows]
    assert got == mined(clipped, 5, 3, 4) and got
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_hard_negatives_that_doubles_do_not_hold(spark):
    r = random.Random(5)
    rows = [(i, i % 2, [r.uniform(-65536, 65536) for _ in range(70)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, 3, 4).collect())
    assert got == mined(rows, 5, 3, 4) and got


def test_hilbert_neighbours_touch():
    for axes, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(1 << (axes * bits)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_bound_scores():
    r = np.random.default_rng(3)
    q, block = r.integers(-300, 300, (20, 6)), r.integers(-300, 300, (30, 6))
    n = np.full((20, 1), 10**6)
    row = {"chunk": 0, "ids": np.arange(20), "labels": np.zeros(20, np.int64), "q": q.astype(np.int32), "low": -n, "high": n, "of": n, "of_score": n}
    a = hard_negatives.Asked({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()}, 6, float)
    low, high, one = block.min(axis=0)[None], block.max(axis=0)[None], np.zeros(1)
    need, top = a.needs(low, high, one, one, True)
    assert need.all() and (top[:, 0] >= (q @ block.T).max(axis=1)).all()
    assert not a.needs(low, high, one + 1, one + 2, True)[0].any() and not a.needs(low, high, one, one, False)[0].any()
    a.low, a.high = top.astype(int) + 1, n
    assert not a.needs(low, high, one, one, True)[0].any()


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """Where vectors lie in clusters, most files aren't read."""
    monkeypatch.setattr(hard_negatives, "FILE", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 20)
    r = np.random.default_rng(1)
    rows = [(i, int(i // 8 % 2), (np.eye(8)[i % 8] + r.normal(0, 0.02, 8)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    routed, keep = [], hard_negatives.written

    def watch(x, name, *done):
        out = keep(x, name, *done)
        if name == "routed":
            routed.append((out.count(), out.select("chunk").distinct().count()))
        return out

    monkeypatch.setattr(hard_negatives, "written", watch)
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == mined(rows, 10, 5, 10)
    assert routed[0][0] < 25 * routed[0][1] / 2 and routed[1][0] < 25 * routed[1][1] / 2, routed


def drawn(docs, target, percent=25, seed=7, least=20, buckets=10_000):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def runs(t):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:]))]]

    s, t = (Counter(f for x in texts for f in runs(x)[1]) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for i, text in docs:
        n, f = runs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f)) // len(f) if f else 0
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    rank = {}
    for k, x in enumerate(able[: len(able) * percent // 100]):
        rank.setdefault(x, []).append(k + 1)
    return Counter((*x[:1], *x[2:], rank[x].pop(0) if rank.get(x) else None) for x in rows)


@pytest.mark.parametrize("at_once", [3, 1 << 18])
def test_importance_odd_rows(spark, monkeypatch, at_once):
    """Null ids and texts, empty and very long texts, repeated rows, ties, capitals beyond ASCII, clashing columns."""
    monkeypatch.setattr(importance, "AT_ONCE", at_once)
    monkeypatch.setattr(importance, "PIECE", 700)
    r = random.Random(at_once)
    bits = ["a", "B", "the", "Éa", "éA", "日本", "x9", "The", "the!", "--", "É"]
    text = lambda n: " ".join(r.choice(bits) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(120)] + [(500, text(5000)), (None, text(40)), (None, None), (501, None), (502, ""), (503, "\n\0 \n")]
    docs += docs[100:] + [(7, docs[3][1])]
    df = spark.createDataFrame([(*x, "z", 1, 2) for x in docs], "doc_id long, text string, weight string, bucket int, rank int").repartition(5)
    for target in (["the é the B", None, ""], []):
        items = spark.createDataFrame([(x, 1) for x in target], "text string, n int")
        got = Counter((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in importance.importance_resample(df, items).collect())
        assert got == drawn(docs, target)
    assert importance.importance_resample(df.limit(0), items).count() == 0


def area(score, label):
    order = np.argsort(score, kind="stable")
    _, inverse, times = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]
    ones = label[order] == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.1"
    got = quality.op13_quality_classifier(spark, path).filter("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert area(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.99 and got["score"].between(0, 1).all()
    assert (got["predicted"][got["quality"] == 0] == 0).mean() > 0.95 and (got["predicted"][got["quality"] == 1] == 1).mean() > 0.99


def test_quality_against_plain_votes(spark):
    """Scores equal the votes of whole sorted lists of cosines, text by text."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    voter = quality.fit(docs, docs.filter(~held_out()), labels.filter(~held_out()))
    texts = [x.text for x in docs.orderBy("doc_id").limit(60).collect()] + ["", None, "a", "&&& !!"]
    want = []
    for t in texts:
        b = (t or "").encode()
        words = b.lower().split()
        shapes = re.sub(rb"(?s)(.)\1+", rb"\1", re.sub(rb"[0-9]", b"0", re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z]", b"a", re.sub(rb"[\t\n\x0b\f\r]", b" ", re.sub(rb"[\x80-\xff]", b"", b))))))
        from quaysift.llm import codes

        def code(w):
            data = np.frombuffer(w, np.uint8)
            return int(codes.spans(codes.sums(data), np.array([0]), np.array([len(w)]))[0])

        def two(a, b):
            return int(codes.runs(np.array([a, b], np.uint64), 2)[0])

        w, s = [code(x) for x in words], [code(x) for x in shapes.split()]
        bag = Counter(x % quality.WORDS for x in w)
        for x in [*s, *(two(*p) for p in zip(s, s[1:]))]:
            bag[quality.WORDS + x % (quality.SHAPES - 2)] += 1
        pairs = list(zip(w, w[1:]))
        bag[quality.SIZE - 1] += len(pairs) - len(set(pairs))
        bag[quality.SIZE - 2] += sum(a == b for a, b in pairs)
        v = np.zeros(quality.SIZE)
        for k, n in bag.items():
            v[k] = math.sqrt(n) * voter.idf[k]
        for part, weight in ((slice(0, quality.WORDS), quality.WORD_WEIGHT), (slice(quality.WORDS, None), 1)):
            v[part] *= weight / max(np.linalg.norm(v[part]), 1e-12)
        z = v @ voter.axes
        cosine = voter.vectors @ (z / max(np.linalg.norm(z), 1e-12))
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = np.maximum(cosine[near], 0) ** quality.POWER * voter.weights[near]
        want.append(((vote * voter.labels[near]).sum() + quality.PRIOR * voter.prior) / (vote.sum() + quality.PRIOR))
    got = quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), voter).orderBy("doc_id").toPandas()
    assert np.allclose(got["score"], want, atol=2e-3)


def test_quality_odd_rows(spark):
    rows = [(1, "good words here"), (1, "good words here"), (None, "x"), (2, None), (3, ""), (4, "a " * 50_000), (5, "BAD!! &&& ***")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (4, 1), (9, 1), (None, 1), (2, 1), (3, None)], "doc_id long, quality int")
    for x, y in ((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.filter("doc_id = 4"))):
        out = quality.score_quality(docs, quality.fit(x, x, y)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.score_quality(docs.limit(0), quality.fit(docs, docs, labels)).count() == 0
