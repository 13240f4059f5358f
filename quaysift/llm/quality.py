"""Quality by the vote of nearest neighbours among labelled documents, in a latent-semantic space.

A text is a bag of hashed terms: its words, the shapes of its tokens (letters, capitals, digits and signs, each run as one) and
pairs of shapes, and what it repeats (the word before, a pair of words said earlier). Terms are weighted by the root of
their share and by how few documents have them, counted over all documents. A singular value decomposition of labelled documents gives the
latent axes. Their vectors are broadcast (``2 * FIT_DOCS`` rows of ``RANK`` numbers at most); every document's cosine with each of
them is computed exactly, block by block as matrix products, and the nearest vote, each by a power of its similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import mix, pieces, runs, words
from .language_id import held_out
from .shared import bounded, written

#: Labelled documents of each label that axes are fitted on and that vote (expected number), read whole.
FIT_DOCS = 3_000
#: Hash buckets of words and of shapes (with their pairs, and repeats); latent axes.
WORDS, SHAPES, RANK = 1_024, 3_072, 64
SIZE = WORDS + SHAPES
#: What words weigh beside shapes.
WORD_WEIGHT = 0.3
#: Neighbours that vote, the power of a cosine that each votes with, and what the share of labels weighs beside them.
NEIGHBOURS, POWER, PRIOR = 24, 8, 0.5
#: Documents whose cosines are computed at once.
BLOCK = 256
#: From this score a document is good.
GOOD = 0.3
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 10, 11, 12, 13]] = 32
_AGAIN, _BEFORE = SIZE - 1, SIZE - 2


def _pairs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of neighbouring items of one row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    two = runs(codes, 2)
    inside = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
    return row[1:][inside], two[inside]


def _shaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets with letters, capitals and digits made alike, bytes beyond ASCII left out, and runs made one."""
    def kept(stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]

    data, offsets = kept(data < 128)
    data = _SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[offsets[offsets < len(data)]] = True
    data, offsets = kept(new)
    return data, offsets


def bags(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket, times) of the distinct terms of texts, in pieces of bounded size."""
    for first, data, offsets in pieces(column):
        n = len(offsets) - 1
        _, _, codes, bounds = words(data, offsets, lower=True)
        row = np.repeat(np.arange(n), np.diff(bounds))
        _, _, shapes, at = words(*_shaped(data, offsets), lower=False)
        shape_row = np.repeat(np.arange(n), np.diff(at))
        two_row, two = _pairs(shapes, at)
        pair_row, pair = _pairs(codes, bounds)
        same = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, bool)
        _, said = np.unique(mix(pair ^ (pair_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
        again = np.delete(pair_row, said)
        shape_size = np.uint64(SHAPES - 2)
        rows = np.concatenate([row, shape_row, two_row, again, row[1:][same] if len(row) > 1 else row[:0]])
        bucket = np.concatenate([(codes % np.uint64(WORDS)), WORDS + shapes % shape_size, WORDS + two % shape_size, np.full(len(again), _AGAIN, np.uint64), np.full(np.count_nonzero(same), _BEFORE, np.uint64)]).astype(np.int64)
        key, times = np.unique(rows * SIZE + bucket, return_counts=True)
        yield first, n, key // SIZE, key % SIZE, times


def _weighted(n: int, row: np.ndarray, bucket: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights: root of the count and rarity, words and shapes each of length one within a text."""
    x = np.sqrt(times) * idf[bucket]
    word = bucket < WORDS
    for family, weight in ((word, WORD_WEIGHT), (~word, 1.0)):
        norm = np.sqrt(np.bincount(row[family], weights=x[family] ** 2, minlength=n))
        x[family] *= weight / np.maximum(norm[row[family]], 1e-12)
    return x


class Voter:
    """Latent axes, and labelled documents on them."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float) -> None:
        self.idf, self.axes, self.vectors, self.labels, self.weights, self.prior = idf, axes, vectors, labels, weights, prior

    def place(self, texts: pa.Array) -> np.ndarray:
        """Texts on the latent axes, of length one, or 0 where a text has no term."""
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for first, n, row, bucket, times in bags(texts):
            if len(row):
                x = _weighted(n, row, bucket, times, self.idf).astype(np.float32)
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True):
                    out[first + row[a]] = x[a:b] @ self.axes[bucket[a:b]]
        return _unit(out)

    def scores(self, placed: np.ndarray) -> np.ndarray:
        """Share of votes for label 1; the labels' own share where nothing is near."""
        out = np.full(len(placed), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(placed) if k else 0, BLOCK):
            cosine = placed[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** POWER * self.weights[near]
            out[a : a + BLOCK] = ((vote * self.labels[near]).sum(axis=1) + PRIOR * self.prior) / (vote.sum(axis=1) + PRIOR)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :rank].astype(np.float32))


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How rare each term is, from the documents that have it, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(SIZE + 1, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, _, bucket, _ in bags(b.column(0)):
                total[:SIZE] += np.bincount(bucket, minlength=SIZE)
        total[SIZE] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = bounded(docs).select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    have = np.zeros(SIZE + 1)
    have[sums["bucket"].to_numpy(int)] = sums["n"].to_numpy()
    return np.log((1 + have[SIZE]) / (1 + have[:SIZE])) + 1


def fit(docs: DataFrame, labelled: DataFrame, labels: DataFrame, label_col: str = "quality") -> Voter:
    """A voter from ``labelled(doc_id, text)`` and ``labels(doc_id, quality)``; terms' rarity is counted over ``docs(text)``.

    About ``FIT_DOCS`` texts a label are used, chosen by a hash of the id; each votes for as many as it stands for. Texts that are
    equal count once. A document with both labels counts as bad. Without labels, every score is a half.
    """
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = rarity(docs)
    grid = 1 << 30
    share = {k: min(1.0, FIT_DOCS / max(counts.get(k, 0), 1)) for k in (0, 1)}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(grid))
    chosen = labels.filter(place < F.when(F.col("label") == 1, int(share[1] * grid)).otherwise(int(share[0] * grid)))
    # at most some 2 * FIT_DOCS rows
    texts = bounded(labelled).select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("label").alias("label"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, row, bucket, times in bags(b.column(1)):
                cuts = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.ListArray.from_arrays(cuts, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))], ["label", "bucket", "times"])

    rows = texts.select("label", "text").mapInArrow(bag, "label int, bucket array<int>, times array<int>")
    rows = written(rows, "bags").orderBy("label", F.xxhash64("bucket", "times")).toArrow()
    labels_, n = rows.column("label").to_numpy().astype(float), rows.num_rows
    if not n:
        return Voter(idf, np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), labels_, labels_, 0.5)
    bucket, times = (rows.column(c).combine_chunks() for c in ("bucket", "times"))
    row = np.repeat(np.arange(n), bucket.value_lengths().to_numpy(zero_copy_only=False))
    x = np.zeros((n, SIZE), np.float32)
    at, much = bucket.flatten().to_numpy(), times.flatten().to_numpy().astype(float)
    x[row, at] = _weighted(n, row, at, much, idf)
    axes = latent_axes(x, RANK)
    stands = np.where(labels_ == 1, 1 / share[1], 1 / share[0])
    prior = float((stands * labels_).sum() / stands.sum())
    return Voter(idf, axes, _unit(x @ axes), labels_, stands / stands.mean(), prior)


def score_quality(docs: DataFrame, voter: Voter | Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``; ``predicted`` is 1 from a score of ``GOOD``.

    Whole texts are scored. Null and empty texts, and those without a term, get the labels' share. Ids may be null or repeat; further
    columns are not read. Bytes that aren't UTF-8 are taken as they are.
    """
    held = voter if isinstance(voter, Broadcast) else docs.sparkSession.sparkContext.broadcast(voter)
    picked = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = picked.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.clip(held.value.scores(held.value.place(b.column(1))), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return picked.mapInArrow(score, f"doc_id {key}, score double, predicted int")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the votes of labelled documents that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    voter = fit(docs, docs.filter(~held_out()), labels.filter(~held_out()))
    return score_quality(docs, voter).select("doc_id", held_out().alias("held_out"), "score", "predicted")
