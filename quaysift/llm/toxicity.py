"""Toxicity by compression distance: windows compress with a dictionary of toxic text and with one of ordinary text.

The zstandard dictionaries are trained on labelled texts: one on windows of ordinary texts, and two (small and large) on
what is toxic in toxic texts, which are the words whose beginnings tell toxic texts from ordinary ones. Such a stem's counts in
both differ beyond chance, near copies counting once. Contents of the dictionaries are loaded without their entropy tables, toxic
ones before the ordinary one, so that lengths differ by what is found alone. A window that gets shorter with a toxic dictionary
holds something of it. Per text, the counts of windows by bytes saved go through a logistic function calibrated on labelled texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import bounded, written

#: Labelled documents of each label that the dictionaries and the calibration are fitted on (expected number), read whole.
FIT_DOCS = 4_000
#: Bytes of a window, and from one window's start to the next's.
WINDOW, STEP = 64, 48
#: zstandard's level; bytes of the dictionaries trained on ordinary text and on toxic words.
LEVEL, ORDINARY, TOXIC = 6, 16_384, (512, 4096)
#: Windows of ordinary text and words of toxic text that dictionaries are trained on (expected numbers), chosen by a hash from whole texts; bytes
#: of an ordinary window, and toxic words of a training sample.
WINDOWS, PART, TOGETHER = 32_000, 256, 24
#: Bytes of a toxic word after its stem that are trained on.
TAIL = 1
#: Words of the runs of which the smallest hash stands for a text: texts that share it count once.
RUN = 5
#: Bytes of ordinary text before each window. Both dictionaries hold them, so even a short window is compressed and not stored.
LEAD = 64
#: A stem is in so many toxic texts at least, so many times less often in ordinary ones, and its log-likelihood ratio is this (a chance of 8e-6).
LEAST, TIMES, RATIO = 5, 4, 20
STEM = range(3, 13)
#: Where a stem may begin: after a space, and at each letter of scripts that set none (Thai, Lao, Burmese, Khmer, Chinese, Japanese).
UNSPACED = rb"\xe0[\xb8-\xbb].|\xe1[\x80-\x82\x9e\x9f].|[\xe3-\xe9].."
STARTS = re.compile(rb"(?<= )[^ ]|" + UNSPACED, re.DOTALL)
#: Savings in bytes that windows are counted by.
SAVED = (1, 2, 3, 4, 6)
FEATURES = len(TOXIC) * (len(SAVED) + 2)


def _plain(text: str | None) -> bytes:
    """Lower-cased words with a space on either side of each."""
    words = (text or "").lower().encode().split()
    return b" " + b" ".join(words) + b" " if words else b""


def _prefixes(text: bytes) -> set[bytes]:
    out: set[bytes] = set()
    for m in STARTS.finditer(text):
        word = text[m.start() : m.start() + STEM[-1]].split(b" ")[0]
        out.update(word[:k] for k in STEM if len(word) >= k)
    return out


def _run_hash(plain: bytes) -> int:
    """The smallest hash of a text's runs of words: near copies mostly share it."""
    words = plain.split()
    return min(zlib.crc32(b" ".join(words[i : i + RUN])) for i in range(max(1, len(words) - RUN + 1)))


def _tells(n_toxic: int, n_ordinary: int) -> Column:
    """Whether a stem in ``n`` toxic texts and ``other`` ordinary ones tells toxic texts: more often, and not by chance."""
    n, other, share = F.col("n"), F.col("other"), n_toxic / max(n_toxic + n_ordinary, 1)
    ratio = 2 * (n * F.log(n / ((n + other) * share)) + F.when(other > 0, other * F.log(other / ((n + other) * (1 - share)))).otherwise(0))
    often = n / max(n_toxic, 1) > TIMES * (other + 1) / max(n_ordinary, 1)
    return (n >= LEAST) & often & (ratio >= RATIO)


def _stems(telling: dict[bytes, int]) -> list[bytes]:
    """Of word beginnings that tell toxic texts, each as long as most of the words that begin so."""
    out: list[bytes] = []
    for p in sorted(telling, key=lambda p: (len(p), p)):
        while longer := [q for q in (p + bytes([c]) for c in range(256)) if telling.get(q, 0) >= 0.8 * telling[p]]:
            p = max(longer, key=lambda q: (telling[q], q))
        if not any(p.startswith(s) for s in out):
            out.append(p)
    return sorted(out, key=lambda p: (telling[p], p))


def _around(stems: list[bytes]) -> re.Pattern[bytes]:
    """Where stems stand."""
    unspaced = re.compile(UNSPACED, re.DOTALL)
    return re.compile(b"|".join((b"" if unspaced.match(s) else b"(?<= )") + re.escape(s) for s in sorted(stems, key=lambda s: (-len(s), s))) or rb"(?!)", re.DOTALL)


def _trained(size: int, windows: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on
        return b"".join(windows)[:size]


class Scorer:
    """The dictionaries and the calibration."""

    def __init__(self, toxic: tuple[bytes, ...], ordinary: bytes) -> None:
        self.toxic, self.ordinary = toxic, ordinary
        self.weights, self.centre, self.scale = np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES)
        self._made: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}

    def _compressors(self) -> tuple:
        if self._made is None:
            made = []
            size = max(map(len, self.toxic)) + len(self.ordinary)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW + LEAD, dict_size=size, min_match=4, hash_log=17, chain_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
            # what is toxic stands first, so that all else is as far away in each dictionary
            for content in (self.ordinary, *(t + self.ordinary for t in self.toxic)):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
            self._made = tuple(made)
        return self._made

    def features(self, text: str | None) -> np.ndarray:
        """For each toxic dictionary: most bytes saved in a window, windows by bytes saved (logarithms), share of windows with savings."""
        plain, ordinary, *toxic = _plain(text), *self._compressors()
        if not plain:
            return np.zeros(FEATURES)
        lead = self.ordinary[-LEAD:]
        windows = [lead + plain[i : i + WINDOW] for i in range(0, max(1, len(plain) - (WINDOW - STEP)), STEP)]
        plainly = np.array([len(ordinary(w)) for w in windows])
        out: list[float] = []
        for compress in toxic:
            saved = plainly - np.array([len(compress(w)) for w in windows])
            counts = np.array([np.count_nonzero(saved >= s) for s in SAVED], float)
            out += [max(saved.max(), 0), *np.log1p(counts), counts[1] / len(saved)]
        return np.array(out, float)

    def calibrate(self, features: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression (ridge, Newton's method) on labelled texts."""
        self.centre, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x = np.column_stack([np.ones(len(features)), (features - self.centre) / self.scale])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - labels) + 0.1 * np.r_[0, w[1:]]
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((features - self.centre) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(held: Broadcast, texts: pa.Array) -> np.ndarray:
    return np.array([held.value.features(t.as_py()) for t in texts]).reshape(len(texts), FEATURES)


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``: about ``FIT_DOCS`` texts a label, chosen by a hash of the id.

    Texts that are equal count once, and near copies once where stems are counted and words are taken. A document with
    both labels counts as toxic. Where a label has no text, every score is the share of toxic labels.
    """
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    grid = 1 << 30
    bound = F.when(F.col("toxic") == 1, int(min(1.0, FIT_DOCS / max(counts.get(1, 0), 1)) * grid)).otherwise(int(min(1.0, FIT_DOCS / max(counts.get(0, 0), 1)) * grid))
    chosen = labels.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(grid)) < bound)
    # at most some 2 * FIT_DOCS rows
    texts = bounded(docs).select("doc_id", F.make_valid_utf8("text").alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))

    texts = written(texts, "labelled")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [_plain(t) for t in b.column("text").to_pylist()]
            full = [i for i, p in enumerate(plain) if p]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic").take(pa.array(full, pa.int64())).cast(pa.int32()), pa.array([_run_hash(plain[i]) for i in full], pa.int64()), pa.array([plain[i] for i in full], pa.binary())],
                ["toxic", "run", "plain"],
            )

    single = texts.mapInArrow(once, "toxic int, run long, plain binary").groupBy("toxic", "run").agg(F.min("plain").alias("plain"))
    single = written(single, "single")
    about = {r["toxic"]: r for r in single.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("plain").cast("long")).alias("size")).collect()}
    n1, n0 = (about[k]["n"] if k in about else 0 for k in (1, 0))
    share = min(1.0, WINDOWS * PART / max(about[0]["size"] if n0 else 0, 1))  # of all windows of ordinary texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], int] = {}
        for b in batches:
            for plain, toxic in zip(b.column("plain").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for p in _prefixes(plain):
                    seen[toxic, p] = seen.get((toxic, p), 0) + 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array([seen[k] for k in keys], pa.int64())], ["toxic", "part", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for p in b.column(0).to_pylist() for i in range(0, len(p), PART) if zlib.crc32(w := p[i : i + PART]) < share * 2**32], pa.binary())], ["part"])

    parts = written(single.select("toxic", "plain").mapInArrow(count, "toxic int, part binary, n long").groupBy("toxic", "part").agg(F.sum("n").alias("n")), "parts")
    others = parts.filter("toxic = 0").select("part", F.col("n").alias("other"))
    told = parts.filter(f"toxic = 1 AND n >= {LEAST}").join(others, "part", "left").withColumn("other", F.coalesce("other", F.lit(0))).filter(_tells(n1, n0))
    where = _around(_stems({bytes(r["part"]): r["n"] for r in told.select("part", "n").collect()}))

    def toxic_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's distinct words that begin with a telling stem, with what stands before and a space."""
        for b in batches:
            for run, plain in zip(b.column("run").to_pylist(), b.column("plain").to_pylist(), strict=True):
                found = sorted({plain[max(0, m.start() - 1) : m.end()] + plain[m.end() : m.end() + TAIL].partition(b" ")[0] + b" " for m in where.finditer(plain)})
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(found), pa.int64()), pa.array(found, pa.binary())], ["run", "part"])

    words = written(single.filter("toxic = 1").select("run", "plain").mapInArrow(toxic_words, "run long, part binary"), "words")
    grid = 1 << 30
    among = int(min(1.0, WINDOWS / max(words.count(), 1)) * grid)
    # in the order of a hash, so that what stands in one text is not learned as one string
    mixed = words.filter(F.pmod(F.xxhash64("part", "run"), F.lit(grid)) < among).orderBy(F.xxhash64("run", "part"), "part").select("part").collect()
    mixed = [bytes(r["part"]) for r in mixed]
    samples = [b"".join(mixed[i : i + TOGETHER]) for i in range(0, len(mixed), TOGETHER)]
    plainly = [bytes(r["part"]) for r in single.filter("toxic = 0").select("plain").mapInArrow(windows, "part binary").orderBy(F.xxhash64("part"), "part").collect()]
    scorer = Scorer(tuple(_trained(size, samples) for size in TOXIC), _trained(ORDINARY, plainly))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(list(_features(held, b.column("text"))), pa.list_(pa.float64()))], ["toxic", "x"])

    kind = texts.schema["toxic"].dataType.simpleString()
    rows = texts.select("toxic", "text").mapInArrow(measure, f"toxic {kind}, x array<double>").toPandas()
    held.destroy()
    y = rows["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        scorer.calibrate(np.array(rows["x"].tolist()), y)
    else:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        scorer.weights[0] = np.log(rate / (1 - rate))
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer | Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``; ``predicted`` is 1 from a score of 0.5.

    Whole texts are scored, window by window; null and empty texts have no window and get the lowest evidence.
    Ids may be null or repeat; further columns are not read. Bytes that aren't UTF-8 count as U+FFFD.
    """
    held = scorer if isinstance(scorer, Broadcast) else docs.sparkSession.sparkContext.broadcast(scorer)
    picked = bounded(docs).select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    key = picked.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = held.value.scores(_features(held, b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return picked.mapInArrow(score, f"doc_id {key}, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a scorer fitted on labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scorer = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return score_toxicity(docs, scorer).select("doc_id", held_out().alias("held_out"), "score", "predicted")
