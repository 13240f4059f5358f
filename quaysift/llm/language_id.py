"""Language identification by interpolated Kneser-Ney character models, one per language.

Words are lower-cased runs of letters with a mark at either end. Models have order ``ORDER``; lower orders
count distinct left extensions. Each model is kept as arrays sorted by the hash of an n-gram, for all
languages side by side: the interpolated probability of the n-gram's last character, and per context the
weight of the next lower order. A text's score in a language is its cross-entropy per character; the lowest wins. Since
words are scored apart from each other, a task scores each distinct word of a batch once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import mix
from .shared import bounded

ORDER = 5
#: Labelled documents a language that models are fitted on, and that rejection is calibrated on (expected numbers).
FIT_DOCS, CALIBRATION_DOCS = 1_000, 300
#: A text is rejected beyond this quantile of the calibration texts' cross-entropy, and this much (nats a character) more.
#: SPREAD, divided by the root of the text's characters, allows for the chance in short texts.
QUANTILE, MARGIN, SPREAD = 0.999, 1.0, 10.0
UNKNOWN = "und"
#: Characters that count as evidence at most when a score is made of cross-entropies.
EVIDENCE = 200
#: Bytes of text that are cut at once.
PIECE = 1 << 19
_C = np.uint64(0x9E3779B97F4A7C15)
_OPEN, _SHUT = 1, 2


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place in the word, word number, code of the n-gram that ends there for n = 0, 1, ..) of each character and end mark."""
    text = "".join(f"\x01{w}\x02" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    number = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    place = np.arange(len(points)) - np.flatnonzero(points == _OPEN)[number] if len(points) else np.zeros(0, np.int64)
    one = mix(points.astype(np.uint64) + np.uint64(1))
    codes = [np.full(len(points), 3, np.uint64)]
    for k in range(1, ORDER + 1):
        # the n-gram's code is its context's code, then the last character; context of n-1 characters ends before
        before = np.concatenate([codes[0][:1], codes[k - 1][:-1]]) if len(points) else codes[0]
        codes.append(mix(before * _C + one) if k > 1 else mix(codes[0] * _C + one))
    return place, number, codes


class Model:
    """Kneser-Ney models of several languages over one set of n-grams."""

    def __init__(self, languages: list[str], words: list[list[str]], times: list[np.ndarray]) -> None:
        self._build(languages, [self.counted(w, t) for w, t in zip(words, times, strict=True)])

    @classmethod
    def of(cls, languages: list[str], counted: list[tuple[list[dict | None], set[str]]]) -> Model:
        """From what ``counted`` gives of each language's words."""
        model = cls.__new__(cls)
        model._build(languages, counted)
        return model

    def _build(self, languages: list[str], counted: list[tuple[list[dict | None], set[str]]]) -> None:
        self.languages = languages
        n = len(languages)
        self.limits = np.full(n, np.inf)
        if not n:  # nothing was learned
            return
        tables = [t for t, _ in counted]
        self.base = 1.0 / (len(set().union(*(chars for _, chars in counted))) + 2)
        self.grams, self.probs, self.contexts, self.weights = [None], [None], [None], [None]
        for k in range(1, ORDER + 1):
            gram = np.unique(np.concatenate([t[k]["gram"] for t in tables]))
            ctx = np.unique(np.concatenate([t[k]["ctx_key"] for t in tables]))
            weight = np.ones((len(ctx), n), np.float32)
            prob = np.zeros((len(gram), n))
            low, at_ctx = np.zeros(len(gram), np.uint64), np.zeros(len(gram), np.uint64)
            for i, t in enumerate(tables):
                x = t[k]
                weight[np.searchsorted(ctx, x["ctx_key"]), i] = x["weight"]
                at = np.searchsorted(gram, x["gram"])
                prob[at, i] = x["share"]
                low[at], at_ctx[at] = x["lower"], x["ctx"]
            lower = np.full((len(gram), n), self.base) if k == 1 else self.probs[k - 1][np.searchsorted(self.grams[k - 1], low)]
            prob += weight[np.searchsorted(ctx, at_ctx)] * lower
            self.grams.append(gram)
            self.probs.append(prob.astype(np.float32))
            self.contexts.append(ctx)
            self.weights.append(weight)

    @staticmethod
    def counted(words: list[str], times: np.ndarray) -> tuple[list[dict | None], set[str]]:
        """(n-grams by order, characters) of a language's words."""
        return Model._count(words, times), set().union(*words)

    @staticmethod
    def _count(words: list[str], times: np.ndarray) -> list[dict | None]:
        """Per order the n-grams of a language with their discounted shares, and the contexts with the weight left."""
        place, number, codes = _grams(words)
        out: list[dict | None] = [None] * (ORDER + 1)
        above = None  # characters at which the distinct n-grams of the next higher order stand
        for k in range(ORDER, 0, -1):
            here = np.flatnonzero(place >= max(k - 1, 1))
            gram, rep, inv = np.unique(codes[k][here], return_index=True, return_inverse=True)
            rep = here[rep]
            count = np.bincount(inv, weights=times[number[here]], minlength=len(gram))
            if above is not None:  # n-grams that don't begin a word count their left extensions instead
                inner = place[rep] > k - 1
                left, ways = np.unique(codes[k][above], return_counts=True)
                count[inner] = ways[np.searchsorted(left, gram[inner])]
            above = rep
            ctx = codes[k - 1][rep - 1] if k > 1 else codes[0][rep]
            key, to = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(to, weights=count), np.bincount(to)
            ones, twos = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            lower = codes[k - 1][rep] if k > 1 else codes[0][rep]
            out[k] = {"gram": gram, "ctx": ctx, "lower": lower, "share": np.maximum(count - d, 0) / total[to], "ctx_key": key, "weight": d * kinds / total}
        return out

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cost of each word in each language in nats, characters it counts as)."""
        n = len(self.languages)
        cost = np.zeros((len(words), n))
        if not words:
            return cost, np.zeros(0)
        place, number, codes = _grams(words)
        at = np.flatnonzero(place >= 1)
        weight = np.ones((len(at), n), np.float32)
        prob = np.zeros((len(at), n), np.float32)
        open_ = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            now = open_[place[at[open_]] >= k - 1]
            if not len(now):
                continue
            i = at[now]
            spot = np.minimum(np.searchsorted(self.grams[k], codes[k][i]), len(self.grams[k]) - 1)
            hit = self.grams[k][spot] == codes[k][i]
            prob[now[hit]] = weight[now[hit]] * self.probs[k][spot[hit]]
            missed = now[~hit]
            i = at[missed]
            ctx = codes[k - 1][i - 1] if k > 1 else codes[0][i]
            spot = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            known = self.contexts[k][spot] == ctx
            weight[missed[known]] *= self.weights[k][spot[known]]
            found = np.zeros(len(at), bool)
            found[now[hit]] = True
            open_ = open_[~found[open_]]
        prob[open_] = weight[open_] * np.float32(self.base)
        for j in range(n):
            cost[:, j] = np.bincount(number[at], weights=-np.log(np.maximum(prob[:, j], 1e-30)), minlength=len(words))
        return cost, np.bincount(number[at], minlength=len(words)).astype(float)


def _words(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct words, word number and row of each word) of pieces of bounded size."""
    texts = texts.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + PIECE, "right")))
        cut = pc.split_pattern_regex(pc.utf8_lower(texts.slice(a, b - a)), r"[^\pL]+")
        row = pc.list_parent_indices(cut)
        flat = pc.list_flatten(cut)
        some = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(some).dictionary_encode()
        yield a, b - a, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), row.filter(some).to_numpy(zero_copy_only=False)
        a = b


def entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cost of each text in each language, characters); 0 characters where a text has no letter."""
    total, chars = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for a, n, words, number, row in _words(texts):
        cost, size = model.costs(words.to_pylist())
        for j in range(total.shape[1]):
            total[a : a + n, j] = np.bincount(row, weights=cost[number, j], minlength=n)
        chars[a : a + n] = np.bincount(row, weights=size[number], minlength=n)
    return total, chars


def fit(docs: DataFrame) -> Model:
    """Models from ``docs(doc_id, text, lang)``, of rows that have a text and a language (an id may be null): about ``FIT_DOCS`` documents a language, chosen by a hash of the id.

    Rejection limits come from about ``CALIBRATION_DOCS`` other labelled documents a language. Both are read
    whole. All else (which languages there are, and how many documents each has) is counted over all rows.
    """
    docs = bounded(docs).filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("text", F.make_valid_utf8("text"))
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    grid = 1 << 30
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(grid))
    bound = lambda per: F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, per / counts[k]) * grid)))))[F.col("lang")]
    if not languages:
        return Model([], [], [])
    share = bound(FIT_DOCS + CALIBRATION_DOCS)
    picked = docs.withColumn("place", place).filter(F.col("place") < share)
    use = F.when(F.col("place") < share * (FIT_DOCS / (FIT_DOCS + CALIBRATION_DOCS)), "fit").otherwise("calibrate")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            for a, n, words, number, row in _words(b.column("text")):
                for lang in sorted(set(langs[a : a + n])):
                    mine = np.array([x == lang for x in langs[a : a + n]])
                    times = np.bincount(number[mine[row]], minlength=len(words))
                    some = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), words.take(pa.array(some)).cast(pa.string()), pa.array(times[some], pa.int64())], ["lang", "word", "n"])

    picked = picked.select("lang", "text", use.alias("use"))
    words = picked.filter("use = 'fit'").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def counted(words: pa.Table) -> pa.Table:  # of one language
        words = words.sort_by("word")
        found = Model.counted(words.column("word").to_pylist(), words.column("n").to_numpy().astype(float))
        return pa.table({"lang": words.column("lang").slice(0, 1), "found": pa.array([pickle.dumps(found)], pa.binary())})

    # the driver gets n-grams, some MB of them, and not the words
    by = {r["lang"]: pickle.loads(r["found"]) for r in words.groupBy("lang").applyInArrow(counted, "lang string, found binary").collect()}
    languages = [k for k in languages if k in by]
    if not languages:  # labelled texts without a letter
        return Model([], [], [])
    model = Model.of(languages, [by.pop(k) for k in languages])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            total, chars = entropies(m, b.column("text"))
            ok = [i for i, x in enumerate(b.column("lang").to_pylist()) if x in m.languages and chars[i]]
            at = [m.languages.index(b.column("lang")[i].as_py()) for i in ok]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[ok, at] / chars[ok])], ["at", "h"])

    heights = picked.filter("use = 'calibrate'").select("lang", "text").mapInArrow(own, "at int, h double").collect()  # a number a calibration text
    held.destroy()
    for at in {r["at"] for r in heights}:
        model.limits[at] = np.quantile([r["h"] for r in heights if r["at"] == at], QUANTILE) + MARGIN
    return model


def identify(docs: DataFrame, model: Model | Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, entropy, rejected``.

    ``lang_pred`` is the language of the lowest cross-entropy per character, ``und`` if the text is null or has no
    letter (or nothing was learned); ``score`` (0 to 1) is its share among the languages, with at most
    ``EVIDENCE`` characters' evidence, and 0 for a rejected text. ``rejected`` marks ``und`` and texts beyond the
    language's calibrated limit.
    Ids may be null or repeat; further columns are not read. Bytes that aren't UTF-8 count as U+FFFD.
    """
    held = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    picked = bounded(docs).select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    key = picked.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if not b.num_rows:
                continue
            if not m.languages:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([UNKNOWN] * b.num_rows), pa.array([0.0] * b.num_rows), pa.nulls(b.num_rows, pa.float64()), pa.array([True] * b.num_rows)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])
                continue
            total, chars = entropies(m, b.column("text"))
            h = total / np.maximum(chars, 1)[:, None]
            best = h.argmin(axis=1)
            low = h.min(axis=1)
            share = 1 / np.exp(-(h - low[:, None]) * np.minimum(chars, EVIDENCE)[:, None]).sum(axis=1)
            none = chars == 0
            rejected = none | (low > m.limits[best] + SPREAD / np.sqrt(np.maximum(chars, 1)))
            names = np.array([*m.languages, UNKNOWN], object)[np.where(none, len(m.languages), best)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(rejected, 0.0, share)), pa.array(low, mask=none), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "entropy", "rejected"],
            )

    return picked.mapInArrow(score, f"doc_id {key}, lang_pred string, score double, entropy double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from fitting: one id in five, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by models of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
