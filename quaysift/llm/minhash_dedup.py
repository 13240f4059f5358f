"""Near-duplicate detection with bottom-k sketches from one hash function.

A text's set is its distinct word shingles under one 64-bit hash, and its sketch the smallest values. Two sets of
similarity t have their union's smallest value in common with a chance of t, so of the ``RETAINED`` smallest at
least one is in both sketches but for a chance of ``(1 - t) ** RETAINED`` (6e-9 at 0.85, 1e-7 at 0.8). Inverted
lists of the retained values therefore bring every linked pair together.

Two bounds filter the pairs of a list. The parity bitmaps of two sets differ in no more bits than the sets
differ in values, which never loses a link; the similarity estimated from the union of both 32-value sketches
then has to come near the threshold. Pairs that pass are verified on full sets: the closest partner of each text
first, and of the others those whose texts are still in different components.

A list is not searched for all its pairs at once. First all its texts meet the one with the smallest id, which joins most
of what belongs together; only pairs between components are open then. Lists with very many of these (a passage in many
texts) give up their values: texts that hold such a value retain others instead, as many as leave the same chance
of a miss. What is still open is compared in blocks. Lists with the same texts are one list, and texts with equal
sets are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import pieces, shingle_sets, words
from .components import components
from .repeats import PARTS, bits_for, id_codes, ids_filter, may_repeat, only_ids, parts, repeat_filter, without_ids
from .shared import attach, bounded, written

#: Smallest values by which texts meet.
RETAINED = 10
#: Values of the union estimate, and standard deviations by which it may fall short of the threshold.
SKETCH, SLACK = 32, 6.0
#: Bits of the parity bitmap.
PARITY = 1024
#: A list with as many open pairs as one of so many texts that have no link is given up (or of more, so that the values given up stay few).
LONG, LONG_VALUES = 1_000, 1_000_000
#: Texts of a list that are held in one task, which others then stream past.
BLOCK = 4_096
#: Partners of one text that are verified in one bundle.
BUNDLE = 200
_NONE = np.uint32(0xFFFFFFFF)


def _sets(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for b in batches:
        ids = b.column(0)
        for at, data, offsets in pieces(b.column(1)):
            _, _, codes, bounds = words(data, offsets, lower=True)
            yield ids.slice(at, len(offsets) - 1), list(shingle_sets(codes, bounds, w))


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def sketches(docs: DataFrame, w: int) -> DataFrame:
    """``doc_id, n, fp, sketch, parity, retained`` of each text."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, w):
            fps, small, even, kept = [], [], [], []
            for u in sets:
                fps.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                few = np.full(SKETCH, _NONE)
                few[: min(len(u), SKETCH)] = (u[:SKETCH] >> np.uint64(32)).astype(np.uint32)
                small.append(few.tobytes())
                even.append(np.packbits(np.bincount((u & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes())
                kept.append(u[:RETAINED].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(u) for u in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (fps, small, even)), pa.array(kept, pa.list_(pa.int64()))],
                ["doc_id", "n", "fp", "sketch", "parity", "retained"],
            )

    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {key}, n long, fp binary, sketch binary, parity binary, retained array<long>")


def retained_but(u: np.ndarray, late: np.ndarray, num: int, den: int) -> np.ndarray | None:
    """What a set retains when the values of ``late`` are given up; None if it has none of them.

    Of two linked sets, the other values agree by a smaller share t' the fewer they are, and so many more of them
    are retained that ``(1 - t') ** k`` stays the chance of a miss. The first ``n - ceil(t * n) + 1`` values in one
    order for all texts (given-up ones last) are enough in any case: linked sets have fewer to themselves.
    """
    is_late = late[np.minimum(np.searchsorted(late, u), len(late) - 1)] == u if len(late) else np.zeros(len(u), bool)
    if not is_late.any():
        return None
    t = num / den
    k = len(u) + (-len(u) * num // den) + 1
    apart = (1 - t) / (t * max(1 - is_late.mean(), 1e-9))  # 1 - t'
    if apart < 1:
        k = min(k, max(RETAINED, int(np.ceil(RETAINED * np.log(1 - t) / np.log(apart)))) if t < 1 else 1)
    return np.concatenate([u[~is_late], u[is_late]])[:k]


def _instead(docs: DataFrame, w: int, num: int, den: int, late: Broadcast, asked: tuple[Broadcast, int]) -> DataFrame:
    """``doc_id, vs``: what texts with a given-up value retain, of those that ``asked`` lets through."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(may_repeat(asked[0].value, id_codes(b.column(0)), asked[1]))) for b in batches)
        for ids, sets in _sets(some, w):
            kept = [retained_but(u, late.value, num, den) for u in sets]
            at = [i for i, x in enumerate(kept) if x is not None]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array([kept[i].view(np.int64) for i in at], pa.list_(pa.int64()))], ["doc_id", "vs"])

    return docs.select("doc_id", "text").mapInArrow(job, f"doc_id {key}, vs array<long>")


def _postings(reps: DataFrame) -> DataFrame:
    """``doc_id, vs``: of each text the retained values that others have too; texts without such a value have no partner."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    bits = bits_for(RETAINED * reps.count())
    again = repeat_filter(reps.select("retained").mapInArrow(lambda it: parts(codes(it), bits), PARTS), bits)
    key = reps.schema["doc_id"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("retained").flatten()
            at = np.repeat(np.arange(b.num_rows), b.column("retained").value_lengths().to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(may_repeat(again.value, values.to_numpy(zero_copy_only=False).view(np.uint64), bits))
            rows, first = np.unique(at[keep], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keep)), pa.int32()), values.take(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), lists], ["doc_id", "vs"])

    return written(reps.select("doc_id", "retained").mapInArrow(post, f"doc_id {key}, vs array<long>"), "postings", again)


def _estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common values among the union's k smallest, k) of the sketches in the rows of x and y."""
    k = np.maximum((x != _NONE).sum(axis=1), (y != _NONE).sum(axis=1))
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    rank = np.arange(1, both.shape[1]) - np.cumsum(same, axis=1) + same
    return (same & (rank <= k[:, None])).sum(axis=1), k


class _Texts:
    """Sizes, sketches and parity bitmaps of some texts."""

    def __init__(self, n: np.ndarray, sketch: pa.Array, parity: pa.Array) -> None:
        self.n = n.astype(np.int64)
        self.sketch = np.frombuffer(b"".join(sketch.to_pylist()), np.uint32).reshape(len(n), SKETCH)
        self.parity = np.frombuffer(b"".join(parity.to_pylist()), np.uint64).reshape(len(n), PARITY // 64)


def _near(x: _Texts, i: np.ndarray, y: _Texts, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs i, j sizes, parity and union estimate allow to be linked, bits in which those differ)."""
    total = x.n[i] + y.n[j]
    common = -(-total * num // (num + den))  # least for a link
    ok = np.flatnonzero(common <= np.minimum(x.n[i], y.n[j]))
    apart = np.bitwise_count(x.parity[i[ok]] ^ y.parity[j[ok]]).sum(axis=1, dtype=np.int64)
    fit = apart <= (total - 2 * common)[ok]
    ok, apart = ok[fit], apart[fit]
    got, k = _estimate(x.sketch[i[ok]], y.sketch[j[ok]])
    t = num / den
    # where a set is smaller than its sketch, up to a quarter of the common values rank beyond k
    enough = got >= np.where(k < SKETCH, 0.5 * t * k - 2, t * k - SLACK * np.sqrt(t * (1 - t) * k))
    return ok[enough], apart[enough]


def _passed(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, apart``: the pairs that the filters let pass. Many pairs may have the same ``a``."""
    key = reps.schema["doc_id"].dataType.simpleString()
    pairs = written(pairs, "pairs")
    leads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    marks, asked = only_ids(reps.select("doc_id", "n", "sketch", "parity"), written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "asked"))
    side = lambda c: marks.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch", "parity")))
    leads = written(leads.hint("merge").join(side("a"), "a"), "leads")
    rows = attach(pairs.hint("merge").join(side("b"), "b"), leads, "a", "size", pairs.count())

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_Texts(b.column(f"n_{c}").to_numpy(), b.column(f"sketch_{c}"), b.column(f"parity_{c}")) for c in "ab")
            every = np.arange(b.num_rows)
            ok, apart = _near(x, every, y, every, num, den)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("b").take(pa.array(ok)), pa.array(apart)], ["a", "b", "apart"])

    return written(rows.mapInArrow(job, f"a {key}, b {key}, apart long"), "passed", asked)


def _rows(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``doc_id, v, label``: the label comes to a text before its values do."""
    rows = postings.withColumn("label", F.col("doc_id"))
    if labels is not None:
        rows = postings.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    return rows.select("doc_id", F.explode("vs").alias("v"), "label")


def _code() -> list[Column]:
    """Which texts a list has, in 128 bits."""
    return [F.bit_xor(F.xxhash64("doc_id", F.lit(s))).alias(f"x{s}") for s in (0, 1)]


def _all_lists(rows: DataFrame) -> DataFrame:
    """``v, m, lead, code`` of lists with more than one text; the smallest id leads."""
    found = rows.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("lead"), *_code()).filter("m > 1")
    return found.select("v", "m", "lead", F.struct("m", "x0", "x1").alias("code"))


def _open_lists(rows: DataFrame, met: bool) -> DataFrame:
    """``v, m, open, top, code`` of lists with open pairs: ``open`` counts pairs of different labels, without those of the
    smallest id where it has ``met`` all others; ``top`` is the label that most have."""
    c, m = F.col("c"), F.col("m").cast("double")
    found = rows.groupBy("v", "label").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("smallest"), *_code())
    found = found.groupBy("v").agg(
        F.sum(c).alias("m"), F.sum(c.cast("double") * c).alias("square"), F.max(F.struct("c", "label")).alias("top"),
        F.min(F.struct("smallest", "c")).alias("first"), *(F.bit_xor(f"x{s}").alias(f"x{s}") for s in (0, 1)),
    )
    found = found.withColumn("open", (m * m - F.col("square")) / 2 - (m - F.col("first.c") if met else 0)).filter("open > 0")
    return written(found.select("v", "m", "open", F.col("top.label").alias("top"), F.struct("m", "x0", "x1").alias("code")), "lists")


def _once(lists: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """(``v, m`` and ``columns`` of one of the lists with the same texts, sum of ``m``)."""
    lists = written(lists.groupBy("code").agg(F.min(F.struct("v", "m", *columns)).alias("x")).select("x.*"), "once")
    return lists, lists.agg(F.sum("m").alias("m")).first()["m"] or 0


def _with_leader(rows: DataFrame) -> DataFrame:
    """``a, b``: the leader of each list with its other texts."""
    lists, total = _once(_all_lists(rows), "lead")
    met = attach(rows.select("doc_id", "v"), lists, "v", "m", total)
    return met.filter(F.col("doc_id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()


def _between(rows: DataFrame, lists: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, apart``: all pairs of different labels that the filters let pass.

    Texts of a list live in blocks. Those that don't have its ``top`` label visit all blocks, so texts that
    already belong together are not compared.
    """
    key = reps.schema["doc_id"].dataType.simpleString()
    lists, total = _once(lists, "top")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = written(attach(rows, lists, "v", "m", total).select("doc_id", "v", "label", (F.col("label") == F.col("top")).alias("of_top"), blocks.alias("blocks")), "met")
    marks, asked = only_ids(reps.select("doc_id", "n", "sketch", "parity"), written(met.select("doc_id").distinct(), "asked"))
    met = met.hint("merge").join(marks, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("block", F.explode(F.when(F.col("of_top"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    columns = ["v", "block", "visits", "doc_id", "label", "of_top", "n", "sketch", "parity"]
    met = met.withColumn("visits", F.col("block") != F.col("own")).select(*columns).repartition("v", "block").sortWithinPartitions("v", "block", "visits")
    names = columns[3:]

    def pairs_of(guests: pa.Table, h: pa.Table, at_home: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of guests and texts at home."""
        x, y = (_Texts(t.column("n").to_numpy(), t.column("sketch"), t.column("parity")) for t in (guests, h))
        ids = [t.column("doc_id").combine_chunks() for t in (guests, h)]
        top = [t.column("of_top").to_numpy(zero_copy_only=False) for t in (guests, h)]
        coded = pa.chunked_array([*guests.column("label").chunks, *h.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        lx, ly = coded[: len(guests)], coded[len(guests) :]
        order = np.argsort(y.n, kind="stable")
        sizes = y.n[order]
        found: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            pairs = np.concatenate(found)
            found.clear()
            return pa.RecordBatch.from_arrays([*(ids[k].take(pa.array(pairs[:, k])) for k in (0, 1)), pa.array(pairs[:, 2])], ["a", "b", "apart"])

        for i in np.flatnonzero(~top[0]).tolist():
            j = order[np.searchsorted(sizes, -(-int(x.n[i]) * num // den)) : np.searchsorted(sizes, int(x.n[i]) * den // num, "right")]
            j = j[ly[j] != lx[i]]
            if at_home:  # of two texts at home that both go to all blocks, one looks for the other
                j = j[top[1][j] | (j < i)]
            if len(j):
                ok, apart = _near(x, np.full(len(j), i), y, j, num, den)
                found.append(np.column_stack([np.full(len(ok), i), j[ok], apart]))
                n += len(ok)
            if n > 1 << 16:
                yield out()
                n = 0
        if n:
            yield out()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: list[pa.RecordBatch] = []
        now, open_ = None, False  # open: texts at home have not met each other yet

        def settled() -> pa.Table:
            return pa.Table.from_batches(home).combine_chunks()

        for b in batches:
            if not b.num_rows:
                continue
            v, block, visits = (b.column(c).to_numpy(zero_copy_only=False) for c in columns[:3])
            cut = np.flatnonzero((v[1:] != v[:-1]) | (block[1:] != block[:-1]) | (visits[1:] != visits[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(v)], strict=True):
                some = b.select(names).slice(s, e - s)
                if (v[s], block[s]) != now:
                    if open_ and home:
                        yield from pairs_of(settled(), settled(), True)
                    home.clear()
                    now, open_ = (v[s], block[s]), True
                if not visits[s]:
                    home.append(some)
                elif home:
                    if open_:
                        yield from pairs_of(settled(), settled(), True)
                        open_ = False
                    yield from pairs_of(pa.Table.from_batches([some]), settled(), False)
        if open_ and home:
            yield from pairs_of(settled(), settled(), True)

    found = met.mapInArrow(compare, f"a {key}, b {key}, apart long")
    return written(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("apart").alias("apart")), "passed", asked)


def _verified(pairs: DataFrame, docs: DataFrame, w: int, num: int, den: int) -> DataFrame:
    """Pairs at the threshold on full sets. A text is compared in bundles of ``BUNDLE`` partners."""
    key = docs.schema["doc_id"].dataType.simpleString()
    crowded = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BUNDLE)
    pairs = pairs.join(crowded, "a", "left").withColumn("salt", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BUNDLE)))).drop("m")
    asked = pairs.select("a", "salt", F.col("b").alias("doc_id"), F.lit(False).alias("lead")).unionByName(
        pairs.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("doc_id"), F.lit(True).alias("lead"))
    )
    texts, among = only_ids(docs.select("doc_id", "text"), written(asked.select("doc_id").distinct(), "asked"))
    # a merge join whatever the sizes: texts are large beside the pairs
    rows = asked.hint("merge").join(texts, "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("lead")).select("doc_id", "text", "a", "lead")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: np.ndarray | None = None
        for b in batches:
            leads, first = b.column("lead").to_pylist(), b.column("a").to_pylist()
            i, a, c = 0, [], []
            for ids, sets in _sets(iter([b.select(["doc_id", "text"])]), w):
                for doc, u in zip(ids.to_pylist(), sets, strict=True):
                    if leads[i]:
                        lead = u
                    elif _similar(lead, u, num, den):
                        a.append(first[i])
                        c.append(doc)
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(a, b.schema.field("a").type), pa.array(c, b.schema.field("a").type)], ["a", "b"])

    return written(rows.mapInArrow(verify, f"a {key}, b {key}"), "links", among)


class _Found:
    """The links found so far, the labels of their components, and the pairs that were verified."""

    def __init__(self, docs: DataFrame, w: int, num: int, den: int) -> None:
        self.docs, self.how = docs, (w, num, den)
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.tried: DataFrame | None = None

    def _verify(self, pairs: DataFrame) -> None:
        both = lambda x: x.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        pairs = both(pairs.select("a", "b")).dropDuplicates(["lo", "hi"])
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["lo", "hi"], "left_anti")
        pairs = written(pairs.select("a", "b", "lo", "hi"), "chosen")
        if not pairs.limit(1).count():
            return
        tried = pairs.select("lo", "hi")
        self.tried = tried if self.tried is None else self.tried.unionByName(tried)
        new = _verified(pairs.select("a", "b"), self.docs, *self.how)
        if self.labels is None or new.limit(1).count():
            self.links = new if self.links is None else self.links.unionByName(new)
            self.labels = components(self.links, self.labels)

    def closest(self, passed: DataFrame) -> None:
        """Verify the closest partner of each text."""
        self._verify(passed.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"))

    def apart(self, passed: DataFrame) -> None:
        """Verify the pairs whose texts are still in different components."""
        if self.labels is None:  # no pairs
            return
        named = self.labels.withColumnRenamed("label", "l")
        sizes = written(passed.groupBy("a").agg(F.count(F.lit(1)).alias("size")).join(named.withColumnRenamed("node", "a"), "a", "left").select("a", "size", F.coalesce("l", "a").alias("la")), "sides")
        rest = attach(passed, sizes, "a", "size", passed.count()).join(named.withColumnRenamed("node", "b"), "b", "left")
        self._verify(rest.filter(F.col("la") != F.coalesce("l", "b")))


def _search(found: _Found, postings: DataFrame, reps: DataFrame) -> DataFrame | None:
    """``a, b, apart``: all pairs of different components that lists bring together, after the leaders, and the filters let pass."""
    w, num, den = found.how
    rows = _rows(postings, found.labels)
    lists = _open_lists(rows, met=True)
    sums = lists.filter(F.col("open") > LONG * LONG / 2).agg(F.sum("m").alias("m")).first()["m"] or 0
    long_from = max(LONG, sums // LONG_VALUES)
    late = np.sort(lists.filter(F.col("open") > long_from * long_from / 2).select("v").toPandas()["v"].to_numpy(np.int64).view(np.uint64))
    if len(late):  # LONG_VALUES values of 8 bytes at most
        held = found.docs.sparkSession.sparkContext.broadcast(late)
        asked = ids_filter(postings)  # in the same Python step: two in a row would need two workers a task
        instead = _instead(found.docs, w, num, den, held, asked).join(postings.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        instead = written(instead.withColumnRenamed("vs", "instead"), "instead", held, asked[0])
        postings = written(postings.join(instead, "doc_id", "left").select("doc_id", F.coalesce("instead", "vs").alias("vs")), "postings")
        rows = _rows(postings, found.labels)
        lists = _open_lists(rows, met=False)
    return _between(rows, lists, reps, num, den) if lists.limit(1).count() else None


def _one_each(reps: DataFrame) -> DataFrame:
    """A row for each id; the rows already are, unless ids repeat."""
    return reps if reps.count() == reps.select("doc_id").distinct().count() else written(reps.dropDuplicates(["doc_id"]), "reps")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when ``den * |A and B| >= num * |A or B|`` for ``threshold = (num, den)``, with sets of
    ``shingle_words``-word shingles of the text with A-Z lower-cased and words cut at ASCII white space; a text
    of fewer words is one shingle. ``component_id`` is the smallest id reachable over links, ``kept`` marks
    the row that has it. Texts that are null or have no word link with nothing and are kept. A row with a
    null id is its own component (null) and kept. Rows that repeat an id are one node, whose set is one of
    theirs. Further columns are not read.
    """
    w, (num, den) = shingle_words, threshold
    docs = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.filter("doc_id IS NOT NULL")
    base = written(sketches(docs, w), "sketches")
    total = base.count()
    groups = written(base.filter("doc_id IS NOT NULL AND fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    # of a class only the first member goes on
    real = base.filter("doc_id IS NOT NULL AND n > 0")
    later = attach(real.select("doc_id", "fp"), groups.filter("size > 1"), "fp", "size", total).filter("doc_id <> rep").select("doc_id").distinct()
    reps = _one_each(without_ids(real.drop("fp"), written(later, "later"), "reps"))

    postings = _postings(reps)
    found = _Found(named, w, num, den)
    passed = _passed(_with_leader(_rows(postings, None)), reps, num, den)
    found.closest(passed)
    more = _search(found, postings, reps)
    if more is not None:
        found.closest(more)
        passed = passed.unionByName(more)
    found.apart(passed)

    # each row by its set's class, and the class by its representative's component
    nodes = base.select("doc_id", "n", "fp")
    by_class = groups.withColumn("component_id", F.col("rep"))
    if found.labels is not None:
        by_class = groups.join(found.labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    by_class = written(by_class.select("fp", "component_id", "size"), "by_class")
    linked = attach(nodes.filter("fp IS NOT NULL AND doc_id IS NOT NULL"), by_class, "fp", "size", total).select("doc_id", "n", "component_id")
    alone = nodes.filter("fp IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's sets: three-word shingles, linked from 85 % on."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3, threshold=(85, 100))
