"""Content-chosen anchors: any two equal windows hold the same anchor at the same offset.

Of each window of ``size`` items the run of ``k`` items with the smallest hash (the leftmost on ties) is an
anchor. Its place depends on the window's content alone, so all occurrences of a window are found among
the occurrences of its anchor, some ``2 / (size - k + 2)`` of all places. Only anchors that may occur
more than once (``repeats``) leave their task, with the items around them that a common window can reach:
``size - k`` to the left and ``size`` to the right.

Occurrences with equal surroundings form a class. Each task merges its own and sends a class's first member with a
128-bit key; these meet by anchor, which finds the first member of all. All other members are covered as far as
their surroundings reach. Anchors with several classes ask for the surroundings of the first members, which the texts that
have them send, and ``solve`` finds what they share with earlier ones. So a passage that is in very many texts
does not gather in a task, and surroundings move only where they are compared: whatever the size of the input, an anchor
sends a key at most and a text moves once at most. An anchor with more than ``CLASSES`` different surroundings
(a passage's edge in very many texts) isn't held in memory either: its windows are hashed one by one, and their first
occurrences found by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import mix, pieces
from .repeats import PARTS, id_codes, may_repeat, only_ids, parts, repeat_filter
from .shared import attach, bounded, written

#: Surroundings of one anchor that are compared in memory.
CLASSES = 1 << 16
#: Places that a task holds before it merges their classes.
PLACES = 1 << 18
#: Bits of the filter of anchors that may repeat: the most numerous codes.
ANCHOR_BITS = 28
_LOW = np.uint64((1 << 28) - 1)

#: (data, row offsets) -> (item bounds of the rows, code of each run of k items, item -> context row of bytes)
Coder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable]]
#: classes (context bytes, items to the left, items to the right), first ones first -> per class (left, right) reach or None
Solver = Callable[[list[tuple[bytes, int, int]]], list[tuple[int, int] | None]]


def minimizers(codes: np.ndarray, bounds: np.ndarray, k: int, size: int) -> np.ndarray:
    """Places of the anchors. ``codes[i]`` is the code of the k items from i on; rows are ``bounds``."""
    w = size - k + 1
    if len(codes) < w:
        return np.zeros(0, np.int64)
    key = (codes & ~_LOW) | np.arange(len(codes), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    ok = np.zeros(len(least) + 1, np.int32)  # windows that stay within a row
    a, b = bounds[:-1], bounds[1:] - size + 1
    full = b > a
    np.add.at(ok, a[full], 1)
    np.add.at(ok, np.minimum(b[full], len(least)), -1)
    places = (least[np.cumsum(ok[:-1]) > 0] & _LOW).astype(np.int64)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def _two(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each row of a byte matrix."""
    wide = x.shape[1] + (-x.shape[1]) % 8
    full = np.zeros((len(x), wide), np.uint8)
    full[:, : x.shape[1]] = x
    h = full.view(np.uint64)
    a, b = np.full(len(x), 7, np.uint64), np.full(len(x), 11, np.uint64)
    for j in range(h.shape[1]):
        a = mix(a + h[:, j])
        b = mix(b * np.uint64(0x9E3779B97F4A7C15) ^ h[:, j])
    return a, b


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    values = ids.to_pylist()
    number = {repr(v): i for i, v in enumerate(sorted(values, key=lambda v: tuple(v.values()) if isinstance(v, dict) else v))}
    return np.array([number[repr(v)] for v in values])


def covered(docs: DataFrame, coder: Coder, solve: Solver, k: int, size: int, item_bytes: int) -> DataFrame:
    """``doc_id, lo, hi``: item spans of ``docs(doc_id, text)`` covered by windows that also start earlier. Tasks merge what they have.

    Earlier is in a smaller id, or in the same text before. Spans of a text may overlap. Rows whose id is
    null take no part. Of rows that repeat an id, windows count as those of one text.
    """
    docs = bounded(docs).filter("doc_id IS NOT NULL").select("doc_id", "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    left, right = size - k, size
    width = (left + right) * item_bytes
    most = CLASSES

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for at, data, offsets in pieces(texts):
                bounds, codes, context = coder(data, offsets)
                places = minimizers(codes, bounds, k, size)
                yield at, ids.slice(at, len(offsets) - 1), bounds, codes[places], places, context

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, _, h, _, _ in anchors(batches):
            yield h

    again = repeat_filter(docs.mapInArrow(lambda it: parts(codes_of(it), ANCHOR_BITS), PARTS), ANCHOR_BITS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row of the batch, id, anchor, place, items to the left, to the right, surroundings, their key) of what may repeat."""
        for at, ids, bounds, h, places, context in anchors(batches):
            keep = may_repeat(again.value, h, ANCHOR_BITS)
            h, places = h[keep], places[keep]
            row = np.searchsorted(bounds, places, "right") - 1
            a = np.minimum(places - bounds[row], left)
            c = np.minimum(bounds[row + 1] - places, right)
            around = context(places, a, c, left, right)
            tag = np.concatenate([around, a.astype(np.uint16)[:, None].view(np.uint8), c.astype(np.uint16)[:, None].view(np.uint8), h[:, None].view(np.uint8)], axis=1)
            yield at + row, ids.take(pa.array(row)), h, places - bounds[row], a, c, around, *_two(tag)

    names = ["h", "k1", "k2", "doc_id", "lo", "place", "hi"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first member of each class that the task has, and the spans of its other members (without ``k1`` and ``place``)."""
        held: list[tuple] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([x[0] for x in held])
            h, place, lo, hi, k1, k2 = (np.concatenate([x[i] for x in held]) for i in range(1, 7))
            held.clear()
            order = np.lexsort((place, _ranks(ids), k2, k1))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
            i = order[new]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[i].view(np.int64)) for x in (h, k1, k2)), ids.take(pa.array(i)), *(pa.array(x[i]) for x in (lo, place, hi))], names)
            i = order[~new]
            if len(i):
                b = _merged(ids.take(pa.array(i)), lo[i], hi[i])
                none = pa.nulls(len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(id_codes(b.column(0)).view(np.int64)), none, none, b.column(0), b.column(1), none, b.column(2)], names)

        for _, ids, h, place, a, c, _, k1, k2 in found(batches):
            held.append((ids, h, place, place - a, place + c, k1, k2))
            n += len(h)
            if n > PLACES:
                yield from out()
                n = 0
        if n:
            yield from out()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by anchor, class and place: first members of classes of an anchor with several, and all others' spans."""
        last: pa.Table | None = None  # the first member of the class that was read last
        among = False  # its anchor has another class before
        for b in batches:
            done = b.filter(b.column("k1").is_null())
            if len(done):
                yield done
            t = pa.Table.from_batches([b.filter(b.column("k1").is_valid())])
            if not len(t):
                continue
            t = pa.concat_tables([last, t]).combine_chunks() if last is not None else t.combine_chunks()
            h, k1, k2 = (t.column(c).to_numpy() for c in names[:3])
            new = np.ones(len(t), bool)
            new[1:] = (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            first, rest = np.flatnonzero(new), t.take(pa.array(np.flatnonzero(~new)))
            if len(rest):
                for c in ("k1", "k2", "place"):
                    rest = rest.set_column(names.index(c), c, pa.nulls(len(rest), pa.int64()))
                yield from rest.to_batches()
            same = h[first[1:]] == h[first[:-1]]
            several = np.concatenate([[among], same]) | np.concatenate([same, [False]])
            among = bool(several[-1])
            last = t.slice(first[-1], 1)
            yield from t.take(pa.array(first[:-1][several[:-1]])).to_batches()
        if last is not None and among:
            yield from last.to_batches()

    row_type = f"h long, k1 long, k2 long, doc_id {key}, lo long, place long, hi long"
    sorted_keys = docs.mapInArrow(keys, row_type).repartition("h").sortWithinPartitions("h", "k1", "k2", "doc_id", "place")
    classes = written(sorted_keys.mapInArrow(firsts, row_type), "classes")
    wanted = classes.filter("place IS NOT NULL").groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_list("k1").alias("codes"))
    wanted = written(wanted, "wanted")
    texts, among = only_ids(docs, wanted)
    asked = wanted.hint("merge").join(texts, "doc_id").select("doc_id", "text", "places", "codes")

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The surroundings that are asked for."""
        names = ["h", "k1", "k2", "doc_id", "place", "a", "c", "around"]
        for b in batches:
            at = np.repeat(np.arange(len(b), dtype=np.uint64), b.column("places").value_lengths().to_numpy(zero_copy_only=False))
            code = lambda row, place, k1: mix(mix(row.astype(np.uint64)) + place.astype(np.uint64)) ^ k1
            want = code(at, b.column("places").flatten().to_numpy(), b.column("codes").flatten().to_numpy().view(np.uint64))
            for row, ids, h, place, a, c, around, k1, k2 in found(iter([b])):
                i = np.flatnonzero(np.isin(code(row, place, k1), want))
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(i), [None, pa.py_buffer(np.ascontiguousarray(around[i]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[i].view(np.int64)) for x in (h, k1, k2)), ids.take(pa.array(i)), pa.array(place[i]), pa.array(a[i].astype(np.int16)), pa.array(c[i].astype(np.int16)), flat], names
                )

    def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor, class and place: covered spans (kind 0), and windows to be counted (1)."""
        names = ["kind", "k1", "k2", "doc_id", "lo", "hi"]
        out: dict[str, list] = {n: [] for n in names}
        held: list[tuple] = []  # first members of the anchor's classes: (doc, place, a, c, around)
        now, wide = None, False  # wide: the anchor has more classes than are compared in memory
        kind_of_id = None

        def put(*values) -> None:
            for n, v in zip(names, values, strict=True):
                out[n].append(v)

        def windows() -> None:
            x = np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(len(held), width)
            a, c = np.array([r[2] for r in held]), np.array([r[3] for r in held])
            for o in range(left + 1):  # the window that starts o items before the anchor
                ok = np.flatnonzero((a >= o) & (c >= size - o))
                w1, w2 = _two(x[ok, (left - o) * item_bytes : (left - o + size) * item_bytes])
                for i, u, v in zip(ok.tolist(), w1.view(np.int64).tolist(), w2.view(np.int64).tolist(), strict=True):
                    put(1, u, v, held[i][0], held[i][1] - o, held[i][1] - o + size)
            held.clear()

        def close() -> None:
            if wide:
                windows()
            elif len(held) > 1:
                held.sort(key=lambda r: (tuple(r[0].values()) if isinstance(r[0], dict) else r[0], r[1]))
                for r, reach in zip(held, solve([(r[4], r[2], r[3]) for r in held]), strict=True):
                    if reach is not None:
                        put(0, None, None, r[0], r[1] - reach[0], r[1] + reach[1])
            held.clear()

        def batch() -> pa.RecordBatch:
            types = [pa.int8(), pa.int64(), pa.int64(), kind_of_id, pa.int64(), pa.int64()]
            got = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)
            for c in out.values():
                c.clear()
            return got

        this = None
        for b in batches:
            kind_of_id = b.schema.field("doc_id").type
            for h, k1, k2, doc, place, a, c, around in zip(*(b.column(n).to_pylist() for n in ("h", "k1", "k2", "doc_id", "place", "a", "c", "around")), strict=True):
                if h != now:
                    close()
                    now, wide, this = h, False, None
                if this == (k1, k2):  # another row of that id
                    continue
                this = (k1, k2)
                if len(held) >= most:
                    wide = True
                    windows()
                held.append((doc, place, a, c, around))
            if len(out["kind"]) > 5000:
                yield batch()
        close()
        if kind_of_id is not None and out["kind"]:
            yield batch()

    met = asked.mapInArrow(leaders, f"h long, k1 long, k2 long, doc_id {key}, place long, a short, c short, around binary")
    met = met.repartition("h").sortWithinPartitions("h", "k1", "k2", "doc_id", "place")
    told = written(met.mapInArrow(by_anchor, f"kind byte, k1 long, k2 long, doc_id {key}, lo long, hi long"), "told", again, among)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _merged(b.column(0), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi")))

    spans = classes.filter("place IS NULL").select("doc_id", "lo", "hi").unionByName(told.filter("kind = 0").select("doc_id", "lo", "hi"))
    spans = spans.mapInArrow(merge, f"doc_id {key}, lo long, hi long")
    windows_of = told.filter("kind = 1").select(F.struct("k1", "k2").alias("k"), "doc_id", "lo", "hi")
    if (n_windows := windows_of.count()) > 0:
        seen = written(windows_of.groupBy("k").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "windows")
        twice = attach(windows_of, seen, "k", "m", n_windows).filter("doc_id <> first.doc_id OR lo <> first.lo").select("doc_id", "lo", "hi")
        spans = spans.unionByName(twice)
    return spans


def _merged(ids: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """The maximal spans of a batch, per text."""
    codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((lo, codes))
    codes, lo, hi = codes[order], lo[order], hi[order]
    base = codes * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(lo), bool)
    new[1:] = (lo + base)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(lo)) - 1
    return pa.RecordBatch.from_arrays([ids.take(pa.array(order[at])), pa.array(lo[at]), pa.array(reach[end] - base[end])], ["doc_id", "lo", "hi"])


def by_text(spans: DataFrame) -> DataFrame:
    """``doc_id, spans``: the pieces of each text in order, which may overlap (``joined_spans`` joins them)."""
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def joined_spans(rows: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans of a text from its sorted pieces."""
    out: list[list[int]] = []
    for x in rows or []:
        if out and x["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["hi"])
        else:
            out.append([x["lo"], x["hi"]])
    return [(a, b) for a, b in out]
