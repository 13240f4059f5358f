"""Hard negatives by exact search: candidates lie in Parquet blocks along a Hilbert curve, and zone maps tell which blocks matter.

Vectors are scaled to whole numbers. Their most spread components place each on a Hilbert curve; ranges of the curve are files, and
runs of ``BLOCK`` rows in a file are blocks, one Parquet row each, with the least and greatest value of every component and of the label.
Interval arithmetic over such a zone map bounds the scores that an anchor can have in the block. A block is read for an anchor only if
these bounds meet one of its windows of scores, whose lower end is raised at once to what the anchor's neighbours on the curve
(the anchors of its chunk, which are candidates too) already give.

Two searches are made: the best rows of an anchor's label (its positives), then per positive the best rows of other labels within
the window that its score sets. A search has two steps. Chunks of anchors meet pages of zone maps, which gives the files that a chunk
needs; then chunks meet files. Either meeting is a cogroup of bounded size (``SLOT`` chunks and one page or file), whatever the number of rows, and what
it gives is at most the best few rows a window. All scores are whole numbers, exact in doubles or else computed as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows of a block, of a file (about) and of a chunk of anchors; chunks that meet a file or page at once; files a page.
BLOCK, FILE, CHUNK, SLOT, PAGE = 512, 65_536, 512, 64, 32
#: Components and bits of each that place a vector on the curve.
AXES, BITS = 8, 6
#: Scaled components stay within this: scores fit a long up to 2^15 components.
MOST = 1 << 24
_FAR = 1 << 62


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cells, each of ``bits`` bits (Skilling's method, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(on, q - 1, swap)
            if i:
                x[i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _scaled(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows whose components are all finite, with these scaled, floored and in bytes."""
    for b in batches:
        vectors = b.column("v")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten()
        x = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(b.num_rows), sizes)
        good = np.bincount(row, weights=~np.isfinite(x), minlength=b.num_rows) == 0
        q = np.clip(np.nan_to_num(x[good[row]]), -MOST, MOST).astype(np.int32).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[good]) * 4])
        keep = pa.array(np.flatnonzero(good))
        data = pa.array([q[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id").take(keep), b.column("label").take(keep), b.column("anchor").take(keep), data], ["id", "label", "anchor", "q"])


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """One row a vector; a shorter one is filled up with zeros."""
    return np.frombuffer(b"".join(v.ljust(4 * dims, b"\0") for v in vectors), np.int32).reshape(len(vectors), dims)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Per component a task's sum and sum of squares."""
    s, ss = np.zeros(dims), np.zeros(dims)
    for b in batches:
        x = _matrix(b.column(0).to_pylist(), dims).astype(float)
        s, ss = s + x.sum(axis=0), ss + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(s), pa.array(ss)], ["d", "s", "ss"])


def _placed(batches: Iterator[pa.RecordBatch], dims: int, axes: np.ndarray, low: np.ndarray, width: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column("q").to_pylist(), dims)[:, axes]
        cells = np.clip((x - low) / width * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells, BITS) if len(axes) else np.zeros(b.num_rows, np.int64))], [*b.schema.names, "place"])


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list, list]]:
    """Runs of ``size`` rows in order (ids, labels, vectors); a row that is equal to the one before is left out."""
    run: tuple[list, list, list] = ([], [], [])
    last = None
    for b in batches:
        for row in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("q").to_pylist(), strict=True):
            if row == last:
                continue
            last = row
            for to, x in zip(run, row, strict=True):
                to.append(x)
            if len(run[0]) == size:
                yield run
                run = ([], [], [])
    if run[0]:
        yield run


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    file = TaskContext.get().partitionId()
    for k, (ids, labels, vectors) in enumerate(_runs(batches, BLOCK)):
        q, ids, labels = _matrix(vectors, dims), np.array(ids, np.int64), np.array(labels, np.int64)
        yield pa.RecordBatch.from_pylist(
            [{"file": file, "block": k, "low": q.min(axis=0).tobytes(), "high": q.max(axis=0).tobytes(), "least": labels.min(), "most": labels.max(), "ids": ids.tobytes(), "labels": labels.tobytes(), "q": q.tobytes()}],
            pa.schema([("file", pa.int32()), ("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary())]),
        )


_ASKED = "chunk long, slot int, ids binary, labels binary, q binary, low binary, high binary, of binary, of_score binary"
_ZONES = "file int, block int, low binary, high binary, least long, most long"


def _asked(chunk: int, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, of_score: np.ndarray, slot: int) -> pa.RecordBatch:
    """A chunk of anchors with their windows of scores, and for each the id and score of the row that sets it."""
    values = [chunk, slot, *(np.ascontiguousarray(x).tobytes() for x in (ids, labels, q, low, high, of, of_score))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 7), strict=True)], [x.split()[0] for x in _ASKED.split(", ")])


class Asked:
    """A chunk's anchors, read from its row."""

    def __init__(self, row: dict, dims: int, kind: type) -> None:
        self.chunk = row["chunk"]
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        n = len(self.ids)
        self.q = np.frombuffer(row["q"], np.int32).reshape(n, dims).astype(kind)
        self.low, self.high, self.of, self.of_score = (np.frombuffer(row[k], np.int64).reshape(n, -1) for k in ("low", "high", "of", "of_score"))

    def needs(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(whether an anchor needs a block, the greatest score it can have there), by the blocks' zone maps."""
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        top, bottom = up @ high.T + down @ low.T, up @ low.T + down @ high.T
        label = self.labels[:, None]
        fits = (least <= label) & (label <= most) if same else (least != label) | (most != label)
        meets = np.zeros(top.shape, bool)
        for w in range(self.low.shape[1]):
            meets |= (top >= self.low[:, w, None]) & (bottom <= self.high[:, w, None])
        return fits & meets, top


def _best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each anchor's entries the first ``k`` by score, then id: their places."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[rank < k]


def _floors(asked: Asked, same: bool, k: int) -> np.ndarray:
    """The windows' lower ends, raised to the ``k``-th best score that the chunk's own anchors give."""
    score = (asked.q @ asked.q.T).astype(np.int64)
    fits = ((asked.labels[:, None] == asked.labels) == same) & (asked.ids[:, None] != asked.ids)
    low = asked.low.copy()
    if len(asked.ids) >= k:
        for w in range(low.shape[1]):
            ok = np.where(fits & (score >= low[:, w, None]) & (score <= asked.high[:, w, None]), score, -_FAR)
            low[:, w] = np.maximum(low[:, w], np.partition(ok, len(ok) - k, axis=1)[:, len(ok) - k])
    return low


def _columns(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _search(asked: DataFrame, blocks: DataFrame, n_files: int, n_slots: int, dims: int, kind: type, same: bool, k: int) -> DataFrame:
    """``chunk, i, w, anchor_id, of, of_score, id, score, rank``: the first ``k`` rows of each anchor's windows."""

    def zone_arrays(zones: list[dict]) -> tuple[np.ndarray, ...]:
        low, high = (np.frombuffer(b"".join(z[x] for z in zones), np.int32).reshape(len(zones), dims).astype(kind) for x in ("low", "high"))
        return low, high, *(np.array([z[x] for z in zones], np.int64) for x in ("least", "most"))

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        zones = _columns(right)
        files = np.array([z["file"] for z in zones], np.int32)
        out: tuple[list, list, list] = ([], [], [])
        if zones:
            arrays = zone_arrays(zones)
            for row in _columns(left):
                a = Asked(row, dims, kind)
                for f in np.unique(files[a.needs(*arrays, same)[0].any(axis=0)]).tolist():
                    for to, x in zip(out, (a.chunk, row["slot"], f), strict=True):
                        to.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["chunk", "slot", "file"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        blocks = _columns(right)
        for row in _columns(left) if blocks else ():
            a = Asked(row, dims, kind)
            need, top = a.needs(*zone_arrays(blocks), same)
            width, low = a.low.shape[1], a.low.copy()
            entries = [np.zeros(0, np.int64) for _ in range(3)]  # anchor and window, score, id
            for j in np.argsort(-top.max(axis=0)).tolist():  # what may be best first: it raises the windows' lower ends
                mine = np.flatnonzero(need[:, j] & (top[:, j] >= low.min(axis=1)))
                if not len(mine):
                    continue
                b = blocks[j]
                ids, labels = (np.frombuffer(b[x], np.int64) for x in ("ids", "labels"))
                s = (a.q[mine] @ np.frombuffer(b["q"], np.int32).reshape(len(ids), dims).astype(kind).T).astype(np.int64)
                fits = ((a.labels[mine, None] == labels) == same) & (a.ids[mine, None] != ids)
                new = []
                for w in range(width):
                    i, c = np.nonzero(fits & (s >= low[mine, w, None]) & (s <= a.high[mine, w, None]))
                    new.append((mine[i] * width + w, s[i, c], ids[c]))
                entries = [np.concatenate([e, *x]) for e, x in zip(entries, zip(*new, strict=True), strict=True)]
                at = _best(*entries, k)
                entries = [e[at] for e in entries]
                full = np.flatnonzero(np.bincount(entries[0], minlength=low.size) == k)
                least = np.full(low.size, _FAR)
                np.minimum.at(least, entries[0], entries[1])
                low.reshape(-1)[full] = np.maximum(low.reshape(-1)[full], least[full])
            i, w = entries[0] // width, entries[0] % width
            found.append([np.full(len(i), a.chunk), i, w, a.ids[i], a.of[i, w], a.of_score[i, w], entries[2], entries[1]])
        made = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 8
        return pa.table([pa.array(x, pa.int64()) for x in made], names=["chunk", "i", "w", "anchor_id", "of", "of_score", "id", "score"])

    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    zones = blocks.select(*(x.split()[0] for x in _ZONES.split(", ")), F.floor(F.col("file") / PAGE).cast("int").alias("page"))
    pages = asked.select("*", every("page", -(-n_files // PAGE)))
    routed = pages.groupBy("page", "slot").cogroup(zones.select("*", every("slot", n_slots)).groupBy("page", "slot")).applyInArrow(route, "chunk long, slot int, file int")
    routed = written(routed, "routed")
    read = blocks.join(routed.select("file", "slot").distinct(), "file")
    asking = asked.join(routed.select("chunk", "file"), "chunk")
    found = asking.groupBy("file", "slot").cogroup(read.groupBy("file", "slot")).applyInArrow(score, "chunk long, i long, w long, anchor_id long, of long, of_score long, id long, score long")
    best = Window.partitionBy("chunk", "i", "w").orderBy(F.col("score").desc(), "id")
    return written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    A score is the inner product of vectors whose components x became floor(scale * x). An anchor's positives are the first ``positives``
    other rows of its label; a positive's negatives are the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of
    the positive's. First means by score, then by smaller id. An anchor without positives, and a positive without such rows, give nothing.
    Rows with a null id, label or vector, or a null or non-finite component, take no part. A shorter vector counts as if filled up with zeros (an empty
    one scores 0). Scaled components are held to +-2^24. Rows equal in id, label and vector count once; other rows that repeat an id are rows of
    their own, and none is its own anchor's positive or negative. Further columns are not read, but by ``anchor``.
    """
    spark = rows.sparkSession
    given = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    given = given.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    scaled = written(given.mapInArrow(lambda x: _scaled(x, scale), "id long, label long, anchor boolean, q binary"), "vectors")
    known = scaled.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.coalesce(F.max(F.length("q")), F.lit(0)).alias("size")).first()
    dims, n = known["size"] // 4, known["n"]
    sums = scaled.select("q").mapInArrow(lambda x: _sums(x, dims), "d long, s double, ss double").groupBy("d").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("d").toPandas()
    mean = sums["s"].to_numpy() / max(n, 1)
    spread = np.sqrt(np.maximum(sums["ss"].to_numpy() / max(n, 1) - mean**2, 0))
    axes = np.sort(np.argsort(-spread, kind="stable")[:AXES])
    start, width = mean[axes] - 2.5 * spread[axes], np.maximum(5 * spread[axes], 1)
    # scores stay below the greatest sum of squares that a row can have
    kind = float if MOST * MOST * dims < 1 << 53 or sums["ss"].sum() < 1 << 53 else np.int64
    placed = written(scaled.mapInArrow(lambda x: _placed(x, dims, axes, start, width), "id long, label long, anchor boolean, q binary, place long"), "placed")

    order = ["place", "id", "label", "q"]
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = placed.repartitionByRange(max(few, -(-n // FILE)), "place", "id").sortWithinPartitions(*order)
    blocks = written(files.mapInArrow(lambda x: _blocks(x, dims), f"{_ZONES}, ids binary, labels binary, q binary"), "blocks")

    n_chunks = max(min(few, 8), -(-known["anchors"] // CHUNK))
    n_slots = -(-n_chunks // SLOT)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for j, (ids, labels, vectors) in enumerate(_runs(batches, CHUNK)):
            wide = np.full((len(ids), 1), _FAR)
            row = dict(chunk=part << 32 | j, slot=part % n_slots, ids=np.array(ids, np.int64), labels=np.array(labels, np.int64), q=_matrix(vectors, dims), low=-wide, high=wide, of=0 * wide, of_score=0 * wide)
            a = Asked({k: x.tobytes() if isinstance(x, np.ndarray) else x for k, x in row.items()}, dims, kind)
            yield _asked(**row | {"low": _floors(a, True, positives)})

    anchors = placed.filter("anchor").repartitionByRange(n_chunks, "place", "id").sortWithinPartitions(*order)
    asked = written(anchors.mapInArrow(chunks, _ASKED), "asked")
    n_files = (blocks.agg(F.max("file")).first()[0] or 0) + 1
    best = _search(asked, blocks, n_files, n_slots, dims, kind, True, positives)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                a = Asked(row, dims, kind)
                lower, upper = np.full((len(a.ids), positives), _FAR), np.full((len(a.ids), positives), -_FAR)  # no window
                of, of_score = np.zeros_like(lower), np.zeros_like(lower)
                for p in row["best"]:
                    at = p["i"], p["rank"] - 1
                    of[at], of_score[at] = p["id"], p["score"]
                    lower[at], upper[at] = -(-low * p["score"] // 100), high * p["score"] // 100
                a.low, a.high = lower, upper
                yield _asked(a.chunk, a.ids, a.labels, a.q.astype(np.int32), _floors(a, False, negatives), upper, of, of_score, row["slot"])

    told = best.groupBy("chunk").agg(F.collect_list(F.struct("i", "rank", "id", "score")).alias("best"))  # CHUNK * positives at most
    again = written(asked.join(told, "chunk").mapInArrow(windows, _ASKED), "windows")
    found = _search(again, blocks, n_files, n_slots, dims, kind, False, negatives)
    return found.select("anchor_id", F.col("of").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("of_score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are all rows whose id is divisible by 100; every seventh row's label is changed first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
