"""Best-fit packing of texts into sequences of several permitted lengths.

Which lengths go together is decided on the histogram of lengths, which has a row a length (the largest
permitted one at most) whatever the number of texts. A text goes to the open bin that it fills best; where none has
room, the size is opened that costs least for what such a bin will probably hold. Bins that hold the same are
one entry with a count, so the plan stays small. Texts then find their place by their rank among those of their length; ranks are
counted per bucket of ids first, so one length may hold most texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: What a sequence costs besides its length, in units of length.
OVERHEAD = 16
#: Texts of one length and bucket that are ranked together (expected number).
BUCKET = 50_000


class _Opener:
    """Which size to open for texts of a length: the least cost a unit of what the bin will probably hold and be downsized to.

    What it will hold is the length itself and then, time and again, the longest text left that fits. Texts that
    earlier bins were opened for are spoken for.
    """

    def __init__(self, histogram: dict[int, int], capacities: list[int]) -> None:
        self.free, self.capacities = dict(histogram), sorted(capacities)
        self.lengths = sorted(histogram)

    def _fill(self, length: int, left: int, capacity: int) -> list[tuple[int, int]]:
        """(length, how often) of the probable contents."""
        each = min(capacity // length, left)
        out, room = [(length, each)], capacity - length * each
        at = bisect_right(self.lengths, min(room, length - 1)) - 1
        while room and at >= 0:
            n = self.lengths[at]
            if not self.free[n]:
                self.lengths.pop(at)
                at -= 1
                continue
            times = min(room // n, self.free[n])
            out.append((n, times))
            room -= n * times
            at = min(at, bisect_right(self.lengths, room)) - 1
        return out

    def __call__(self, length: int, left: int) -> tuple[int, int]:
        """(capacity, how many to open of it)."""
        best = None
        for c in self.capacities[bisect_left(self.capacities, length) :]:
            contents = self._fill(length, left, c)
            total = sum(n * k for n, k in contents)
            closed = self.capacities[bisect_left(self.capacities, total)]
            cost = (closed + OVERHEAD) / total
            if best is None or cost < best[0]:
                best = cost, c, contents
        _, capacity, contents = best
        times = min(left // contents[0][1], *(self.free[n] // k for n, k in contents[1:])) if len(contents) > 1 else left // contents[0][1]
        for n, k in contents[1:]:
            self.free[n] -= k * times
        return capacity, times


def _pack(histogram: dict[int, int], opened: Callable[[int, int], tuple[int, int]]) -> list[tuple[int, tuple, int]]:
    """Best-fit decreasing in bulk: (capacity, contents, times).

    ``opened`` gives the size to open for so many texts of a length, and how many of it. Contents are pairs of a
    length and how often it stands there.
    """
    bins: dict[int, list[list]] = {}  # residual -> [[capacity, contents, times], ...]
    residuals: list[int] = []

    def put(residual: int, entry: list) -> None:
        if residual not in bins:
            bins[residual] = []
            insort(residuals, residual)
        bins[residual].append(entry)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                entry = bins[residual].pop()
                if not bins[residual]:
                    del bins[residual]
                    residuals.pop(at)
                capacity, contents, times = entry
            else:
                capacity, times = opened(length, left)
                residual, contents = capacity, ()
            each = residual // length
            full = min(times, left // each)
            if full:
                put(residual - each * length, [capacity, (*contents, (length, each)), full])
                left -= full * each
            times -= full
            if times and left:  # the last bin takes fewer
                put(residual - left * length, [capacity, (*contents, (length, left)), 1])
                times, left = times - 1, 0
            if times and contents:
                put(residual, [capacity, contents, times])
    return [(c, contents, times) for some in bins.values() for c, contents, times in some]


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, tuple, int]]:
    """(capacity, contents, times) of the cheapest plan; a bin costs its capacity and ``OVERHEAD``.

    Bins are filled by best fit, and at last each gets the smallest size that holds its contents. One plan chooses the size
    of each bin that it opens by what is left (``_Opener``); the others open no larger size than one of the capacities.
    The histogram has a row a length, so this work is bounded by the largest capacity, whatever the number of texts.
    """
    capacities = sorted(capacities)
    fit = lambda n: capacities[bisect_left(capacities, n)]
    single = lambda most: lambda length, left: (c := max(most, fit(length)), -(-left // (c // length)))
    best, least = [], None
    for opened in (_Opener(histogram, capacities), *map(single, capacities)):
        done = [(fit(sum(n * k for n, k in contents)), contents, times) for _, contents, times in _pack(histogram, opened)]
        cost = sum((c + OVERHEAD) * times for c, _, times in done)
        if least is None or cost < least:
            best, least = done, cost
    return sorted(best, key=lambda x: (-x[0], x[1], x[2]))


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n", capacities: tuple[int, ...] = (512, 1024, 2048, 4096)) -> DataFrame:
    """One row per piece of a text: ``doc_id, piece, start, n, bin_id, capacity, place``.

    A text longer than the largest capacity is cut into pieces of that length and a rest; ``start`` is where the piece
    begins in the text and ``place`` where it stands in its sequence. A text of length 0 or null has one row
    without a bin. Rows that repeat an id, and rows of a null id, are packed one by one, and ranked in as many tasks as
    others: ``row`` tells them apart. Further columns are not read.
    """
    most = max(capacities)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("total"), F.monotonically_increasing_id().alias("row"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col("total") - 1) / most, F.lit(0)).cast("long"))).alias("piece")
    pieces = docs.select("doc_id", "row", "total", cut).withColumn("start", F.col("piece") * most).withColumn("n", F.least(F.col("total") - F.col("start"), F.lit(most)))
    pieces = written(pieces.drop("total"), "pieces")
    real = pieces.filter("n > 0")
    total = real.count()
    buckets = max(1, -(-total // BUCKET))
    real = real.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(buckets)))
    sizes = written(real.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("m")), "sizes")
    histogram = {r["n"]: r["m"] for r in sizes.groupBy("n").agg(F.sum("m").alias("m")).collect()}  # as many rows as lengths
    before = F.coalesce(F.sum("m").over(W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("n", "bucket", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("n", "bucket").orderBy("doc_id", "piece", "row")) - 1
    ranked = real.withColumn("local", rank).join(offsets, ["n", "bucket"]).select("doc_id", "piece", "start", "n", (F.col("local") + F.col("before")).alias("rank"))

    # runs of ranks: those of length n from `first` on go to the bins from `bin` on, `each` to a bin
    used: dict[int, int] = {}
    runs, bin_id = [], 0
    for capacity, contents, times in plan(histogram, list(capacities)):
        place = 0
        for n, each in contents:
            first = used.get(n, 0)
            runs.append((n, first, bin_id, each, place, capacity))
            used[n] = first + each * times
            place += n * each
        bin_id += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    held = docs.sparkSession.sparkContext.broadcast(table)
    key = docs.schema["doc_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in batches:
            if not b.num_rows:
                continue
            n, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "rank"))
            lo, hi = np.searchsorted(t[:, 0], n, "left"), np.searchsorted(t[:, 0], n, "right")
            # the last run of the length that begins at the rank or before
            while (open_ := hi - lo > 1).any():
                mid = (lo + hi) // 2
                up = t[np.minimum(mid, len(t) - 1), 1] <= r
                lo, hi = np.where(open_ & up, mid, lo), np.where(open_ & ~up, mid, hi)
            x = t[lo]
            step = r - x[:, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("start"), b.column("n"), pa.array(x[:, 2] + step // x[:, 3]), pa.array(x[:, 5]), pa.array(x[:, 4] + n * (step % x[:, 3]))],
                ["doc_id", "piece", "start", "n", "bin_id", "capacity", "place"],
            )

    out = ranked.mapInArrow(placed, f"doc_id {key}, piece long, start long, n long, bin_id long, capacity long, place long")
    none = pieces.filter("n <= 0").select("doc_id", "piece", "start", "n", *(F.lit(None).cast("long").alias(c) for c in ("bin_id", "capacity", "place")))
    return out.unionByName(none)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by their length in UTF-8 bytes, as a byte-level model reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("n"))
    return pack(docs, capacities=(1024, 2048, 4096, 8192))
