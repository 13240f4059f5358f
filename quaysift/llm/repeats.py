"""Which of very many 64-bit codes may occur more than once: a two-pass Bloom filter of fixed size.

Each task keeps two sparse bit sets over ``2**bits`` slots, one of slots seen and one of slots seen
again, and sends both as short lists by block of slots; blocks merge by OR, where a slot seen in two
parts counts as seen again. So some 2 bytes a code are shuffled, and no row. The merged filter has
``2**bits / 8`` bytes (16 MB at the largest setting) whatever the input, so it may be broadcast. It
has no false negatives; with more codes than slots it lets more through, and callers stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType

from .codes import mix
from .shared import written

BLOCK_BITS = 16
MOST_BITS = 27
PARTS = "block int, seen binary, again binary"
#: Codes that a task holds before it sends its lists on.
HELD = 1 << 19


def bits_for(n: int) -> int:
    """Some 16 slots a code, within the bound of the broadcast."""
    return min(MOST_BITS, max(BLOCK_BITS, (16 * max(n, 1)).bit_length()))


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    """Slots of codes, mixed once more: codes may have been chosen for being small."""
    return mix(codes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)


def _parts(codes: list[np.ndarray], bits: int, times_all: int = 1) -> pa.RecordBatch:
    slots, times = np.unique(_slots(np.concatenate(codes), bits), return_counts=True)
    times = times * times_all
    block = (slots >> np.uint64(BLOCK_BITS)).astype(np.int32)
    low = (slots & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    ids, at = np.unique(block, return_index=True)
    bounds = [*at.tolist(), len(block)]
    seen, again = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        seen.append(low[a:b].tobytes())
        again.append(low[a:b][times[a:b] > 1].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen, pa.binary()), pa.array(again, pa.binary())], ["block", "seen", "again"])


def parts(codes: Iterator[np.ndarray], bits: int, times: int = 1) -> Iterator[pa.RecordBatch]:
    """A task's share of the filter, for a ``mapInArrow`` with schema ``PARTS``.

    With ``times`` 2 each code counts twice, so the filter is of codes seen at all.
    """
    held: list[np.ndarray] = []
    n = 0
    for x in codes:
        if len(x):
            held.append(x)
            n += len(x)
        if n >= HELD:
            yield _parts(held, bits, times)
            held, n = [], 0
    if held:
        yield _parts(held, bits, times)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BLOCK_BITS
    now, seen, again = None, np.zeros(size, bool), np.zeros(size, bool)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for block, s, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if block != now:
                if now is not None and again.any():
                    yield out()
                now = block
                seen[:] = again[:] = False
            s = np.frombuffer(s, np.uint16)
            again[s] |= seen[s]
            seen[s] = True
            again[np.frombuffer(a, np.uint16)] = True
    if now is not None and again.any():
        yield out()


def repeat_filter(part_rows: DataFrame, bits: int) -> Broadcast:
    """Merge the tasks' shares and broadcast the bits of slots seen again (``2**bits / 8`` bytes)."""
    merged = part_rows.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (BLOCK_BITS - 3)
    for row in merged.collect():  # as large as the filter, at most
        table[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return part_rows.sparkSession.sparkContext.broadcast(table)


def may_repeat(table: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each code may occur more than once; false is certain."""
    slots = _slots(codes, bits)
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def id_codes(ids: pa.Array) -> np.ndarray:
    """A code of each id."""
    if pa.types.is_integer(ids.type):
        return mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return np.array([xxhash.xxh3_64_intdigest(repr(v)) for v in ids.to_pylist()], np.uint64)


def ids_filter(ids: DataFrame, key: str = "doc_id") -> tuple[Broadcast, int]:
    """(a filter that lets the written ``ids`` through and few others, its bits)."""
    bits = bits_for(ids.count())

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield id_codes(b.column(0))

    return repeat_filter(ids.select(key).mapInArrow(lambda it: parts(seen(it), bits, 2), PARTS), bits), bits


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Broadcast]:
    """Rows whose ``key`` (not null) is among the ``ids``, and few others that the filter lets through: rows that surely
    aren't asked for need not shuffle. Also the filter, for who wants to destroy it."""
    asked, bits = ids_filter(ids, key)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_repeat(asked.value, id_codes(b.column(key)), bits)))

    return rows.mapInArrow(pick, rows.schema), asked


def without_ids(rows: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """The written rows whose ``key`` (not null) isn't among the ``ids``: those that surely aren't need not shuffle."""
    asked, bits = ids_filter(ids, key)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("_maybe", pa.array(may_repeat(asked.value, id_codes(b.column(key)), bits)))

    marked = rows.mapInArrow(mark, StructType([*rows.schema.fields, StructField("_maybe", BooleanType())]))
    left = marked.filter("NOT _maybe").unionByName(marked.filter("_maybe").join(ids.select(key), key, "left_anti"))
    return written(left.drop("_maybe"), name, asked)
