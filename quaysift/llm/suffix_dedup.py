"""Removal of repeated byte strings, found as maximal repeats of enhanced suffix arrays.

Spark deals the suffixes out by a content-chosen anchor that they begin with (``anchors``), so that all
occurrences of a long string meet. Within an anchor the suffixes are sorted, and a stack scan over the common
prefixes of neighbours yields the intervals of suffixes that share r bytes. The same scan over what stands to
the left of an interval's members, read backwards, splits it where left extensions differ. Each such node is
a maximal repeat of ``left + r`` bytes. Occurrences whose whole surroundings are equal (by a 128-bit key) are merged before and count as the first of them,
and an anchor with more than ``anchors.CLASSES`` different surroundings has its windows hashed and counted instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import by_text, covered, joined_spans
from .codes import grams, sums

#: Bytes of an anchor. Longer anchors are more of the places and less often shared by chance.
ANCHOR = 32


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(texts: list[bytes], least: int) -> Iterator[tuple[int, list[int]]]:
    """(length, members) of every prefix that two or more texts share and that is as long as it can be for them.

    A stack scan over the sorted texts and the common prefixes of neighbours; members are numbers of texts.
    """
    order = sorted(range(len(texts)), key=texts.__getitem__)
    stack: list[tuple[int, int]] = []  # (length, first rank)
    for i in range(1, len(order) + 1):
        now = common(texts[order[i - 1]], texts[order[i]]) if i < len(order) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if length >= least:
                yield length, order[first:i]
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(classes: list[tuple[bytes, int, int]], left: int, size: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of the repeats of ``size`` bytes or more around an anchor."""
    ahead = [x[left : left + c] for x, _, c in classes]
    behind = [x[left - a : left][::-1] for x, a, _ in classes]
    for r, members in intervals(ahead, max(1, size - left)):
        if len(members) == 2:
            ell = common(behind[members[0]], behind[members[1]])
            if ell + r >= size:
                yield ell, r, members
            continue
        for ell, some in intervals([behind[i] for i in members], max(0, size - r)):
            yield ell, r, [members[i] for i in some]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    A text's UTF-8 bytes are removed where they are covered by a string of ``size`` bytes that also starts
    earlier: in a row of a smaller id, or before in the same text. Strings are judged on the input. ``n_spans``
    counts maximal removed runs and ``kept`` holds the remaining bytes. Null counts as empty. Rows of a null
    id lose nothing and repeat nothing; rows that repeat an id share the spans found for it. Further columns
    are not read.
    """
    left = size - ANCHOR
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def coder(data: np.ndarray, offsets: np.ndarray):
        def context(places: np.ndarray, a: np.ndarray, c: np.ndarray, left: int, right: int) -> np.ndarray:
            step = np.arange(-left, right)
            at = places[:, None] + step
            out = data[np.clip(at, 0, max(len(data) - 1, 0))]
            out[(step < -a[:, None]) | (step >= c[:, None])] = 0
            return out

        return offsets, grams(sums(data), ANCHOR), context

    def solve(classes: list[tuple[bytes, int, int]]) -> list[tuple[int, int] | None]:
        reach: list[tuple[int, int] | None] = [None] * len(classes)
        for ell, r, members in maximal_repeats(classes, left, size):
            first = min(members)
            for i in members:
                if i != first:
                    x = reach[i]
                    reach[i] = (ell, r) if x is None else (max(x[0], ell), max(x[1], r))
        return reach

    spans = by_text(covered(docs, coder, solve, ANCHOR, size, 1))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(spans, "doc_id", "left")
    key = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, pieces in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                text = text.as_py() or b""
                gone = [(a, min(e, len(text))) for a, e in joined_spans(pieces) if a < len(text)]
                kept, at = [], 0
                for a, e in gone:
                    kept.append(text[at:a])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that are left."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
