"""Removal of repeated runs of words by suffix automata of reference shards.

The reference is the corpus itself, which no executor can hold, so a shard is what earlier texts have around
one content-chosen anchor (``anchors``), and the shard goes to the task that holds the anchor's texts
instead of to all. There, texts stream through the automaton of those before them: their matching
statistics give the maximal spans that reach the length threshold; then they extend the automaton. Items are
words together with their distance from the anchor, so that a match is at the same place of both.
Copies whose whole surroundings are equal (by a 128-bit key) are covered before, without an automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import by_text, covered, joined_spans
from .codes import runs, words

#: Words of an anchor.
ANCHOR = 4
#: Bytes of a word's code in the texts around an anchor.
CODE = 5


class Automaton:
    """A generalised suffix automaton, built item by item."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, items: list) -> None:
        last = 0
        for x in items:
            last = self._step(last, x)

    def _step(self, last: int, x) -> int:
        go, link, length = self.go, self.link, self.length
        if (q := go[last].get(x)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, x, q)
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and x not in go[p]:
            go[p][x] = new
            p = link[p]
        if p != -1:
            q = go[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, x, q)
        return new

    def _split(self, p: int, x, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        clone = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and go[p].get(x) == q:
            go[p][x] = clone
            p = link[p]
        return clone

    def statistics(self, items: list) -> list[int]:
        """For each item the length of the longest run that ends there and occurs in what was added."""
        go, link, length = self.go, self.link, self.length
        out, at, n = [], 0, 0
        for x in items:
            while at and x not in go[at]:
                at = link[at]
                n = length[at]
            if x in go[at]:
                at = go[at][x]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    Words stand between ASCII white space. A word is removed when a window of ``size`` consecutive words of
    one text covers it that also starts earlier: in a row of a smaller id, or before in the same text.
    Windows are judged on the input. ``kept`` has the kept words joined by one space (bytes that aren't UTF-8 as U+FFFD). Null has no words. Rows
    of a null id lose nothing and repeat nothing; rows that repeat an id share the spans found for it.
    Further columns are not read.
    """
    left = size - ANCHOR
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def coder(data: np.ndarray, offsets: np.ndarray):
        _, _, codes, bounds = words(data, offsets, lower=False)

        def context(places: np.ndarray, a: np.ndarray, c: np.ndarray, left: int, right: int) -> np.ndarray:
            step = np.arange(-left, right)
            out = codes[np.clip(places[:, None] + step, 0, max(len(codes) - 1, 0))]
            out[(step < -a[:, None]) | (step >= c[:, None])] = 0
            return np.ascontiguousarray(out.view(np.uint8).reshape(len(places), left + right, 8)[:, :, :CODE]).reshape(len(places), (left + right) * CODE)

        return bounds, runs(codes, ANCHOR), context

    def solve(classes: list[tuple[bytes, int, int]]) -> list[tuple[int, int] | None]:
        shard, out = Automaton(), []
        for n, (around, a, c) in enumerate(classes):
            items = [(j, around[j * CODE : (j + 1) * CODE]) for j in range(left - a, left + c)]
            reach = None
            if n:
                ends = [(i, m) for i, m in enumerate(shard.statistics(items)) if m >= size]
                if ends:
                    lo, hi = min(i - m + 1 for i, m in ends), ends[-1][0] + 1
                    reach = (a - lo, hi - a)
            if n + 1 < len(classes):
                shard.add(items)
            out.append(reach)
        return out

    spans = by_text(covered(docs, coder, solve, ANCHOR, size, CODE))
    rows = docs.withColumn("text", F.col("text").cast("binary")).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    key = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            every = b.column("spans").to_pylist()
            for text, found in zip(b.column("text"), every, strict=True):
                items = (text.as_py() or b"").split()
                kept, at = [], 0
                for lo, hi in joined_spans(found):
                    kept += items[at:lo]
                    at = max(at, min(hi, len(items)))
                kept += items[at:]
                rest = b" ".join(kept)
                out.append((len(items), len(items) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode(errors="replace")))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:2]), *(pa.array(x, pa.string()) for x in cols[2:])], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, f"doc_id {key}, n_words long, n_removed long, kept_sha256 string, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the words that are left."""
    return remove_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
