"""Exact token counts on the map side: a broadcast table of frequent pre-tokens, worker caches for the rest."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded

#: Entries of the broadcast table: 9 bytes each, so some 0.6 MB.
FREQUENT = 1 << 16
#: Pre-tokens that a task reports as frequent among its own texts.
REPORTED = 1 << 13
#: Entries of a worker's cache of missed pre-tokens before it starts anew (some 20 MB).
CACHED = 1 << 17
#: Bytes of text that are cut at once; a longer text is a piece of its own.
PIECE = 1 << 20
TOKENIZERS = "/opt/tokenizers"
_loaded: dict = {}


def tokenizer_path(name: str, folder: str = TOKENIZERS) -> str:
    """The place of a public tokenizer's file, as the folder's own index gives it."""
    if importlib.util.find_spec("public_tokenizers") is not None:
        import public_tokenizers as index
    else:
        spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
        index = importlib.util.module_from_spec(spec)
        sys.modules["public_tokenizers"] = index
        spec.loader.exec_module(index)
    return index.path(name)


def _lengths(path: str, units: list[str]) -> np.ndarray:
    """Tokens of each unit as the library counts them."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, and its worker is a fork
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        _loaded[path] = tok
    tok = _loaded[path]
    out = np.zeros(len(units), np.int64)
    for a in range(0, len(units), 20_000):
        got = tok.encode_batch_fast(units[a : a + 20_000], add_special_tokens=False)
        out[a : a + len(got)] = [len(x) for x in got]
    return out


def _hash(units: pa.Array) -> np.ndarray:
    from .codes import mix, spans, sums

    units = units.cast(pa.large_binary())
    at = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2], np.uint8)[at[0] : at[-1]] if len(units) and units.buffers()[2] else np.zeros(0, np.uint8)
    at = at - at[0]
    return mix(spans(sums(data), at[:-1], at[1:]))


#: ASCII characters next to which a single space surely ends one pre-token and begins the next.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


def _blank(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where white space and controls beyond ASCII begin, and where they end; some format characters beside them count too."""
    two, three = (np.zeros(len(data), bool) for _ in range(2))
    at = np.flatnonzero(data[:-1] == 0xC2)  # next line, no-break space
    two[at[data[at + 1] <= 0xA0]] = True
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    lead, b, c = data[at], data[at + 1], data[at + 2]
    ogham = (lead == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    general = (lead == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF))) | ((b == 0x81) & (c >= 0x9F) & (c <= 0xAF)))
    three[at[ogham | general | ((lead == 0xE3) & (b == 0x80) & (c == 0x80))]] = True
    ends = np.zeros(len(data), bool)
    ends[1:] |= two[:-1]
    ends[2:] |= three[:-2]
    return two | three, ends


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cut texts where a single space stands between two characters of any script that are neither white space nor controls.

    Byte-level pre-tokenisation takes such a space into the pre-token that follows it, and none crosses it,
    so the counts of the units add up to the text's. Returns the distinct units, the unit number of each
    piece and its row. Where no cut is sure (other white space, scripts without spaces), the text stays in one unit.
    """
    texts = texts.cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, at = data[at[0] : at[-1]], at - at[0]
    before = after = _PLAIN[data]
    if len(data) and data.max() > 127:
        begins, ends = _blank(data)
        before, after = before | (data > 127) & ~ends, after | (data > 127) & ~begins
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-2] = (data[1:-1] == 32) & before[:-2] & after[2:] if len(data) > 2 else False
    inside = np.zeros(len(data) + 1, bool)
    inside[at] = True  # a text's own ends are cuts too; a space beside them stands next to another text
    edge = at[(at > 0) & (at < len(data))]
    cut[edge] = cut[edge - 1] = False
    starts = np.flatnonzero(cut | inside)
    starts = starts[starts < len(data)]
    offsets = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    coded = pieces.dictionary_encode()
    row = np.searchsorted(at, starts, "right") - 1
    return coded.dictionary, coded.indices.to_numpy(), row


def _cuts(column: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + PIECE, "right")))
        yield column.slice(a, b - a).fill_null("")
        a = b


def frequent_lengths(docs: DataFrame, text_col: str, path: str) -> Broadcast:
    """Broadcast (sorted hashes, lengths) of at most ``FREQUENT`` pre-token units, from all texts.

    Each task reports its ``REPORTED`` most frequent units, so a bounded list a task is shuffled, never
    the pre-tokens. The table only saves work: what it lacks, workers encode themselves.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for b in batches:
            for texts in _cuts(b.column(0)):
                units, number, _ = _units(texts)
                times = np.bincount(number, minlength=len(units))
                often = np.flatnonzero(times > 2)
                for u, n in zip(units.take(pa.array(often)).to_pylist(), times[often].tolist(), strict=True):
                    if len(u) <= 64:
                        counts[u] = counts.get(u, 0) + n
            if len(counts) > 16 * REPORTED:
                counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 4 * REPORTED])
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:REPORTED]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["unit", "n"])

    top = docs.select(F.col(text_col).alias("t")).mapInArrow(report, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(FREQUENT)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_hash(b.column(0)).view(np.int64)), pa.array(_lengths(path, b.column(0).to_pylist()))], ["h", "n"])

    rows = top.select("unit").mapInArrow(encode, "h long, n long").toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    lengths = rows["n"].to_numpy(np.int64)
    keep = order[lengths[order] < 256]
    return docs.sparkSession.sparkContext.broadcast((hashes[keep], lengths[keep].astype(np.uint8)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``. No shuffle of rows or pre-tokens.

    Counts equal those of the tokenizer's library for the whole text, with no begin, end or padding tokens
    and with special strings inside texts taken as the library takes them by default. Null counts as empty
    (0 tokens), and bytes that aren't UTF-8 as U+FFFD. ``tokenizer`` is the path of a byte-level BPE file. Ids may be null or repeat; columns but
    ``id_col`` and ``text_col`` are not read.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    known = frequent_lengths(bounded(docs).select(F.make_valid_utf8(F.col(text_col)).alias("text")), "text", path)
    picked = bounded(docs).select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    key = picked.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lengths = known.value
        cache: dict[str, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            n_tokens = []
            for texts in _cuts(b.column("text")):
                units, number, row = _units(texts)
                h = _hash(units)
                at = np.searchsorted(hashes, h)
                hit = hashes[np.minimum(at, len(hashes) - 1)] == h if len(hashes) else np.zeros(len(h), bool)
                each = np.zeros(len(units), np.int64)
                each[hit] = lengths[at[hit]]
                missed = np.flatnonzero(~hit)
                asked = units.take(pa.array(missed)).to_pylist()
                new = [u for u in asked if u not in cache]
                fresh = dict(zip(new, _lengths(path, new).tolist(), strict=True))
                each[missed] = [fresh[u] if u in fresh else cache[u] for u in asked]
                if len(cache) + len(fresh) > CACHED:
                    cache.clear()
                cache.update((u, n) for u, n in fresh.items() if len(u) <= 64)
                n_tokens.append(np.bincount(row, weights=each[number], minlength=len(texts)).astype(np.int64))
            tokens = np.concatenate(n_tokens)
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(count, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the limit of 512 tokens."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
