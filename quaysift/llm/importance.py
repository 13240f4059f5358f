"""Importance resampling towards a target: documents are drawn by how much likelier the target's word runs make them.

Words and pairs of words are hashed into buckets. Two bags of buckets, of the corpus and of the target, give each bucket
a gain (the logarithm of the ratio of its smoothed shares), and a document's weight is the mean gain of its features. Adding
Gumbel noise that depends on the id alone and taking the highest sums draws without replacement in proportion to the weights.

A task works on whole batches: their texts are joined with a separator, one regular expression finds all words,
a search among the documents' offsets tells whose each word is, pairs across two documents are masked, and counts are made by
``bincount``. Counts cover all rows: each task gives one sum a bucket, and these are added by a shuffle of ``buckets`` keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, written

#: Words of a text in UTF-8, once A-Z are lower-cased: runs of digits, letters a-z and bytes beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: What stands between two texts: no part of a word.
BETWEEN = b"\n"
#: Bytes of texts that are joined, and words that are held at once. A longer text is joined alone, and cut after each so many words.
PIECE, AT_ONCE = 1 << 20, 1 << 18


def _joined(texts: list[bytes | None]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first row, lower-cased texts joined, where each begins) of pieces of bounded size; null counts as empty."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or b"") <= PIECE):
            size += len(texts[b] or b"")
            b += 1
        part = [t or b"" for t in texts[a:b]]
        starts = np.cumsum([0, *(len(t) + len(BETWEEN) for t in part[:-1])])
        yield a, BETWEEN.join(part).lower(), starts
        a = b


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, checksum, how many of them are words) of the words and then the pairs of words, some at a time."""
    for first, data, starts in _joined(texts):
        found = WORD.finditer(data)
        last_row, last = -1, 0  # row and checksum, with a space, of the word before
        while some := list(islice(found, AT_ONCE)):
            words = [m[0] for m in some]
            row = np.searchsorted(starts, np.fromiter((m.start() for m in some), np.int64, len(some)), "right") - 1
            one = [crc32(w) for w in words]
            before = [last, *(crc32(b" ", c) for c in one)]
            two = np.fromiter(map(crc32, words, before), np.uint32, len(words))
            inside = np.concatenate([[last_row], row[:-1]]) == row  # pairs of one document
            last_row, last = row[-1], before[-1]
            yield first + np.concatenate([row, row[inside]]), np.concatenate([np.array(one, np.uint32), two[inside]]), len(row)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def bucket_counts(rows: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features of all rows by bucket: one row a bucket and task is shuffled, and ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, code, _ in features(_bytes(b.column(0))):
                total += np.bincount(code % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = bounded(rows).select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the ratio of smoothed shares, target over corpus, by bucket; whole numbers, floors."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_features, weight``, the floored mean gain of a text's features (none: 0)."""
    picked = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key, held = picked.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for b in batches:
            n_words, n, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for row, code, k in features(_bytes(b.column(1))):
                n_words += np.bincount(row[:k], minlength=b.num_rows)
                n += np.bincount(row, minlength=b.num_rows)
                total += np.bincount(row, weights=gain[code % len(gain)], minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    found = written(picked.mapInArrow(weigh, f"doc_id {key}, n_words long, n_features long, weight long"), "weights", held)
    return found


def numbered(rows: DataFrame, *order: F.Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in a total order: sorted by ranges, so that no task holds them all.

    Rows are numbered within each range first; the sizes of ranges before it, one number a partition, are added from a broadcast.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in local.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return local.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_features, weight, score, rank``.

    Of the N rows with ``least_words`` words or more, the ``N * percent / 100`` (floored) of the highest scores are drawn, and ``rank``
    numbers them from 1; ties go to the smaller id, and a null id comes last. All other rows have no rank. Null and empty texts have no
    feature and weigh 0. Rows that repeat an id have the same noise (that of a null id is of the empty text) and are drawn one by one.
    Bytes that aren't UTF-8 count as parts of words. ``target(text)`` may be empty; further columns of either are not read.
    """
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, text_col))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296
    scored = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share))))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents of 20 words or more, drawn towards the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_TEXT = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Each distinct feature's checksum is made byte by byte, from the table of the reflected polynomial 0xEDB88320.
OP12_SQL = f"""
WITH t256 AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)),
d AS (SELECT doc_id, coalesce({_TEXT.format("text")}, []) AS w FROM documents),
b AS (SELECT coalesce({_TEXT.format("text")}, []) AS w FROM benchmark),
runs AS (
  SELECT doc_id, 0 AS src, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d
  UNION ALL
  SELECT NULL, 1, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
feats AS (SELECT doc_id, src, f, count(*) AS n FROM runs GROUP BY ALL),
codes AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM feats), t256),
sums AS (SELECT bucket, sum(n) FILTER (src = 0) AS s, sum(n) FILTER (src = 1) AS t FROM feats JOIN codes USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g
  FROM sums, total),
each AS (SELECT doc_id, sum(n * g) AS g, sum(n) AS n FROM feats JOIN codes USING (f) JOIN gain USING (bucket) WHERE src = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n::DOUBLE), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN each USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, rank FROM scored
LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) * 25 // 100 FROM ranked)) USING (doc_id)
"""
