"""Exact deduplication: a two-pass Bloom filter finds digests that may repeat, and only those rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import PARTS, bits_for, may_repeat, parts, repeat_filter
from .shared import attach, bounded, written

WHITE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each run of ASCII white space became one space; null
    counts as empty, and empty texts equal each other. Of equal texts the smallest id stays; an id that is
    null comes after all others, and rows that repeat both id and text count one by one and share a fate.
    Only ``id_col`` and ``text_col`` are read, so further columns of any name do no harm.

    The first pass builds the filter over the digests (see ``repeats``), the second lets each row whose
    digest certainly occurs once pass straight through, and the others meet by digest: partial
    aggregation first, then ``attach``, which keeps a group of any size out of a single task.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    digests = written(bounded(docs).select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    total = digests.count()
    bits = bits or bits_for(total)

    def codes(column: pa.Array) -> np.ndarray:
        data = np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), ">u8")
        return data.astype(np.uint64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parts((codes(b.column(0)) for b in batches if b.num_rows), bits)

    again = repeat_filter(digests.select("digest").mapInArrow(first, PARTS), bits)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("maybe", pa.array(may_repeat(again.value, codes(b.column("digest")), bits)))

    key = digests.schema["doc_id"].dataType.simpleString()
    tested = written(digests.mapInArrow(second, f"doc_id {key}, digest binary, maybe boolean"), "tested", again)
    passed = tested.filter(~F.col("maybe")).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = tested.filter("maybe").select("doc_id", "digest")
    groups = written(maybe.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = attach(maybe, groups, "digest", "group_size", total)
    return passed.unionByName(met).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
