"""Content as chunk rows: splitting, sealing, checking and reassembly; digests and message codes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups
from .walkers import OneFile, by_file, in_file_order


def split_chunks(files: DataFrame, content: str = "content", size: int = lookups.CHUNK) -> DataFrame:
    """``file_id, chunk_idx, chunk``: binary content in pieces of ``size`` bytes; empty content is one empty chunk, null counts as empty."""
    c = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length(c) / size), F.lit(1)).cast("int")
    # the array of pieces is made first, so that exploded rows don't each carry the whole content
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    return files.select("file_id", F.posexplode(pieces).alias("chunk_idx", "chunk"))


def _iv(base: str, idx: str):
    """12 bytes: 8 of the file's base and the chunk's number, so no pair of key and vector is used twice."""
    return F.concat(F.substring(F.col(base), 1, 8), F.unhex(F.lpad(F.hex(idx), 8, "0")))


def _aad(idx: str):
    return F.unhex(F.lpad(F.hex(idx), 8, "0")).cast("string")


def seal_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """``file_id, chunk_idx, sealed``: AES-256-GCM of each chunk under ``keys(file_id, key, base)``, bound to its number."""
    x = chunks.join(keys, "file_id")
    sealed = F.aes_encrypt(F.col("chunk"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), _iv("base", "chunk_idx"), _aad("chunk_idx"))
    return x.select("file_id", "chunk_idx", sealed.alias("sealed"))


def unseal_chunks(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """``file_id, chunk_idx, chunk``; ``chunk`` is null where the key, the number or a byte is wrong."""
    x = sealed.join(keys.select("file_id", "key"), "file_id")
    chunk = F.try_aes_decrypt(F.col("sealed"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), _aad("chunk_idx"))
    return x.select("file_id", "chunk_idx", chunk.alias("chunk"))


def chunk_digests(chunks: DataFrame, in_order: bool = False) -> DataFrame:
    """``file_id, n_chunks, size, sha256, frame_sha256, whole`` of files in chunk rows, in memory that doesn't grow with a file.

    A file's chunks come to one task in order, and a running SHA-256 takes them one by one, across the batches they arrive in. ``frame_sha256``
    is over each chunk's length (4 bytes, big endian) and bytes. ``whole`` says that the numbers are 0, 1, 2, .. without a gap or a
    repeat and that no chunk is null; digests of a file that isn't are null. Rows that stand file by file ``in_order`` in their partitions already, as
    ``chunks.read_chunks`` gives ``whole`` files, are taken as they are, without a shuffle.
    """

    def digest(file: OneFile) -> Iterator[tuple]:
        plain, framed, size, n, whole = hashlib.sha256(), hashlib.sha256(), 0, 0, True
        for at, chunk in file.numbered():
            whole &= at == n and chunk is not None
            n += 1
            if whole:
                size += len(chunk)
                plain.update(chunk)
                framed.update(struct.pack(">I", len(chunk)))
                framed.update(chunk)
        yield n, size if whole else None, plain.hexdigest() if whole else None, framed.hexdigest() if whole else None, whole

    rows = chunks.select("file_id", "chunk_idx", F.col("chunk").cast("binary").alias("chunk"))
    return by_file(rows if in_order else in_file_order(rows, "file_id"), digest, "n_chunks long, size long, sha256 string, frame_sha256 string, whole boolean")


def verify_chunks(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """``file_id, sha256, reason`` of each row of ``declared(file_id, chunks, sha256)``: the digest if chunks are as many as it says, without gaps, none failed, and the digest fits."""
    found = chunk_digests(chunks).select("file_id", "n_chunks", "whole", F.col("sha256").alias("_found"))
    x = declared.join(found, "file_id", "left")
    ok = F.coalesce(F.col("whole") & (F.col("n_chunks") == F.col("chunks")) & (F.col("_found") == F.col("sha256")), F.lit(False))
    return x.select("file_id", F.when(ok, F.col("_found")).alias("sha256"), F.when(~ok, "decryption_failed").alias("reason"))


def verified_chunks(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """The chunk rows of the files that verify, as they came: content of any size, without a row that holds a file."""
    return chunks.join(verify_chunks(chunks, declared).filter("reason IS NULL").select("file_id"), "file_id", "left_semi")


def reassemble(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """``file_id, content, reason``: the content of verified files in one row each, for files that fit one (see ``verified_chunks`` for others)."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_idx", F.col("chunk").cast("binary").alias("x"))))
    one = F.encode(F.array_join(F.transform(rows, lambda r: F.decode(r["x"], "ISO-8859-1")), ""), "ISO-8859-1")
    verdict = verify_chunks(chunks, declared).select("file_id", "reason")
    content = chunks.join(verdict.filter("reason IS NULL").select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(one.alias("content"))
    return verdict.join(content, "file_id", "left").select("file_id", "content", "reason")


def frame_digest(chunks: DataFrame) -> DataFrame:
    """``file_id, digest``: SHA-256 over each chunk's length (4 bytes, big endian) and bytes, in order; null where chunks are missing, repeated or null."""
    return chunk_digests(chunks).select("file_id", F.col("frame_sha256").alias("digest"))
