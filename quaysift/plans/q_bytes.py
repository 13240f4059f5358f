"""Queries that put documents into archives and images, walk the bytes, and replay logs through sources, sinks and state."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive as V
from ..operators import audit as U
from ..operators import image as G
from ..operators import integrity as I
from ..operators import walkers as X
from ..sources import chunks as K
from ..sources import files as Q
from ..streaming import streams as S
from .base import SQL, query
from .q_content import HMAC, KEY
from .q_log import AUDIT, CANON, REPLAY, ZEROS, load_requests, log
from .q_stream import drained, folder
from .views import duck, duck_values, table


def wrapped(spark: SparkSession, sf_dir: str, wrap: Callable[[int, bytes], bytes]) -> DataFrame:
    """``file_id, content``: each document's text inside the bytes that ``wrap`` makes, which go out by ``X.BATCH_BYTES``."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                out.append(wrap(i, (t.as_py() or "").encode()))
                held += len(out[-1])
                if held >= X.BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["file_id", "content"])
                    ids, out, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["file_id", "content"])

    return X.small_batches(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(job, "file_id long, content binary")


def _zip(i: int, body: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"d/{i}.txt", body)
        z.writestr("empty", b"")
    return out.getvalue()


def _tar(i: int, body: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in ((f"d/{i}.txt", body), ("empty", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _png(i: int, body: bytes) -> bytes:
    out = b"\x89PNG\r\n\x1a\n"
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", i + 1, 2, 8, 2, 0, 0, 0)), (b"IDAT", body), (b"IEND", b"")):
        out += struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return out


def _jpeg(i: int, body: bytes) -> bytes:
    notes = b"".join(b"\xff\xfe" + struct.pack(">H", len(n) + 2) + n for n in (body[at : at + 65_533] for at in range(0, max(len(body), 1), 65_533)))
    return b"\xff\xd8\xff\xd0\xff\xff\xd8" + notes + b"\xff\xc2" + struct.pack(">HBHHB", 8, 8, len(body) % 60_000, i % 60_000, 1)


@query("arc_1_zip_entries", "SELECT doc_id AS file_id, i::INT AS entry_idx, CASE i WHEN 0 THEN 'd/' || doc_id || '.txt' ELSE 'empty' END AS path, CASE i WHEN 0 THEN strlen(text) ELSE 0 END::BIGINT AS uncomp_size, CASE i WHEN 0 THEN strlen(text) ELSE 0 END::BIGINT AS actual_size, 'ok' AS status FROM documents, range(2) r(i)")
def arc_1(spark, sf_dir):
    """Each document in a zip of two entries."""
    return X.zip_entries(wrapped(spark, sf_dir, _zip)).select("file_id", "entry_idx", "path", "uncomp_size", "actual_size", "status")


@query("arc_2_tar_entries", "SELECT doc_id AS file_id, i::INT AS entry_idx, CASE i WHEN 0 THEN 'd/' || doc_id || '.txt' ELSE 'empty' END AS path, CASE i WHEN 0 THEN strlen(text) ELSE 0 END::BIGINT AS uncomp_size, true AS checksum_ok, false AS helper FROM documents, range(2) r(i)")
def arc_2(spark, sf_dir):
    """Each document in a tar of two entries."""
    return X.tar_entries(wrapped(spark, sf_dir, _tar)).select("file_id", "entry_idx", "path", "uncomp_size", "checksum_ok", "helper")


@query("arc_13_tar_chunks", SQL["arc_2_tar_entries"])
def arc_13(spark, sf_dir):
    """The same tars in chunk rows of 700 bytes, which cut headers, walked without a row that holds an archive."""
    chunks = I.split_chunks(wrapped(spark, sf_dir, _tar), size=700)
    return X.walk_chunks(chunks, "tar").select("file_id", "entry_idx", "path", "uncomp_size", "checksum_ok", "helper")


@query("img_3_jpeg_dimensions", """SELECT doc_id AS file_id, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 60000 END::INT AS width, CASE WHEN doc_id % 7 <> 0 THEN strlen(coalesce(text, '')) % 60000 END::INT AS height
FROM documents""")
def img_3(spark, sf_dir):
    """Each document, whole, as comments of up to 65,533 bytes before a frame header that tells its number and its length, both modulo 60,000.

    Markers that stand alone come before; every seventh file is cut within its frame header.
    """
    return X.jpeg_dimensions(wrapped(spark, sf_dir, lambda i, body: _jpeg(i, body)[: None if i % 7 else -3]))


@query("img_4_image_chunks", """SELECT doc_id AS file_id, i::INT AS chunk_idx, CASE i WHEN 0 THEN 'IHDR' WHEN 1 THEN 'IDAT' ELSE 'IEND' END AS chunk_type, CASE i WHEN 0 THEN 13 WHEN 1 THEN strlen(text) ELSE 0 END::BIGINT AS length,
  CASE i WHEN 0 THEN 33 WHEN 1 THEN 45 + strlen(text) ELSE 57 + strlen(text) END::BIGINT AS "end" FROM documents, range(3) r(i)""")
def img_4(spark, sf_dir):
    """Each document as the data of a PNG."""
    return X.image_chunks(wrapped(spark, sf_dir, _png), "png").select("file_id", "chunk_idx", "chunk_type", "length", "end")


@query("img_11_png_in_chunks", SQL["img_4_image_chunks"])
def img_11(spark, sf_dir):
    """The same pictures in chunk rows of 50 bytes."""
    chunks = I.split_chunks(wrapped(spark, sf_dir, _png), size=50)
    return X.walk_chunks(chunks, "png").select("file_id", "chunk_idx", "chunk_type", "length", "end")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _webp(i: int, body: bytes) -> bytes:
    """A still picture, or with an odd number an animation of two frames."""
    frames = _chunk(b"ANIM", b"\0" * 6) + _chunk(b"ANMF", body) + _chunk(b"ANMF", b"x") if i % 2 else _chunk(b"VP8 ", body)
    return b"RIFF" + struct.pack("<I", 4 + len(frames)) + b"WEBP" + frames


def _gif(i: int, body: bytes) -> bytes:
    """As many pictures as the number's remainder by three, and the body in blocks of 255 bytes of a comment."""
    blocks = b"".join(bytes([len(n)]) + n for n in (body[at : at + 255] for at in range(0, len(body), 255))) + b"\0"
    return b"GIF89a" + b"\x01\0\x01\0\0\0\0" + b"!\xfe" + blocks + (b",\0\0\0\0\x01\0\x01\0\0" + b"\x02\x01L\0") * (i % 3) + b";"


@query("img_8_webp_chunks", """SELECT doc_id AS file_id, i::INT AS chunk_idx, CASE WHEN i = 0 THEN 'RIFF' WHEN doc_id % 2 = 0 THEN 'VP8 ' WHEN i = 1 THEN 'ANIM' ELSE 'ANMF' END AS chunk_type,
  CASE WHEN i = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 36 END + n + n % 2 WHEN i = 3 THEN 1 WHEN i = 1 AND doc_id % 2 = 1 THEN 6 ELSE n END::BIGINT AS length
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents), range(4) r(i) WHERE doc_id % 2 = 1 OR i < 2""")
def img_8(spark, sf_dir):
    """Each document as the data of a WebP, of every other one as that of its first frame."""
    return X.image_chunks(wrapped(spark, sf_dir, _webp), "webp").select("file_id", "chunk_idx", "chunk_type", "length")


@query("img_9_gif_blocks", """SELECT doc_id AS file_id, 1 + (doc_id % 3) + 1 AS blocks, (doc_id % 3) AS pictures, 13 + 2 + n + CAST(ceil(n / 255.0) AS BIGINT) + 1 + (doc_id % 3) * 14 + 1 AS bytes
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)""")
def img_9(spark, sf_dir):
    """Each document as a comment of a GIF with up to two pictures."""
    rows = X.image_chunks(wrapped(spark, sf_dir, _gif), "gif")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("chunk_type") == "image").alias("pictures"), F.max("end").alias("bytes"))


def _picture(i: int, body: bytes) -> bytes:
    """A picture of the kind that ``PICTURES`` lists at the number's place, with the body in it."""
    kind = i % len(PICTURES)
    if kind < 3 or kind == 9:
        moving = ((b"acTL", struct.pack(">II", 2, 0)),) if kind in (1, 2) else ()
        head = struct.pack(">IIBBBBB", 20_000 if kind == 9 else 5, 5, 8, 2, 0, 0, 0)
        out = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", head), *moving, (b"IDAT", body), (b"IEND", b"")))
        return out + (b"behind" if kind == 2 else b"")
    if kind < 5:
        return _gif(2, body) + (b"behind;" if kind == 4 else b"")
    if kind < 7:
        frames = _chunk(b"ANIM", b"\0" * 6) + _chunk(b"ANMF", body) + (b"JUNK" if kind == 6 else b"")
        return b"RIFF" + struct.pack("<I", 4 + len(frames)) + b"WEBP" + frames
    if kind < 9:
        return _jpeg(i % 9_000, body[:9_000])[: None if kind == 7 else -3]
    return b"BM" + bytes(16) + body


#: extension, media type, verdict and reason of each kind of picture
PICTURES = [
    ("x", "image/png", "sanitized", None), ("PNG", None, "clean", "png_animated_passthrough"), ("x", "image/png", "rejected", "png_trailing_data"), ("gif", None, "clean", "gif_animated_passthrough"), ("x", "image/gif", "rejected", "gif_trailing_data"),
    ("webp", None, "clean", "webp_animated_passthrough"), ("x", "image/webp", "rejected", "webp_trailing_data"), ("jpg", None, "sanitized", None), ("x", "image/jpeg", "rejected", "image_header_malformed"),
    ("png", None, "rejected", "image_dimensions_exceeded"), ("x", "image/bmp", "sanitized", None), ("tif", None, "error", "unsupported_image_format"), ("ttf", None, "clean", "opaque_image_passthrough"),
]


@query("img_10_image_verdict", f"""WITH {duck_values('k', ['place', 'ext', 'mime', 'verdict', 'reason'], [(i, *p) for i, p in enumerate(PICTURES)])}
SELECT doc_id AS file_id, verdict, reason, verdict = 'sanitized' AS reencode FROM documents JOIN k ON place = doc_id % {len(PICTURES)}""")
def img_10(spark, sf_dir):
    """Each document in a picture of one of thirteen kinds, judged from its bytes: junk behind the end and inside a RIFF size, cut and odd headers."""
    kinds = F.broadcast(spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(PICTURES)], "at int, ext string, mime string"))
    files = wrapped(spark, sf_dir, _picture).join(kinds, F.col("at") == F.col("file_id") % len(PICTURES))
    return G.image_verdict(files, F.col("ext").isin("ttf"))


def _hostile(i: int, body: bytes) -> bytes:
    """A zip or a tar with what its number says: something wrong, or nothing."""
    kind = i % 10
    if kind < 6:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr({1: "../up", 2: "in/x.Tar.GZ"}.get(kind, "d/a.txt"), body)
            z.writestr("last.txt", b"x")
        got = bytearray(out.getvalue())
        at, end = struct.unpack("<I", got[-6:-2])[0], len(got) - 22
        if kind == 3:  # another size than comes out
            got[at + 24 : at + 28] = struct.pack("<I", len(body) + 1)
        elif kind == 4:  # nowhere
            got[at + 42 : at + 46] = b"\xff" * 4
        elif kind == 5:  # a count below what is listed
            got[end + 10 : end + 12] = struct.pack("<H", 1)
        return bytes(got)
    got = bytearray(_tar(i, b"PK\x03\x04" + body if kind == 6 else body))
    if kind == 7:
        got[124:136] = b"\x80" + b"\xff" * 11
    elif kind == 8:
        got[0] ^= 1
    if kind == 7:
        total = sum(got[:148]) + 8 * 32 + sum(got[156:512])
        got[148:156] = b"%06o\0 " % total
    return bytes(got)


@query("arc_12_walked_verdict", """SELECT doc_id AS file_id, CASE WHEN doc_id % 10 IN (0, 5, 9) THEN 'clean' ELSE 'rejected' END AS verdict,
  CASE doc_id % 10 WHEN 1 THEN 'archive_policy:archive_path_traversal' WHEN 2 THEN 'archive_policy:archive_nested_archive' WHEN 3 THEN 'archive_policy:archive_size_mismatch'
    WHEN 4 THEN 'archive_policy:zip_local_header_invalid' WHEN 6 THEN 'archive_policy:archive_nested_archive' WHEN 7 THEN 'archive_policy:archive_expansion_exceeded'
    WHEN 8 THEN 'archive_policy:archive_malformed' END AS reason FROM documents""")
def arc_12(spark, sf_dir):
    """Each document in an archive, most of which have something wrong, judged from its bytes."""
    files = wrapped(spark, sf_dir, _hostile)
    zips = files.filter(F.col("file_id") % 10 < 6)
    return V.zip_verdict(zips).unionByName(V.tar_verdict(files.filter(F.col("file_id") % 10 >= 6)))


@query("src_1_read_files", "SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (strlen(text) > 20000) AS too_large FROM (SELECT coalesce(lang, 'none') AS lang, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY ALL) GROUP BY lang")
def src_1(spark, sf_dir):
    """A file a language, with its documents as lines, read whole unless it is too large."""
    path = languages(spark, sf_dir)
    got = Q.read_files(spark, path, max_bytes=20_000, glob="*.txt")
    return got.groupBy(_lang().alias("lang")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("reason").isNotNull() & F.col("content").isNull()).alias("too_large"))


LANGS = """WITH t AS (SELECT coalesce(lang, 'none') AS lang, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY ALL), h AS (SELECT lang, hex(encode(text)) AS hex, strlen(text) AS n FROM t)"""


def languages(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file a language, which holds its documents as lines."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    path = f"{folder(spark)}/files"
    Q.write_keyed(docs, path, "lang", "doc_id")
    return path


def _lang():
    return F.regexp_extract("path", "lang=([^/]*)", 1)


@query("src_5_read_chunks", f"{LANGS} SELECT lang, i AS chunk_idx, i * 1000 AS \"offset\", n AS file_length, sha256(unhex(substr(hex, i * 2000 + 1, 2000))) AS chunk_sha256 FROM h, LATERAL (SELECT unnest(range(0, CAST(ceil(n / 1000.0) AS BIGINT))) AS i)")
def src_5(spark, sf_dir):
    """The files in chunks of 1000 bytes, twenty a partition (more, if there are more than ``K.MOST_RANGES`` times as many): every file is read by many tasks."""
    rows = K.read_chunks(spark, languages(spark, sf_dir), chunk=1000, range_bytes=20_000, glob="*.txt")
    return rows.select(_lang().alias("lang"), "chunk_idx", "offset", "file_length", F.sha2("chunk", 256).alias("chunk_sha256"))


@query("int_8_file_digests", f"{LANGS} SELECT lang, n AS size, CAST(ceil(n / 1000.0) AS BIGINT) AS n_chunks, sha256(unhex(hex)) AS sha256 FROM h")
def int_8(spark, sf_dir):
    """The files' digests from chunk rows; as a digest is sequential, a file's rows are read in order where they are digested."""
    rows = K.read_chunks(spark, languages(spark, sf_dir), chunk=1000, range_bytes=20_000, glob="*.txt", whole=True)
    return I.chunk_digests(rows.select(_lang().alias("file_id"), "chunk_idx", "chunk"), in_order=True).select(F.col("file_id").alias("lang"), "size", "n_chunks", "sha256")


@query("src_3_read_type_registry", """SELECT 'x' || s AS ext, 'type' || (s % 3) AS type, 'text/x-' || s AS mime, CASE WHEN s % 2 = 0 THEN 'archive' ELSE '' END AS scan, s % 5 = 0 AS zip_based
FROM (SELECT DISTINCT doc_id % 97 AS s FROM documents)""")
def src_3(spark, sf_dir):
    """A registry that the documents' numbers give, written as one JSON object and read back."""
    s = F.col("s").cast("string")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("s")).distinct()
    scan = F.when(F.col("s") % 2 == 0, F.array(F.lit("archive")))
    value = F.struct(F.concat(F.lit("type"), (F.col("s") % 3).cast("string")).alias("type"), F.concat(F.lit("text/x-"), s).alias("mime"), scan.alias("scan"), F.when(F.col("s") % 5 == 0, F.lit(True)).alias("zipBased"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("x"), s).alias("ext"), value.alias("x"))))  # as many as extensions
    path = f"{folder(spark)}/registry"
    rows.agg(F.to_json(F.struct(entries.alias("extensions"))).alias("value")).write.text(path)
    return Q.read_type_registry(spark, path).withColumn("scan", F.array_join("scan", ","))


@query("src_2_read_requests", f"WITH r AS ({duck('v_requests')}) SELECT file_path, user_id, version, plaintext_size, false AS corrupt FROM r WHERE request_id % 5 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM r WHERE request_id % 5 = 0")
def src_2(spark, sf_dir):
    """Requests as JSON lines, every fifth of which is cut short."""
    r = table(spark, sf_dir, "v_requests")
    meta = F.struct("version", "chunk_size", "chunks", "plaintext_sha256", "plaintext_size")
    line = F.to_json(F.struct(F.lit("scan").alias("op"), "file_path", "user_id", "original_filename", meta.alias("encryption_meta")))
    path = f"{folder(spark)}/requests"
    r.select(F.when(F.col("request_id") % 5 == 0, F.concat(F.lit("{"), F.substring(line, 2, 9))).otherwise(line).alias("value")).write.text(path)
    got = Q.read_requests(spark, path)
    bad = F.col("_corrupt_record").isNotNull()
    own = lambda c: F.when(~bad, F.col(c))
    return got.select(own("file_path").alias("file_path"), own("user_id").alias("user_id"), own("encryption_meta.version").alias("version"), own("encryption_meta.plaintext_size").alias("plaintext_size"), bad.alias("corrupt"))


@query("snk_2_write_audit", f"{AUDIT} SELECT log_date, count(*) AS records, max(seq) AS last_seq, sum(duration_ms)::BIGINT AS total_ms FROM a GROUP BY log_date")
def snk_2(spark, sf_dir):
    """The audit log written a folder a day and read back."""
    path = f"{folder(spark)}/audit"
    Q.write_audit(U.audit_rows(log(spark, sf_dir)), path)
    back = spark.read.schema("log_date string, seq long, duration_ms long").json(path)
    return back.groupBy(F.col("log_date").cast("string").alias("log_date")).agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"), F.sum("duration_ms").alias("total_ms"))


@query("aud_6_log_tails", f"{AUDIT} SELECT log_date, max(seq) + 1 AS seq, sha256('' || max(seq)) AS sig FROM a GROUP BY log_date")
def aud_6(spark, sf_dir):
    """The tails of the audit log, written a folder a day, from the ends of its files."""
    path = f"{folder(spark)}/audit"
    Q.write_audit(U.audit_rows(log(spark, sf_dir)).withColumn("sig", F.sha2(F.col("seq").cast("string"), 256)), path)
    return U.log_tails(spark, path, tail=1000)


LIVE = f"""{AUDIT.replace('WITH s AS', 'WITH RECURSIVE s AS')}, b AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY log_date ORDER BY ts, plaintext_sha256) - 1 AS seq FROM a), chain AS (
  SELECT b.log_date, b.seq, {ZEROS} AS prev, {HMAC.format(m=CANON.format(a='b.', p=ZEROS))} AS sig FROM b WHERE seq = 0
  UNION ALL SELECT b.log_date, b.seq, c.sig, {HMAC.format(m=CANON.format(a='b.', p='c.sig'))} FROM chain c JOIN b ON b.log_date = c.log_date AND b.seq = c.seq + 1)"""


def _live(spark: SparkSession, rows: DataFrame, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``then`` makes of the rows as a stream, with the state store that it needs."""
    path, setting = f"{folder(spark)}/in", "spark.sql.streaming.stateStore.providerClass"
    rows.write.parquet(path)
    before = spark.conf.get(setting)
    spark.conf.set(setting, S.ROCKSDB)
    out = drained(spark, then(spark.readStream.schema(rows.schema).parquet(path)))
    spark.conf.set(setting, before)
    return out


@query("str_3_audit_stream", f"{LIVE} SELECT log_date, seq, prev, sig FROM chain")
def str_3(spark, sf_dir):
    return _live(spark, U.audit_rows(log(spark, sf_dir)).drop("seq"), lambda s: S.audit_stream(s, KEY)).select("log_date", "seq", "prev", "sig")


@query("str_4_budget_stream", REPLAY)
def str_4(spark, sf_dir):
    return _live(spark, load_requests(spark, sf_dir), S.budget_stream)
