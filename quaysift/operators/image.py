"""Image structure: kind, size, animation, trailing data and the policy over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups
from .walkers import image_chunks, jpeg_dimensions

KINDS = {"image/jpeg": "jpeg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/x-ms-bmp": "bmp"}
EXTENSIONS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "webp": "webp", "bmp": "bmp"}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def image_kind(mime: Column, ext: Column) -> Column:
    """By media type, else by extension, else ``unsupported``."""
    return F.coalesce(_lookup(mime, KINDS), _lookup(ext, EXTENSIONS), F.lit("unsupported"))


def _int(content: Column, at: int, n: int, little: bool) -> Column:
    parts = [F.hex(F.substring(content, at + 1 + i, 1)) for i in range(n)]
    return F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("long")


def image_dimensions(content: Column, kind: Column) -> Column:
    """``struct(ok, width, height)`` from fixed offsets of PNG, GIF and BMP; WebP and odd BMP headers count as 0 by 0; JPEG is null (its walk tells)."""
    be = lambda i: _int(content, i, 4, False)
    le = lambda i, n: _int(content, i, n, True)
    signed = lambda c: F.abs(F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))
    size = F.octet_length(content)
    head = lambda i, n: F.hex(F.substring(content, i + 1, n))
    png = (size >= 24) & (head(0, 8) == "89504E470D0A1A0A") & (head(12, 4) == "49484452")
    gif = (size >= 10) & head(0, 6).isin("474946383761", "474946383961")
    dib = le(14, 4)
    bmp = (size >= 18) & (head(0, 2) == "424D")
    old, new = bmp & (dib == 12) & (size >= 22), bmp & (dib >= 40) & (size >= 26)
    struct = lambda ok, w, h: F.struct(ok.alias("ok"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    none = F.lit(0)
    return (
        F.when(kind == "png", struct(png, F.when(png, be(16)).otherwise(0), F.when(png, be(20)).otherwise(0)))
        .when(kind == "gif", struct(gif, F.when(gif, le(6, 2)).otherwise(0), F.when(gif, le(8, 2)).otherwise(0)))
        .when(kind == "bmp", struct(F.lit(True), F.when(old, le(18, 2)).when(new, signed(le(18, 4))).otherwise(0), F.when(old, le(20, 2)).when(new, signed(le(22, 4))).otherwise(0)))
        .when(kind == "webp", struct(F.lit(True), none, none))
    )


def _before_data(chunks: DataFrame) -> DataFrame:
    """With ``_data``, the number of the file's first data chunk. The window and the groups that follow share one shuffle."""
    return chunks.withColumn("_data", F.min(F.when(F.col("chunk_type") == "IDAT", F.col("chunk_idx"))).over(Window.partitionBy("file_id")))


def _png_moves() -> Column:
    control = (F.col("chunk_type") == "acTL") & (F.col("length") == 8) & (F.col("_data").isNull() | (F.col("chunk_idx") < F.col("_data")))
    return F.coalesce(F.max_by("frames", F.when(control, F.col("chunk_idx"))), F.lit(0)) > 1


def _webp_moves() -> Column:
    return (F.count_if(F.col("chunk_type") == "ANIM") > 0) & (F.count_if(F.col("chunk_type") == "ANMF") > 0)


def _gif_moves() -> Column:
    return F.count_if(F.col("chunk_type") == "image") > 1


def _trails(end_type: str) -> Column:
    """Whether a file goes on behind its end, or has none. The size in a RIFF header must fit, and the walk over its chunks must arrive there."""
    exact = F.min(F.when(F.col("chunk_type") == end_type, F.col("end"))) == F.max("file_length")
    if end_type == "RIFF":
        exact &= F.greatest(F.max(F.when(F.col("chunk_type") != "RIFF", F.col("end"))), F.lit(12)) == F.max("file_length")
    return ~F.coalesce(exact, F.lit(False))


def animation_flags(chunks: DataFrame) -> DataFrame:
    """``file_id, animated``: the last control chunk of 8 bytes before the first data chunk says more than one frame."""
    return _before_data(chunks).groupBy("file_id").agg(_png_moves().alias("animated"))


def webp_animated(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(_webp_moves().alias("animated"))


def gif_animated(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(_gif_moves().alias("animated"))


def trailing_data(chunks: DataFrame, end_type: str = "IEND") -> DataFrame:
    """``file_id, trailing``: the end chunk isn't there or doesn't end where the file does. Chunks carry ``end`` and ``file_length``."""
    return chunks.groupBy("file_id").agg(_trails(end_type).alias("trailing"))


def image_flags(chunks: DataFrame, kind: Column | None = None) -> DataFrame:
    """``file_id, animated, trailing`` in one shuffle, for files of all ``kind`` of a chunk's file (none: PNG)."""
    kind = F.lit("png") if kind is None else kind
    rows = _before_data(chunks.withColumn("_kind", kind))
    pick = lambda png, webp, gif: F.when(F.first("_kind") == "png", png).when(F.first("_kind") == "webp", webp).otherwise(gif)
    return rows.groupBy("file_id").agg(pick(_png_moves(), _webp_moves(), _gif_moves()).alias("animated"), pick(_trails("IEND"), _trails("RIFF"), _trails("trailer")).alias("trailing"))


def image_policy() -> Column:
    """``struct(verdict, reason, reencode)`` from columns kind, opaque, length, header_ok, width, height, animated, trailing."""
    c = F.col
    sized = (c("width") > 0) & (c("height") > 0)
    closed = F.coalesce(c("trailing"), F.lit(False))
    moving = F.coalesce(c("animated"), F.lit(False)) & c("kind").isin("gif", "png", "webp")
    reason = (
        F.when((c("kind") == "unsupported") & c("opaque"), "opaque_image_passthrough")
        .when(c("kind") == "unsupported", "unsupported_image_format")
        .when(c("length") > lookups.MAX_IMAGE, "image_too_large")
        .when(~c("header_ok"), "image_header_malformed")
        .when(sized & ((c("width") > lookups.MAX_SIDE) | (c("height") > lookups.MAX_SIDE)), "image_dimensions_exceeded")
        .when(sized & (c("width") * c("height") > lookups.MAX_PIXELS), "image_pixel_count_exceeded")
        .when(moving & closed, F.concat("kind", F.lit("_trailing_data")))
        .when(moving, F.concat("kind", F.lit("_animated_passthrough")))
    )
    verdict = (
        F.when(reason.isNull(), "sanitized")
        .when(reason == "unsupported_image_format", "error")
        .when(reason.endswith("_passthrough"), "clean")
        .otherwise("rejected")
    )
    return F.struct(verdict.alias("verdict"), reason.alias("reason"), reason.isNull().alias("reencode"))


def image_verdict(files: DataFrame, opaque: Column | None = None) -> DataFrame:
    """``file_id, verdict, reason, reencode`` of ``files(file_id, mime, ext, content)`` from their bytes.

    Kind, size, animation and what stands behind the end are read from the bytes, and ``image_policy`` judges. ``opaque`` tells whose extension
    names binary content that isn't looked into (none: nobody's). Only what is found travels between tasks, never the content. Null content counts as empty.
    """
    body = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    known = files.select("file_id", image_kind(F.lower("mime"), F.lower("ext")).alias("kind"), (F.lit(False) if opaque is None else F.coalesce(opaque, F.lit(False))).alias("opaque"), body.alias("content"))
    head = known.select("file_id", "kind", "opaque", F.octet_length("content").cast("long").alias("length"), image_dimensions(F.substring("content", 1, 30), F.col("kind")).alias("d"))
    # a walk's rows count only for files of its kind
    moving = known.filter(F.col("kind").isin("png", "webp", "gif"))
    chunks = image_chunks(moving.select(F.struct("file_id", "kind").alias("k"), "content"), key="k").select("k.*", "chunk_idx", "chunk_type", "length", "end", "frames", "file_length")
    flags = image_flags(chunks, F.col("kind"))
    sizes = jpeg_dimensions(known.filter("kind = 'jpeg'")).select("file_id", "ok", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    x = head.join(flags, "file_id", "left").join(sizes, "file_id", "left")
    x = x.select(
        "file_id", "kind", "opaque", "length", "animated", "trailing", F.coalesce("ok", "d.ok", F.lit(False)).alias("header_ok"), F.coalesce("w", "d.width", F.lit(0)).alias("width"), F.coalesce("h", "d.height", F.lit(0)).alias("height")
    )
    return x.select("file_id", image_policy().alias("p")).select("file_id", "p.*")
