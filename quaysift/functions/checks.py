"""Column functions: request checks, names, media types and paths. Lengths, cuts and offsets are in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lookups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def cut_bytes(c: Column, n: int) -> Column:
    """The first ``n`` bytes as text; a character that the cut splits is replaced."""
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(F.encode(c, "UTF-8"), 1, n), "UTF-8"))


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased, 31 bytes at most; empty without a dot, with only a leading one, or when nothing follows."""
    return cut_bytes(ascii_lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)^.+\.([^.]+)$", 1)), 31)


def first_failed(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that doesn't hold (null counts as failed), or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return out


def required(columns: list[str]) -> Column:
    return first_failed([(c, F.col(c).isNotNull()) for c in columns])


def ranges() -> Column:
    """The first field of a request whose value is out of range."""
    top = (1 << 31) - 1
    return first_failed(
        [
            ("user_id", F.col("user_id") >= 1),
            ("version", F.col("version").between(2, top)),
            ("chunk_size", F.col("chunk_size") == lookups.CHUNK),
            ("chunks", F.col("chunks").between(1, top)),
            ("plaintext_size", F.col("plaintext_size").between(0, lookups.MAX_FILE)),
            ("original_filename", F.coalesce(F.octet_length("original_filename"), F.lit(0)) < 256),
            ("file_path", F.octet_length("file_path").between(1, 4095)),
        ]
    )


def chunk_count_ok(size: Column, chunk: Column, chunks: Column) -> Column:
    """The declared chunks are those that the size needs, give or take one."""
    return F.abs(chunks - ((size + chunk - 1) / chunk).cast("long")) <= 1


def safe_path(path: Column, prefix: str) -> Column:
    """Absolute, below the prefix, with no step upwards and a last name. Links are not resolved."""
    inside = path.startswith("/") & path.startswith(prefix) & (F.octet_length(path) > len(prefix))
    return F.coalesce(inside & ~path.contains("/../") & ~path.endswith("/..") & ~path.endswith("/"), F.lit(False))


def hex64(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$") & (F.octet_length(c) == 64), F.lit(False))


def base64_length(c: Column, n: int) -> Column:
    """Decodes to exactly ``n`` bytes."""
    return F.coalesce(F.octet_length(F.try_to_binary(c, F.lit("base64"))) == n, F.lit(False))


def mask_reason(c: Column, most: int = 63) -> Column:
    """Every byte outside letters, digits, ``_.-`` becomes ``?``; cut; empty becomes ``none``."""
    by_byte = F.decode(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), "ISO-8859-1")
    masked = F.substring(F.regexp_replace(by_byte, "[^A-Za-z0-9_.-]", "?"), 1, most)
    return F.when(masked == "", "none").otherwise(masked)


def sanitized_path(path: Column, prefix: str) -> tuple[Column, Column]:
    """(output path or null, reason or null) for cleaned content."""
    out = F.concat(F.lit(prefix + "sanitized/"), F.element_at(F.split(path, "/"), -1), F.lit(".sanitized"))
    long = F.octet_length(out) >= lookups.PATH_LIMIT
    return F.when(~long, out), F.when(long, "sanitized_path_too_long")


def looks_like_svg(head: Column) -> Column:
    """The SVG namespace, or an ``svg`` tag with or without a prefix, in the first 64 KiB."""
    window = F.decode(F.substring(F.encode(F.coalesce(head, F.lit("")), "UTF-8"), 1, 65_536), "ISO-8859-1")
    return ascii_lower(window).contains("http://www.w3.org/2000/svg") | window.rlike(r"<([A-Za-z0-9_-]+:)?[sS][vV][gG]([ \t\r\n>/]|\z)")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def reclassify(mime: Column, ext: Column, head: Column) -> Column:
    """Ordered rewrites of a detected type by extension and content; each sees the one before."""
    full = F.octet_length(head) > 0
    ogg = lambda m: m.contains("ogg") | m.contains("vorbis") | m.contains("opus")
    rewrites = [
        lambda m: F.when((m == "application/x-empty") & ext.isin(*lookups.TEXT_EXTENSIONS), "text/plain").otherwise(m),
        lambda m: F.when((m == "video/mp2t") & ext.isin("ts", "tsx") & full & (F.substring(head, 1, 1) != "G"), "text/plain").otherwise(m),
        lambda m: F.when((m == "video/mp4") & ext.isin("m4a", "m4r", "m4b"), "audio/mp4").otherwise(m),
        lambda m: F.when((m == "video/x-ms-asf") & (ext == "wma"), "audio/x-ms-wma").otherwise(m),
        lambda m: F.when((m == "video/x-matroska") & (ext == "mka"), "audio/x-matroska").otherwise(m),
        lambda m: F.when(ogg(m) & ext.isin("ogg", "oga", "opus"), "audio/ogg").when(ogg(m) & (ext == "ogv"), "video/ogg").otherwise(m),
        lambda m: F.when((ext == "tar") & (F.substring(head, 258, 5) == "ustar"), "application/x-tar").otherwise(m),
        lambda m: F.when(m.isin("text/xml", "application/xml") & looks_like_svg(head), "image/svg+xml").otherwise(m),
    ]
    for rewrite in rewrites:
        mime = _let(mime, rewrite)
    return mime


def escape_markup(c: Column, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#39;")] if attribute else [])]
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def strip_bom(content: Column) -> Column:
    """Of binary text ``struct(verdict, reason, modified, output)``. A mark alone leaves empty output and no reason."""
    bom = F.coalesce(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.lit(False))
    rest = F.substring(content, F.lit(4), F.greatest(F.octet_length(content) - 3, F.lit(0)))
    return F.struct(
        F.when(bom, "sanitized").otherwise("clean").alias("verdict"),
        F.when(bom & (F.octet_length(content) > 3), "bom_stripped").alias("reason"),
        bom.alias("modified"),
        F.when(bom, rest).otherwise(content).alias("output"),
    )


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex of binary or text under one key, whose pads are literals."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = F.lit(bytes(b ^ 0x36 for b in key)), F.lit(bytes(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hmac_by_row(message: Column, key: Column) -> Column:
    """HMAC-SHA256 in hex under each row's own key of at most 64 bytes, from built-in functions."""
    padded = F.rpad(F.hex(key), 128, "0")
    nibble = lambda table: F.translate(padded, "0123456789ABCDEF", table)
    # xor with 0x36 and 0x5C, digit by digit: high digits take 3 and 5, low ones 6 and C
    digits = "0123456789ABCDEF"
    mapped = lambda x: "".join(digits[i ^ x] for i in range(16))
    byte = lambda hi, lo, i: F.concat(F.substring(hi, 2 * i + 1, 1), F.substring(lo, 2 * i + 2, 1))
    pad = lambda h, l: F.unhex(F.concat(*(byte(nibble(mapped(h)), nibble(mapped(l)), i) for i in range(64))))  # noqa: E731, E741
    return F.sha2(F.concat(pad(0x5, 0xC), F.unhex(F.sha2(F.concat(pad(0x3, 0x6), message.cast("binary")), 256))), 256)


def metadata_canonical(version: Column, nonce: Column, chunk: Column, chunks: Column, sha: Column, size: Column) -> Column:
    return F.format_string('[%d,"%s",%d,%d,"%s",%d]', version.cast("long"), nonce, chunk.cast("long"), chunks.cast("long"), sha, size.cast("long"))
