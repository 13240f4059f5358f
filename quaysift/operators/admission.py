"""Type registry, detection by content, layered admission and routing: lookup joins whose small sides are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..functions.checks import ascii_lower


def validate_registry(reg: DataFrame) -> DataFrame:
    """The registry unchanged; a ``scan`` value outside the known ones fails the job."""
    unknown = F.size(F.array_except("scan", F.array(*(F.lit(v) for v in lookups.SCAN_VALUES))))
    return reg.filter(F.coalesce(F.assert_true(unknown == 0, F.concat(F.lit("unknown scan value for "), F.col("ext"))).cast("boolean"), F.lit(True)))


def expand_aliases(reg: DataFrame, aliases: DataFrame) -> DataFrame:
    """``mime, ext``: each extension under its media type and, one step on, under that type's aliases."""
    named = reg.filter("mime IS NOT NULL AND mime <> ''")
    other = named.join(F.broadcast(aliases), "mime").select(F.col("alias").alias("mime"), "ext")
    return named.select("mime", "ext").unionByName(other).distinct()


def expand_zip_based(reg: DataFrame) -> DataFrame:
    """``mime, ext``: extensions of zip containers that have a media type, under the zip types."""
    zips = F.explode(F.array(*(F.lit(m) for m in lookups.ZIP_MIMES))).alias("mime")
    return reg.filter("zip_based AND mime IS NOT NULL AND mime <> ''").select(zips, "ext")


def mime_to_exts(reg: DataFrame, aliases: DataFrame, most: int = 63) -> DataFrame:
    """``mime, exts``: sorted extensions per media type without the banned types; more than ``most`` fail the job."""
    pairs = expand_aliases(reg, aliases).unionByName(expand_zip_based(reg)).filter(~F.col("mime").isin(*lookups.BANNED_MIMES))
    out = pairs.groupBy("mime").agg(F.sort_array(F.collect_set("ext")).alias("exts"))
    return out.filter(F.coalesce(F.assert_true(F.size("exts") <= most, F.lit("too many extensions")).cast("boolean"), F.lit(True)))


def prefix_to_exts(reg: DataFrame) -> DataFrame:
    """``prefix, exts`` of the six general types; one without an extension still has a row."""
    spark = reg.sparkSession
    kinds = spark.createDataFrame([(t,) for t in lookups.PREFIX_TYPES], "type string")
    return F.broadcast(kinds).join(reg, "type", "left").groupBy(F.concat("type", F.lit("/")).alias("prefix")).agg(F.sort_array(F.collect_set("ext")).alias("exts"))


def scan_class_exts(reg: DataFrame) -> DataFrame:
    """``class, ext``: extensions that are taken unseen (``opaque``), and those of archives."""
    opaque = reg.filter(F.col("type").isin(*lookups.OPAQUE_TYPES) | F.array_contains("scan", "opaque")).select(F.lit("opaque").alias("class"), "ext")
    return opaque.unionByName(reg.filter(F.array_contains("scan", "archive")).select(F.lit("archive").alias("class"), "ext")).distinct()


def sniff_type(files: DataFrame, content: str = "head", signatures: list[tuple[str, int, str]] = lookups.SIGNATURES) -> DataFrame:
    """Adds ``sniffed``: the media type of the first signature that the binary ``content`` holds.

    Without one, text that is valid UTF-8 without NUL is text/plain, and all else application/octet-stream.
    The signatures are a literal chain of comparisons, so the rows are not exploded.
    """
    c = F.col(content)
    out = F.when(F.is_valid_utf8(c.cast("string")) & ~c.cast("string").contains("\0"), "text/plain").otherwise("application/octet-stream")
    for mime, at, code in reversed(signatures):
        out = F.when(F.hex(F.substring(c, at + 1, len(code) // 2)) == code, mime).otherwise(out)
    return files.withColumn("sniffed", F.when(F.octet_length(c) == 0, "application/x-empty").otherwise(out))


def admit(files: DataFrame, exact: DataFrame, prefix: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``matches_ext`` for ``mime`` and ``ext``: exact type with extension, general type, exact type, binary extension."""
    m = F.broadcast(exact.select(F.col("mime").alias("_mime"), F.col("exts").alias("_exact")))
    p = F.broadcast(prefix.select(F.col("prefix").alias("_prefix"), F.col("exts").alias("_general")))
    c = F.broadcast(classes.select(F.col("ext").alias("_classed")).distinct())
    low = ascii_lower(F.coalesce("mime", F.lit("")))
    x = files.withColumn("_low", low).join(m, F.col("_low") == F.col("_mime"), "left")
    x = x.join(p, F.concat(F.substring_index("_low", "/", 1), F.lit("/")) == F.col("_prefix"), "left").join(c, F.col("ext") == F.col("_classed"), "left")
    has = F.coalesce(F.col("ext") != "", F.lit(False))
    by_exact = has & F.coalesce(F.array_contains("_exact", F.col("ext")), F.lit(False))
    by_prefix = F.col("_prefix").isNotNull()
    in_prefix = has & F.coalesce(F.array_contains("_general", F.col("ext")), F.lit(False))
    by_class = has & F.col("_low").isin("application/octet-stream", "application/unknown", "application/x-empty") & F.col("_classed").isNotNull()
    allowed = by_exact | by_prefix | F.col("_mime").isNotNull() | by_class
    matches = F.when(by_exact, True).when(by_prefix, in_prefix).when(F.col("_mime").isNotNull(), False).otherwise(by_class)
    return x.withColumns({"allowed": allowed, "matches_ext": matches}).drop("_low", "_mime", "_exact", "_prefix", "_general", "_classed")


def admission_verdict() -> tuple[Column, Column]:
    """(verdict, reason) of an admission that refuses, else nulls."""
    reason = F.when(~F.col("allowed"), "disallowed_mime_type").when((F.col("ext") != "") & ~F.col("matches_ext"), "mime_extension_mismatch")
    return F.when(reason.isNotNull(), "rejected"), reason


def categorize(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``category`` from ``mime`` and ``ext``."""
    archives = F.broadcast(classes.filter("class = 'archive'").select(F.col("ext").alias("_archive")).distinct())
    low = ascii_lower(F.coalesce("mime", F.lit("")))
    category = (
        F.when((low == "image/svg+xml") | (F.col("ext") == "svg"), "SVG")
        .when(low.startswith("image/"), "RASTER")
        .when(low == "application/pdf", "PDF")
        .when(low.startswith("video/"), "VIDEO")
        .when(low.startswith("audio/"), "AUDIO")
        .when(low.isin(*lookups.ARCHIVE_MIMES) | ((F.col("ext") != "") & F.col("_archive").isNotNull()), "ARCHIVE")
        .when(low.startswith("text/"), "TEXT")
        .otherwise("GENERIC")
    )
    return files.join(archives, F.col("ext") == F.col("_archive"), "left").withColumn("category", category).drop("_archive")
