"""Archives as rows of entries: running totals, ordered policies and the first violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lookups
from ..functions.checks import ascii_lower
from .walkers import tar_entries, zip_entries

SUFFIXES = r"(?i)\.(" + "|".join(s.replace(".", r"\.") for s in lookups.NESTED_SUFFIXES) + r")\z"


def archive_kind(head: Column, mime: Column, is_archive_ext: Column) -> Column:
    """``zip``, ``tar`` or ``none`` of binary content; only archives by type or extension are looked into."""
    at = lambda i, n: F.hex(F.substring(head, i + 1, n))
    inspect = mime.isin(*lookups.ARCHIVE_MIMES) | F.coalesce(is_archive_ext, F.lit(False))
    zipped = (at(0, 2) == "504B") & at(2, 1).isin("03", "05") & at(3, 1).isin("04", "06")
    return F.when(~inspect, "none").when(zipped, "zip").when(at(257, 5) == "7573746172", "tar").otherwise("none")


def entry_path_reason(path: Column, head: Column | None = None) -> Column:
    """Why an entry's name (or its first bytes, an archive's own) is refused, or null."""
    nested = path.rlike(SUFFIXES) if head is None else path.rlike(SUFFIXES) | nested_by_magic(head)
    deep = F.length(path) - F.length(F.translate(path, "/\\", ""))
    return (
        F.when(path.contains("\0"), "archive_entry_null_byte")
        .when(path.startswith("/") | path.contains("../") | path.contains("..\\"), "archive_path_traversal")
        .when(nested, "archive_nested_archive")
        .when(deep > lookups.MAX_DEPTH, "archive_depth_exceeded")
    )


def nested_by_magic(head: Column) -> Column:
    """Whether an entry's first bytes (four at least) are those of another archive."""
    out = F.lit(False)
    for mime, at, code in lookups.SIGNATURES:
        if mime in lookups.NESTED_MIMES:
            out = out | (F.hex(F.substring(head, at + 1, len(code) // 2)) == code)
    return (F.octet_length(head) >= 4) & out


def expansion_limit(size: Column) -> Column:
    scaled = F.lit(lookups.EXPANSION_RATIO).cast("long") * F.greatest(size.cast("long"), F.lit(1))
    return F.least(F.greatest(scaled, F.lit(lookups.EXPANSION_MIN)), F.lit(lookups.EXPANSION_MAX).cast("long"))


def running_expansion(entries: DataFrame, limit: Column | None = None) -> DataFrame:
    """Adds ``expanded`` (bytes up to and with the entry) and ``over``: whether that is past the archive's limit."""
    w = W.partitionBy("archive_id").orderBy("entry_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a size may be the largest long, after which no walk goes on
    out = entries.withColumn("expanded", F.sum(F.least("uncomp_size", F.lit(1 << 62))).over(w))
    return out.withColumn("over", F.col("expanded") > (expansion_limit(F.col("archive_size")) if limit is None else limit))


def running_count(entries: DataFrame, most: int = lookups.MAX_ENTRIES) -> DataFrame:
    """Adds ``counted`` (real entries so far; helpers of types x, g, L, K don't count) and ``too_many``."""
    w = W.partitionBy("archive_id").orderBy("entry_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    real = F.when(F.col("typeflag").isin("x", "g", "L", "K"), 0).otherwise(1)
    out = entries.withColumn("counted", F.sum(real).over(w))
    return out.withColumn("too_many", F.col("counted") > most)


def entry_size_reason(status: Column, method: Column, comp: Column, declared: Column, actual: Column) -> Column:
    """Why an entry's data are refused, from what a trial inflation found, or null."""
    return (
        F.when(status == "bad_header", "zip_local_header_invalid")
        .when(status == "truncated", "zip_entry_truncated")
        .when((method == 0) & (comp != declared), "archive_size_mismatch")
        .when(status == "corrupt", "zip_entry_corrupt")
        .when((status == "ok") & (actual != declared), "archive_size_mismatch")
    )


def structure_reason(size: Column, eocd: Column, cd_end: Column, listed: Column, declared: Column) -> Column:
    """Why a zip's structure is refused, or null."""
    return (
        F.when(size < 22, "zip_too_small")
        .when(~eocd, "zip_no_eocd")
        .when(declared > lookups.MAX_ENTRIES, "archive_entries_exceeded")
        .when(cd_end > size, "zip_cd_truncated")
        .when(listed != declared, "zip_cd_malformed")
    )


def archive_verdict(entries: DataFrame, most: int = lookups.MAX_ENTRIES, limit: Column | None = None) -> DataFrame:
    """``archive_id, verdict, reason`` by the first violation in walk order: name, count, expansion, then size of each entry.

    A helper entry has no name to judge. Clean archives have no reason.
    """
    x = running_count(running_expansion(entries, limit), most)
    helper = F.col("typeflag").isin("x", "g", "L", "K")
    checks = F.array_compact(
        F.array(
            F.when(~helper, entry_path_reason(F.col("path"))),
            F.when(~helper & F.col("too_many"), "archive_entries_exceeded"),
            F.when(F.col("over"), "archive_expansion_exceeded"),
            F.when(F.col("actual_size") != F.col("uncomp_size"), "archive_size_mismatch"),
        )
    )
    x = x.withColumn("_reason", F.get(checks, F.lit(0)))
    out = x.groupBy("archive_id").agg(F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("entry_idx"))).alias("r"))
    return out.select("archive_id", F.when(F.col("r").isNull(), "clean").otherwise("rejected").alias("verdict"), F.concat(F.lit("archive_policy:"), "r").alias("reason"))


def _judged(files: DataFrame, entries: DataFrame, reason: Column, last: Column | None = None) -> DataFrame:
    """``file_id, verdict, reason``: the first entry's ``reason`` in walk order, else ``last``; files without entries are clean."""
    x = entries.withColumn("_reason", reason).withColumn("_last", F.lit(None).cast("string") if last is None else last)
    first = F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("entry_idx")))
    found = x.groupBy("file_id").agg(F.coalesce(first, F.max("_last")).alias("r"))
    out = files.select("file_id").join(found, "file_id", "left")
    return out.select("file_id", F.when(F.col("r").isNull(), "clean").otherwise("rejected").alias("verdict"), F.concat(F.lit("archive_policy:"), "r").alias("reason"))


def zip_verdict(files: DataFrame) -> DataFrame:
    """``file_id, verdict, reason`` of ``files(file_id, content)`` taken as zips: structure, then name, expansion and data of
    each entry in the order of the central directory, then the number of entries."""
    x = running_expansion(zip_entries(files).withColumnsRenamed({"file_id": "archive_id", "size": "archive_size"})).withColumnRenamed("archive_id", "file_id")
    c = F.col
    structure = structure_reason(c("archive_size"), c("eocd"), c("cd_end"), c("declared"), c("declared"))
    data = entry_size_reason(c("status"), c("method"), c("comp_size"), c("uncomp_size"), c("actual_size"))
    entry = F.when(c("path").isNotNull(), F.coalesce(entry_path_reason(c("path")), F.when(c("over"), "archive_expansion_exceeded"), data))
    return _judged(files, x, F.coalesce(structure, entry), F.when(c("listed") != c("declared"), "zip_cd_malformed"))


def tar_verdict(files: DataFrame) -> DataFrame:
    """``file_id, verdict, reason`` of ``files(file_id, content)`` taken as tars: checksum, then name, first bytes and number of
    real entries, and the expansion, header by header."""
    x = tar_entries(files).withColumnsRenamed({"file_id": "archive_id", "size": "archive_size"})
    x = running_count(running_expansion(x)).withColumnRenamed("archive_id", "file_id")
    real = F.coalesce(entry_path_reason(F.col("path"), F.col("head")), F.when(F.col("too_many"), "archive_entries_exceeded"))
    return _judged(files, x, F.coalesce(F.when(~F.col("checksum_ok"), "archive_malformed"), F.when(~F.col("helper"), real), F.when(F.col("over"), "archive_expansion_exceeded")))
